import collections
import random
import re
import zlib

import pytest

from loomset.llm import spelling_variants as sv


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, factor=5):
    near = {w: [x for x in counts if one_error(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]


def test_automaton_numbers_words_in_their_order_and_is_minimal():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(0, 7))) for _ in range(300)})
    a = sv.Automaton(words)
    assert [next(a.rest(a.start, 0, w)) for w in words] == list(range(len(words)))
    assert list(a.rest(a.start, 0, "zz")) == []
    tails = {frozenset(x[len(p) :] for x in words if x.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(a.edges) == len(tails)
    for w in words[:60]:
        for exact in range(len(w) + 1):
            assert {words[i] for i in a.one_error(w, exact)} == {x for x in words if x[:exact] == w[:exact] and one_error(w, x)}


@pytest.mark.parametrize("most, block", [(4096, 16384), (3, 10)])
def test_variants_against_brute_force(spark, monkeypatch, most, block):
    monkeypatch.setattr(sv, "GROUP_WORDS", most)
    monkeypatch.setattr(sv, "BLOCK_WORDS", block)
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abç") for _ in range(rnd.randint(1, 7))) for _ in range(400)}
    words |= {"same" * 3 + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 4))) + "end" for _ in range(60)} | {"x" * i for i in range(1, 14)}
    counts = {w: rnd.choice([5, 5, 6, 26, 30, 200, 2000]) for w in sorted(words)}
    rows = spark.createDataFrame([(w, n, "k", 1) for w, n in counts.items()], "word string, n long, key string, number int")
    assert sorted(map(tuple, sv.spelling_variants(rows).collect())) == sorted(brute_variants(counts))


def test_words_ties_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("colour", 3), ("colour", 2), ("colouur", 30), ("colours", 30), (None, 9), ("lone", None), ("é", 1)], "word string, n long")
    got = {r.word: r for r in sv.spelling_variants(rows).collect()}
    assert got.keys() == {"colour", "colouur", "colours", "é"}
    assert tuple(got["colour"]) == ("colour", "colours", "colours", 5, 2, 30) and tuple(got["é"]) == ("é", None, "é", 1, 0, None)
    assert sv.spelling_variants(rows.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sv.spelling_variants(rows, factor=1)


def test_roots_follow_long_ways(spark):
    rows = spark.createDataFrame([("a" * i, 5**i) for i in range(1, 19)], "word string, n long")
    assert {r.root for r in sv.spelling_variants(rows).collect()} == {"a" * 18}


def test_common_words_by_hand(spark, docs):
    texts = [("Straße élevées Élevées ELEVÉES short x1word " * 3, 11), ("vvvvvv " * 40 + "÷÷÷÷÷÷×", None), (None, 12), ("", 13)]
    rows = spark.createDataFrame([(d, t, "w") for t, d in texts] + [(100 + i, f"planted{'q' * 6} other", "w") for i in range(900)], "doc_id long, text string, word string")
    want = collections.Counter()
    for r in rows.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            at = h % len(run)
            want[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    assert {(r.word, r.n) for r in sv.common_words(rows).collect()} == {(w, n) for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert len([w for w in want if w.startswith("planted")]) > 1
    assert sv.common_words(docs).where("word = 'tail'").collect() == [] and sv.common_words(docs.limit(0)).collect() == []
