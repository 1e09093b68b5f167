import collections
import hashlib
import random

import pytest

from loomset.llm import substring_dedup as sd


def brute(rows, threshold=20):
    texts = sorted(((d is None, d or 0, hashlib.sha256(b" ".join((t or "").encode().split())).digest()[:16], (t or "").encode().split()) for d, t in rows), key=lambda x: x[:3])
    seen, out = set(), collections.Counter()
    for none, d, _, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - threshold + 1):
            window = tuple(words[i : i + threshold])
            if window in seen:
                gone[i : i + threshold] = [True] * threshold
            seen.add(window)
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[None if none else d, len(words), sum(gone), hashlib.sha256(left).hexdigest(), left if any(gone) else None] += 1
    return out


def result(df):
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, None if r.kept is None else r.kept.encode()) for r in df.collect())


@pytest.mark.parametrize("most, threshold", [(1024, 20), (2, 20), (2, 17), (1, 33)])
def test_substring_dedup_against_brute_force(spark, monkeypatch, most, threshold):
    monkeypatch.setattr(sd, "GROUP_RUNS", most)
    rnd = random.Random(most * 100 + threshold)
    few = lambda n: [rnd.choice(["a", "b", "ü"]) for _ in range(n)]
    word = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    line, passage, hot = word(10), word(70), few(9)
    texts = [few(rnd.randint(0, 120)) for _ in range(25)] + [few(rnd.randint(0, 9)) + hot + few(rnd.randint(0, 40)) for _ in range(25)]
    texts += [word(rnd.randint(0, 30)) + line + word(rnd.randint(0, 30)) for _ in range(12)]
    texts += [word(5) + passage[i : i + 30 + 3 * i] + word(i) + passage[: 40 - i] for i in range(12)] + [["x"] * 90, ["x"] * 60, passage * 3, passage, passage[: threshold - 1]]
    texts += texts[3:6] + [texts[-1]] * 3
    rows = [(rnd.choice([None, 7, 7, *range(60, 90)]), rnd.choice([" ", "\n", "\t \r"]).join(t)) for t in texts] + [(1, None), (2, ""), (3, " \n"), (None, None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, b"clash", 0) for r in rows], "doc_id long, text string, tid binary, row int")
    assert result(sd.substring_dedup(df, threshold=threshold)) == brute(rows, threshold)


def test_empty_tables_edges_and_long_texts(spark, docs):
    assert sd.substring_dedup(docs.limit(0)).collect() == []
    assert result(sd.substring_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    with pytest.raises(ValueError):
        sd.substring_dedup(docs, threshold=15)


def test_extension_finds_the_match_and_what_is_open():
    lead = ([b"b", b"a"], [b"x", b"y", b"z"])
    assert sd.extend(lead, ([b"b", b"a"], [b"x", b"y", b"z"]), 0, 2, 3) == ((0, 2), [])
    assert sd.extend(lead, ([b"b", b"q"], [b"x", b"y", b"n"]), 0, 2, 3) == ((1, 1), [(b"l1 q", 2, 2), (b"r2 n", 0, 0)])
    assert sd.extend(lead, ([b"q", b"q"], [b"m", b"y", b"n"]), 0, 2, 3) == (None, [(b"l0 q", 1, 2), (b"r0 m", 0, 0)])


def test_texts_move_once(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 60))) for i in range(50)], "doc_id long, text string")
    held = sd.in_words(rows, "doc_id", "text", 20)
    marks = rows.selectExpr("doc_id AS t", "doc_id AS first", "0 AS more")
    joined = held.select("row", "body").join(sd.by_text(marks, held.selectExpr("id AS t", "row")).hint("shuffle_hash"), "row")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    body = plan[: plan.index("Exchange")] if plan.index("FileScan") < plan.index("Exchange") else plan
    assert "Bucketed: true" in plan and "Exchange" not in body.split("FileScan")[0].replace("BroadcastExchange", "")
