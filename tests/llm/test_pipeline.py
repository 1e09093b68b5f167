import collections
import random
import re

import corpus_pipeline
from loomset import store
from loomset.llm import mixing


def test_pipeline_on_small_documents(spark, docs):
    rows = docs.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS LONG) AS n_chars", "1 AS verdict", "text AS tid", "text AS row_key", "text AS kept", "2 AS size", "3 AS taken")
    sf = "/root/testdata/sf0.001"
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf)
        assert stage(spark, rows.limit(0), sf).collect() == []
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        if i == 1:
            assert sorted(r.doc_id for r in out.where("text LIKE 'word%'").collect()) in ([1], [1, 3])
        out.collect()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and out.where("NOT same_ids OR NOT round_trip").count() == 0


def as_docs(spark, rows):
    """Rows of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(200))
    other, third = text.replace("word", "other"), text.replace("word", "third")
    rows = [(None, text, "en", "a")] * 5 + [(7, text, "en", "a")] * 2 + [(2, other, "en", "b"), (2, other, "en", "b"), (1, third, "en", "b"), (2, third, "en", "b"), (None, "alone in here", "en", "a"), (None, "alone in here", "en", "a"), (3, None, "en", "a"), (3, None, "en", "a")]
    out = corpus_pipeline.near_duplicates(spark, as_docs(spark, rows), "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(7, text), (2, other), (1, third), (None, "alone in here"), (3, None), (3, None)], key=repr)


def test_rows_with_one_id_are_mixed_by_themselves(spark):
    rows = [(5, f"w{i} " * (9 + i), "en", "b") for i in range(40)] + [(5, f"v{i} " * 30, "en", "a") for i in range(10)] + [(5, "same text " * 20, "en", "c")] * 6 + [(5, "", "en", "c"), (5, None, None, None)]
    docs = as_docs(spark, rows)
    takings = mixing.mix_sources(docs).collect()
    want, got = collections.Counter(), collections.Counter()
    for r in takings:
        want[r.source] += r.taken
    for r in corpus_pipeline.mixed(spark, docs, "").collect():
        got[r.source] += len(r.text.split())
    assert got == +want and len({r.taken for r in takings}) > 2


def test_nulls_in_every_column_of_a_run(spark, tmp_path):
    """``run`` over rows with null sources, languages, ids and texts, and very many equal ones: each stage's rows by plain rules."""
    good = " ".join(f"word{i * 7919 % 1000}" for i in range(120))
    rows = [(i, f"{good} tail{i} " + " ".join(f"x{i}y{j}" for j in range(60 + i)), None if i % 3 else "en", None if i % 4 else "s") for i in range(24)]
    rows += [(None, "the very same text " * 12, None, None)] * 40 + [(None, None, None, None), (50, "", "en", None)]
    as_docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labelled = spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    labelled.write.parquet(str(tmp_path / "labels.parquet"))
    before = set(store._KEPT)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("NOT same_ids OR NOT round_trip").count() == 0 and out.columns == ["doc_id", "ids", "n_pieces", "same_ids", "round_trip"]
    assert len([p for p in set(store._KEPT) - before if "stage-" in p]) == 1 and len(set(store._KEPT) - before) <= 3, "what is spent is deleted"
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.classified(spark, docs, str(tmp_path))
    assert kept.count() <= len(rows) and kept.exceptAll(docs.select(*corpus_pipeline.COLUMNS)).isEmpty()
    near = corpus_pipeline.near_duplicates(spark, kept, "")
    assert near.where("text LIKE 'the very same%'").count() == min(1, kept.where("text LIKE 'the very same%'").count())


def test_repeats_are_cut_like_by_hand(spark):
    rnd = random.Random(13)
    word = lambda: rnd.choice(("oak", "elm", "ash", "fir")) + str(rnd.randrange(400))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80)]
    texts = [" ".join([word() for _ in range(rnd.randrange(30))] + passages[i % 4] + [word() for _ in range(rnd.randrange(30))]) for i in range(16)]
    texts += [texts[0], "\t" + "  ".join(passages[3]) + "\n", "", None, " ".join(passages[1] + passages[1])]
    words = [(t or "").split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    want = []
    for t, w in zip(texts, words):
        hit = {k for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] > 1 for k in range(i, i + 50)}
        starts = [m.start() for m in re.finditer(r"\S+", t or "")] + [len(t or "")]
        kept = "".join((t or "")[starts[i] : starts[i + 1]] for i in range(len(w)) if i not in hit)
        want.append((t or "")[: starts[0]] + kept if hit else t)
    out = corpus_pipeline.repeats_cut(spark, as_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), "")
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {i: (t, len(t or "")) for i, t in enumerate(want)} and any(a != b for a, b in zip(texts, want))


def test_stages_by_hand(spark):
    """Near duplicates, mixing and encoding of a few documents, by rules in plain Python."""
    import public_tokenizers
    import sentencepiece

    text = [f"w{i} " * 3 + " ".join(f"u{i}x{j}" for j in range(40)) for i in range(6)]
    rows = [(i, text[i], "en", "ab"[i % 2]) for i in range(6)] + [(10, text[0], "en", "a"), (11, text[1] + " end", "en", "b")]
    docs = corpus_pipeline.near_duplicates(spark, as_docs(spark, rows), "")
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 2, 3, 4, 5]
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    out = collections.defaultdict(list)
    for r in corpus_pipeline.mixed(spark, docs, "").collect():
        out[r.doc_id].append(r.text)
    for i in range(6):
        words = text[i].split()
        whole, part = divmod(taken[i], len(words))
        assert sorted(out[i]) == sorted([text[i]] * whole + [" ".join(words[:part])] * (part > 0))
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.ids for r in corpus_pipeline.encoded(spark, docs, "").collect()} == {i: own.encode(text[i]) for i in range(6)}
