import collections
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomset.llm import licence_scan, quality_classifier, quality_rules, sentencepiece_codec, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_token_counts_are_the_library_s(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect()]
    assert by_rows(token_counts.token_counts(docs, path)) == sorted(want, key=repr)
    assert by_rows(token_counts.token_counts(docs, path, cache_size=1, table_size=1)) == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0), path).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_cut_gives_the_library_s_counts(spark, docs, name):
    import random

    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path(name), random.Random(2)
    library = Tokenizer.from_file(path)
    parts = ["a", "It's", "don't", "word", "Ünï", "12", "3.14", " ", "  ", "\n", "\t", "\n\n", "\xa0", "\x1c", "\u2003", "<|endoftext|>", "<|", "!?", "--", "é", "漢字", "'s", "'", "_x", "😀", "\r\n", "ﬁ"]
    texts = ["", None, *parts[:25], *("".join(rnd.choice(parts) + rnd.choice(("", " ")) for _ in range(rnd.randint(1, 40))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(rows, path).collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect()}


def test_files_that_can_t_be_cut_raise(tmp_path):
    import json

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Metaspace"}}):
        with pytest.raises(ValueError):
            token_counts.Cutter(json.dumps(spec | change))


def test_sentencepiece_parity_and_round_trip(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_codec.sentencepiece_encode(docs, path)
    rows = got.collect()
    assert all(r.same_ids and r.round_trip for r in rows) and len(rows) == docs.count()
    assert sorted(map(repr, (r.ids for r in rows))) == sorted(repr(own.encode(r.text or "")) for r in docs.collect())
    back = sentencepiece_codec.sentencepiece_decode(got.select("doc_id", "ids"), path)
    assert sorted(r.decoded for r in back.collect()) == sorted(r.decoded for r in rows)
    assert sentencepiece_codec.sentencepiece_encode(docs.limit(0), path).collect() == []


def test_a_small_cache_gives_the_same_ids():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        blob = f.read()
    own, small = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(blob, 1, False, room=2000)
    for texts in (["some words here", "and  more\0of them", "x" * 900], ["▁ marks", "é 😀 ü", "some words"], [""]):
        assert [list(x) for x in zip(*small.there_and_back(texts))] == [own.encode(texts), [t.replace("▁", " ") for t in texts]]


def test_decoding_is_sentencepiece_s():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        blob = f.read()
    own, codec, rnd = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(blob, 1, False), random.Random(1)
    euro = [own.piece_to_id(f"<0x{b:02X}>") for b in "€".encode()]
    cases = [[], [0], [1], [2, 0, 1], [5, 0, 6], euro, [300, *euro, 0, *euro, 301], [1, own.piece_to_id("▁the"), 2], [own.piece_to_id("▁"), 400]]
    cases += [[rnd.choice([0, 1, 2, *range(259, 32000)]) for _ in range(12)] for _ in range(300)]
    assert [codec.decode(x) for x in cases] == [own.decode(x) for x in cases]
    with pytest.raises(IndexError):
        codec.decode([32000])


def small_unigram(name="identity", charsmap=b""):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), ("▁", -3.0, 1), *((c, -4.0, 1) for c in "abcde"), ("▁ab", -1.5, 1), ("cd", -2.0, 1), ("abc", -2.5, 1)]
    for piece, score, kind in pieces:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, True, 0
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = name, charsmap, True, False, True
    return model.SerializeToString()


def test_a_precompiled_normaliser_is_rebuilt():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rules = pb.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
    blob = small_unigram("nfkc", rules.normalizer_spec.precompiled_charsmap)
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=blob), sentencepiece_codec.Codec(blob, 1, False)
    texts = ["abcd", "ａｂ ｃｄ", "①é ﬁ", "", "ab\u3000cd"]
    assert codec.encode(texts) == [own.encode(t) for t in texts]
    assert [text for _, text in codec.there_and_back(texts)] == [own.decode(own.encode(t)) for t in texts]


def test_decode_of_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (None, [300, 301])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in sentencepiece_codec.sentencepiece_decode(rows, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got[1] is None and got[2] == "" and got[None]


def test_unigram_model_is_rebuilt():
    import sentencepiece

    blob = small_unigram()
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=blob), sentencepiece_codec.Codec(blob, 1, False)
    texts = ["abcd", "ab cd e", "abcabc  dé", "", "xyz"]
    assert codec.encode(texts) == [own.encode(t) for t in texts]
    assert [codec.decode(x) for x in codec.encode(texts)] == texts


def test_new_pieces_cost_one_tokenisation():
    """Only pieces with bytes go to the decoder; the others are joined from what it made of each id."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        blob = f.read()
    own, codec, decoded = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(blob, 1, False), []

    class Told:
        def __init__(self, library):
            self.library = library

        def __getattr__(self, name):
            if name.startswith("decode"):
                decoded.append(name)
            return getattr(self.library, name)

    for name in {"tokenizer", "pieces"} & vars(codec).keys():
        setattr(codec, name, Told(getattr(codec, name)))
    plain = [" ".join(f"{a}{b}orn{a}" for b in "aeiou") + ", <0x41> <s> <unk> end." for a in "bdfgklmnprst"]
    assert [list(x) for x in zip(*codec.there_and_back(plain))] == [own.encode(plain), plain] and not decoded
    mixed = ["two\nlines\n\n", "\0 and \0\0x", "😀😀 á̈\u2028x", "\t", " ▁ lead", "", "\ufffd \U0010ffff"]
    assert [list(x) for x in zip(*codec.there_and_back(mixed))] == [own.encode(mixed), [t.replace("▁", " ") for t in mixed]] and decoded


def test_words_are_met_once_whatever_mark_follows():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        blob = f.read()
    own, codec, rnd = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(blob, 1, False), random.Random(5)
    codec.encode(["one hamlet, one hamlet. one hamlet; a hamlet: hamlet\nhamlet!"])
    assert sum("hamlet" in p for p in codec.met) == 2  # with a space before it and without
    texts = ["".join(rnd.choice(["a", "th", "ing", "é", "1", "好", " ", " ", "\n", ".", ",", "'", "’s", "”", "…", "(", ")", "\"", "-", "—", "²", "\\", "\t", "_", "://"]) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    assert codec.encode(texts) == own.encode(texts)
    assert [text for _, text in codec.there_and_back(texts)] == texts


@pytest.mark.parametrize("room", [0, 1 << 20])
def test_pieces_that_decode_to_something_else(room):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = sentencepiece_codec.parse_model(small_unigram())
    kept = pb.ModelProto()
    kept.CopyFrom(model)
    del kept.pieces[:]
    kept.pieces.extend(p for p in model.pieces if p.type != sentencepiece_codec.BYTE)
    kept.trainer_spec.byte_fallback = False
    blob = kept.SerializeToString()
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=blob), sentencepiece_codec.Codec(blob, 1, False, room=room)
    texts = ["ab xx cd", "xyz", "ab", "cd  x,,ab", "", "ab xx cd xx"]
    assert codec.cut and [list(x) for x in zip(*codec.there_and_back(texts))] == [own.encode(texts), own.decode(own.encode(texts))]


def brute_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, covered = collections.Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(spark, docs):
    got = quality_rules.quality_rules(docs)
    assert by_rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(((r.doc_id, *brute_base(r.text)) for r in docs.collect()), key=repr)
    assert all(not (r.base_failed and r.kept) for r in got.collect())
    junk = spark.createDataFrame([(i, " ".join(f"the{j * i}" + ("#$%&" if i == 0 else "") for j in range(90)), "en") for i in range(12)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(junk, char_limit=0.2, min_reference=0).where("doc_id <> 0 OR NOT kept").collect()}[0] is False
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []


def brute_distances(rows, min_reference):
    """(char, word) distance of each (text, lang) to the other documents of its language, and the verdict."""
    import math

    def histogram(text):
        classes = [sum(c in members for c in text) for members in quality_rules.CLASSES.values()]
        words = [w.lower() for w in WORD.findall(text)]
        return [*classes, len(text) - sum(classes)], [words.count(w) for w in quality_rules.COMMON_WORDS], len(words)

    def distance(a, b):
        a, b = ([x / max(1, sum(v)) for x in v] for v in (a, b))
        half = lambda p, q: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(p, q) if x)
        return math.sqrt(max(0.0, (half(a, b) + half(b, a)) / 2))

    found = [(*histogram(t or ""), lang, brute_base(t)[-1]) for t, lang in rows]
    for i, (chars, commons, n, lang, failed) in enumerate(found):
        others = [x for j, x in enumerate(found) if j != i and x[3] == lang and not x[4]]
        n_others = sum(x[2] for x in others)
        if n < 50 or n_others < min_reference:
            yield None, None, not failed
            continue
        add = lambda k: [sum(x[k][b] for x in others) for b in range(len(found[0][k]))]
        c, w = distance(chars, add(0)), distance([*commons, n - sum(commons)], [*add(1), n_others - sum(add(1))])
        yield round(c, 6), round(w, 6), not failed and c <= quality_rules.CHAR_LIMIT and w <= quality_rules.WORD_LIMIT


def test_distances_and_verdict(spark):
    import random

    rnd = random.Random(3)
    words = ["the", "of", "And", "que", "rivers", "Ünï", "walk", "don't", "12", "#$", "la", "tree."]
    rows = [(" ".join(rnd.choices(words[: 4 + i % 9], k=rnd.randint(0, 150))), rnd.choice(["en", "fr", None])) for i in range(60)]
    rows += [("#$%& " * 80, "en"), (" ".join(f"zx{i}q" for i in range(90)), "fr"), (None, "en"), ("alone " + " ".join(f"w{i}" for i in range(60)), "xx")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    for least in (0, 1500):
        got = sorted(quality_rules.quality_rules(df, min_reference=least).selectExpr("doc_id", "round(char_distance, 6)", "round(word_distance, 6)", "kept").collect())
        want = list(brute_distances(rows, least))
        assert [tuple(r)[1:] for r in got] == [tuple(pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in w) for w in want]
        assert {w[2] for w in want} == {True, False}


def test_licences(spark, docs):
    mit = licence_scan.TEMPLATES["MIT"][2]
    rows = spark.createDataFrame([(1, "text\nReleased under the  MIT licence.\nmore"), (2, "x\n" + mit.upper().replace("copy,", "copy, or")), (3, "Licensed under CC BY-NC 4.0."), (4, "nothing of the kind here"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licence_scan.licence_scan(rows, threshold=0.5).collect()}
    assert got[1].best_licence == "MIT" and got[2].best_licence == "MIT" and got[3].best_licence == "CC-BY-NC-4.0" and got[4].n_matches == 0 and got[5].best_dice is None
    assert licence_scan.licence_scan(docs).count() == docs.count() and licence_scan.licence_scan(docs.limit(0)).collect() == []


def test_licences_at_exactly_the_threshold(spark):
    rows = spark.createDataFrame([(1, "It was released under the MIT License.\nSo was released under the MIT License."), (2, "a b c d e f g"), (3, "d e f g h i j")], "doc_id long, text string")
    got = {r.doc_id: r for r in licence_scan.licence_scan(rows).collect()}
    assert got[1].n_matches == 2 and got[1].best_dice >= 0.8
    # 9 bigrams against segments of 6: Dice 12 / 15
    got = {r.doc_id: r.n_matches for r in licence_scan.licence_scan(rows, templates={"X": ["a b c d e f g h i j"]}).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def brute_licences(text, threshold):
    """Matches by (licence, template): segments with their Dice, then all windows of words."""
    words = lambda s: re.findall("[a-z0-9]+", s.lower())
    grams = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:])}
    dice = lambda g, t: 2 * len(g & t) / (len(g) + len(t))
    n, best = 0, []
    w = words(text)
    for name, texts in licence_scan.TEMPLATES.items():
        for template in texts:
            t, most = grams(words(template)), int((2 - threshold) / threshold * (len(words(template)) - 1) + 1e-9) + 1
            segments = {*text.split("\n"), *re.split("\n[ \t]*\n", text), text}
            found = [d for s in segments if (d := dice(grams(words(s)), t)) >= threshold]
            inside = max((dice(grams(w[i:j]), t) for i in range(len(w)) for j in range(i + 2, min(len(w), i + most) + 1)), default=0)
            n += len(found) or int(inside >= threshold)
            best += [(-max([*found, inside]), name)] if found or inside >= threshold else []
    return n, ",".join(sorted({x for _, x in best})), min(best)[1] if best else None, round(-min(best)[0], 6) if best else None


def test_licences_inside_longer_segments(spark):
    mit, isc = licence_scan.TEMPLATES["MIT"][2].split(), licence_scan.TEMPLATES["ISC"][0].split()
    warranty = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED".split()
    wrapped = lambda w, mark: "\n".join(mark + " ".join(w[i : i + 9]) for i in range(0, len(w), 9))
    texts = [
        "This library is tiny and has no dependencies. Released under the MIT License. Patches are welcome.",
        "/*\n" + wrapped(mit, " * ") + "\n *\n" + wrapped(warranty, " * ") + "\n */\nint main() { return 0; }",
        "Some words before the notice\n" + wrapped(isc, "# ") + "\n#\n# and after it the program begins " + "with other words " * 9,
        "We ship it as is. It is free and very unencumbered software released into the public domain, and so on and on.\n" * 40,
        "Under the license of the public domain, the terms of the software are subject to the following: nothing of the kind.",
        "a b " * 3, "", "licensed under the apache license, version 2.0 " * 30,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licence_scan.licence_scan(rows).collect()}
    assert got[0][1:3] == ("MIT", "MIT") and got[1][2] == "MIT" and got[2][2] == "ISC" and got[4][0] == 0
    assert got == {i: brute_licences(t, 0.8) for i, t in enumerate(texts)}


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(all_docs, labels.where("doc_id % 4 <> 0"))
    got = quality_classifier.classify(all_docs, model).select("doc_id", "verdict.*").join(labels.withColumnRenamed("quality", "good").withColumnRenamed("toxic", "bad"), "doc_id").where("doc_id % 4 = 0")
    told = got.agg(F.avg(F.when((F.col("quality") >= 0.5) == (F.col("good") == 1), 1.0).otherwise(0.0)).alias("q"), F.avg(F.when((F.col("toxic") >= 0.5) == (F.col("bad") == 1), 1.0).otherwise(0.0)).alias("t")).first()
    assert told.q > 0.9 and told.t > 0.85


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.classify(docs, model)
    assert got.count() == docs.count() and got.where("verdict.kept").count() == docs.count()
    assert quality_classifier.classify(docs.limit(0), model).collect() == []
    with pytest.raises(ValueError):
        quality_classifier.classify(docs.withColumn("verdict", F.lit(1)), model)


def test_null_and_repeated_labels_and_repeated_ids(spark):
    texts = ["good prose here about rivers and trees"] * 30 + ["spam spam #$%& | | 000"] * 30
    rows = [(i, t + f" {i}", "en", "s") for i, t in enumerate(texts)] + [(3, "another text of the same id", "en", "s"), (None, "no id", "en", "s")]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = [(i, int(i < 30), 0) for i in range(60)] + [(5, 0, 1), (7, None, 0), (None, 1, 1), (900, 1, 1)]
    models = [quality_classifier.fit(some.repartition(n), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) for n in (1, 5)]
    assert models[0].lexicon == models[1].lexicon and all((models[0].weights[h] == models[1].weights[h]).all() for h in quality_classifier.HEADS)
    got = quality_classifier.classify(some, models[0]).collect()
    assert len(got) == len(rows) and {r.verdict.kept for r in got if r.doc_id is not None and r.doc_id < 30 and r.text.startswith("good")} == {True}


def test_posteriors_against_the_formulas(spark):
    """Moments, shrinkage and the move of each logit, again in plain Python."""
    import math
    import random

    rnd = random.Random(11)
    rows = [(i, f"h{i % 4}", f"h{i % 4}/{i % 3}", rnd.gauss((i % 4) - 1.5, 1.0), rnd.gauss(-2 + (i % 3), 1.0)) for i in range(200)] + [(200, None, None, 0.5, -0.5)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, logit_quality double, logit_toxic double")
    sites, fixed = quality_classifier.site_posteriors(scored, "host", "path")
    for k, head in enumerate(quality_classifier.HEADS):
        p = [1 / (1 + math.exp(-r[3 + k])) for r in rows]
        mean = sum(p) / len(p)
        assert fixed[f"mean_{head}"] == pytest.approx(mean)
        group = lambda at: {key: [x for x, r in zip(p, rows) if r[at] == key] for key in {r[at] for r in rows}}  # noqa: E731, B023
        hosts, paths = group(1), group(2)
        up = {r[2]: sum(hosts[r[1]]) / len(hosts[r[1]]) for r in rows}
        for level, cells in (("host", [(v, mean) for v in hosts.values()]), ("path", [(v, up[key]) for key, v in paths.items()])):
            ss = sum(len(v) * (sum(v) / len(v) - m) ** 2 for v, m in cells)
            noise, weight = sum(m * (1 - m) for _, m in cells), sum(len(v) * m * (1 - m) for v, m in cells)
            spread = max(0.0, ss - noise) / weight
            assert fixed[f"{level}_strength_{head}"] == pytest.approx(min(1e6, max(1.0, 1 / spread - 1 if spread > 1e-6 else 1e6)))
        for r in sites.collect():
            assert r[f"sum_{head}"] == pytest.approx(sum(paths[r.path])) and r[f"host_{head}"] == pytest.approx(sum(hosts[r.host])) and r.n == len(paths[r.path])


def test_sparse_sites_shrink(spark):
    rows = [(f"h{i % 3}", f"h{i % 3}/en", 3.0, -3.0) for i in range(300)] + [("rare", "rare/en", -3.0, -3.0)] + [("bad", "bad/en", -3.0, -3.0)] * 100
    scored = spark.createDataFrame(rows, "host string, path string, logit_quality double, logit_toxic double")
    sites, fixed = quality_classifier.site_posteriors(scored, "host", "path")
    k, mean = fixed["host_strength_quality"], fixed["mean_quality"]
    post = {r.host: (r.host_quality + k * mean) / (r.host_n + k) for r in sites.collect()}
    assert post["bad"] < post["rare"] < mean < post["h0"]


@pytest.mark.parametrize("kind", ["tokenizers"])
def test_special_strings_are_found(kind):
    data = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    assert token_counts.special_strings(data).search(b"a<|endoftext|>")
