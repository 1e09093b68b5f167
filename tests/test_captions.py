from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import choices, dedupe, lint, quality, selection, tags
from loomset.plans import shots


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first().x


def pairs(spark, rows):
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(rows)], "ord long, image string, caption string")


def test_lint_counts(spark):
    rows = pairs(spark, [("a.jpg", "qx7 on a ferry at noon"), ("b.jpg", "\t"), ("c.jpg", "QX7"), ("d.jpg", "two herons by the weir"), ("e.jpg", None)])
    got = lint.summary(rows, trigger=" qx7 ").first()
    assert (got.total, got.n_empty, got.n_short, got.n_missing_trigger, got.clean) == (5, 2, 1, 1, False)
    assert {(r.check, r.image) for r in lint.findings(rows, trigger=" qx7 ").collect()} == {("empty", "b.jpg"), ("empty", "e.jpg"), ("short", "c.jpg"), ("missing_trigger", "d.jpg")}


def test_duplicates_ignore_case_and_space(spark):
    got = lint.duplicate_groups(pairs(spark, [("a", "dry dock"), ("b", "kite\nover dunes"), ("c", " "), ("d", "KITE over  Dunes"), ("e", None), ("f", "kite over dunes "), ("g", "z" * 70), ("h", "Z" * 70)])).collect()
    assert sorted((r.first_ord, r.n, r.preview) for r in got) == [(1, 3, "kite over dunes"), (6, 2, "z" * 57 + "…")]


def test_tags_and_prose(spark):
    prose = pairs(spark, [("a", "three goats climb the quarry wall while rain comes in"), ("b", "an empty tram waits under the northern bridge")])
    assert lint.segment_stats(prose).first().kind == "prose"
    tagged = pairs(spark, [("a", "qx7, Hat, red scarf"), ("b", "hat, qx7"), ("c", "red  scarf, qx7, hat, RED SCARF")])
    assert lint.segment_stats(tagged).first().tags
    assert {r.tag: r.n for r in lint.tag_frequency(tagged, "qx7").collect()} == {"hat": 3, "red scarf": 2}
    assert lint.segment_stats(pairs(spark, [("a", " , ")])).first().kind == ""


def test_ubiquitous_needs_enough_captions(spark):
    five = pairs(spark, [(str(i), "qx7, fog, n%d" % i if i < 4 else "qx7, sun") for i in range(5)])
    assert lint.ubiquitous_tags(five, "qx7", 0.9).collect() == []
    assert [(r.tag, r.n) for r in lint.ubiquitous_tags(five, "qx7", 0.8).collect()] == [("fog", 4)]
    assert lint.ubiquitous_tags(five.limit(3), "qx7", 0.1).collect() == []


def test_gated_checks_only_for_tags(spark):
    long_tags = pairs(spark, [("a", ", ".join(f"t{i}" for i in range(90)))])
    assert lint.gated(long_tags).first().n_too_long == 1
    long_prose = pairs(spark, [("a", "word " * 200)])
    assert lint.gated(long_prose).first().n_too_long == 0


def test_caption_text(spark):
    assert one(spark, T.tag_list, " Low Tide.,,wet  sand\nlow tide , ..Gulls..") == ["low tide", "wet sand", "gulls"]
    assert one(spark, T.tag_list, ",\n, x") == ["x"]
    assert one(spark, lambda c: T.finalize_tags(c, "Qx7"), "oak, qX7, elm") == "Qx7, oak, elm"
    assert one(spark, lambda c: T.finalize_tags(c, "Qx7"), " , ") == "Qx7"
    assert one(spark, lambda c: T.finalize_tags(c, ""), "Oak, elm") == "oak, elm"
    prose = one(spark, lambda c: T.finalize_prose(c, "qx7", "Mira Voss", ("diver",)), "The diver mends a net.")
    assert prose == "qx7, Mira Voss mends a net."
    assert one(spark, lambda c: T.finalize_prose(c, "q", "Bo\\$2", ("clerk",)), "Ask THE CLERK") == "q, ask Bo\\$2"
    assert one(spark, lambda c: T.finalize_prose(c, "q", "Bo", ("clerk",), "style"), "Ask the clerk") == "q, ask the clerk"
    assert one(spark, lambda c: T.finalize_prose(c, "t"), "") == "t"
    assert one(spark, T.clean_output, 'Sure! <think>so\nand so</think>"two boats"') == "two boats"
    assert one(spark, lambda c: T.drop_tags(c, T.parse_drop_list("Wet Sand.\nlogo"), "tags"), "logo, wet_sand, gulls, LOGO") == "logo, gulls"
    assert one(spark, lambda c: T.affixes(c, " best, ", ", ", "e621"), "oak") == "best, oak"
    assert one(spark, T.slugify, "--Mira  Voss #2") == "mira-voss-2" and one(spark, T.slugify, "é") == "character"
    assert one(spark, T.normalize_suffix, ".JPEG") == ".jpg" and one(spark, T.normalize_suffix, None) == ".png"
    assert one(spark, T.subject_phrase, "THE old tram") == "old tram" and one(spark, T.lower_first, "VHS tape") == "VHS tape" and one(spark, T.lower_first, "Ink wash") == "ink wash"
    assert one(spark, T.clip_tokens, "a, b c") == 4 + 1 + 2
    assert one(spark, T.words, "a b　c\x1fd") == ["a", "b", "c", "d"]


LABELS = [("wet_sand", 0, 0.41), ("gulls", 0, 0.77), ("fog", 0, 0.34), ("mira_voss", 4, 0.99), ("bo", 4, 0.6), ("calm", 9, 0.7), ("stormy", 9, 0.7), ("o_o", 0, 0.36)]


def test_choices(spark):
    style = lambda key, own: spark.sql(f"SELECT '{key}' AS k, '{own}' AS o").select(choices.shot_style(F.col("k"), F.col("o"), ("match", "ink", "custom")).alias("s")).first().s
    assert tuple(style(" INK", "x")) == ("ink", "") and tuple(style("custom", "Wet  clay..")) == ("custom", "Rendered as wet clay.") and tuple(style("custom", " ")) == ("match", "") and tuple(style("oil", "x")) == ("match", "")
    assert [one(spark, choices.plan_key, x) for x in ("style", "concept", "character", "boat", None)] == [None, "concept", "character", "character", "character"]
    assert [one(spark, choices.output_folder, x) for x in ('"C:/out put"', "out|put", "ab:c", " ", "x\ny", None, "/tmp/x")] == ["C:/out put", None, None, None, None, None, "/tmp/x"]
    assert one(spark, lambda c: choices.filled(c, F.lit("new")), "  ") == "new" and one(spark, lambda c: choices.filled(c, F.lit("new")), " old ") == "old"
    assert one(spark, lambda c: choices.known(c, ("tags", "prose")), " Tags ") == "tags" and one(spark, lambda c: choices.known(c, ("tags",)), "x") is None
    assert one(spark, lambda c: choices.caption_steps(c, "prose", "q", "Bo", ("clerk",), prefix="hi", suffix="end"), "The clerk reads") == "hi q, Bo reads end"
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "of long, name string").selectExpr("of", "name", "name AS value", "1 AS ord")
    wanted = spark.createDataFrame([(1, "b"), (2, "z"), (3, "a")], "t long, k string")
    assert {r.t: r.preset for r in choices.preset(wanted, "t", "k", rows).collect()} == {1: "b", 2: "a", 3: None}
    checks = spark.createDataFrame([], "name string, ok boolean")
    assert tuple(choices.report(checks).first()) == (True, 0)


def test_unused_until_now(spark):
    assert one(spark, T.terms, " a ,, b,") == ["a", "b"]
    assert one(spark, lambda c: quality.is_blurry(c.cast("double")), "99.9") and not one(spark, lambda c: quality.is_blurry(c.cast("double")), "100")
    assert one(spark, lambda c: selection.caption_fit(c, F.lit(True)), "prose") != "" and one(spark, lambda c: selection.caption_fit(c, F.lit(True)), "tags") == ""
    lit = F.lit
    assert one(spark, lambda c: shots.local_prompt(lit("pose"), c, lit("a quay"), lit("calm"), lit("an oilskin"), lit("the diver"), "ink"), "sitting") == "the same diver, sitting, wearing an oilskin, a quay, calm mood, ink, consistent identity"
    assert one(spark, lambda c: shots.cloud_prompt(lit("the diver"), lit("pose"), c, lit("a quay"), lit("eager"), lit(""), "Ink."), "sitting").endswith("detail, sitting, a quay, with an eager expression. Ink.")


def test_near_groups_are_the_greedy_cover(spark):
    import random

    rnd = random.Random(7)
    hashes = [rnd.choice([0, 1, 3, 7, 15, 31, 63]) << rnd.choice([0, 0, 8, 40]) for _ in range(60)] + [5] * 300 + [-1, -2]
    rnd.shuffle(hashes)
    rows = spark.createDataFrame([*enumerate(hashes), (999, None)], "ord long, hash long")
    for distance in (0, 1, 3):
        taken, want = set(), set()
        for i, h in enumerate(hashes):
            if i not in taken:
                own = [j for j in range(i, len(hashes)) if j not in taken and bin((h ^ hashes[j]) & (2**64 - 1)).count("1") <= distance]
                taken |= set(own)
                want |= {(i, j) for j in own} if len(own) > 1 else set()
        assert {tuple(r) for r in dedupe.near_groups(rows, distance).collect()} == want
    assert dedupe.near_groups(rows.limit(0)).collect() == [] and dedupe.near_pairs(rows, 3).count() <= len(set(hashes)) ** 2


def test_tags_from_labels(spark):
    rows = spark.createDataFrame([("i", k, *x) for k, x in enumerate(LABELS)], "image string, idx int, name string, category int, prob double")
    assert tags.select_tags(rows).first().tags == ["gulls", "wet_sand", "o_o", "mira_voss"]
    assert tags.select_rating(rows).first().rating == "calm"
    assert tags.tag_captions(rows, rating=True).first().caption == "gulls, wet sand, o_o, mira voss, calm"
    assert tags.select_rating(rows, "e621").collect() == []
