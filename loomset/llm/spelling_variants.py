"""Spelling variants of words by forward and backward minimal acyclic automata.

Two words are near if one inserted, deleted or replaced code point makes one the other. A word of ``l``
code points is cut in halves: the error is in one of them, so a near word holds the other one as it is.
What begins with the first half is found in the automaton of the words, what ends with the second half
in the automaton of the words read backwards; from the state that the half leads to, the rest is
completed with one error. Words are told by their number in the automaton's order (a perfect hash: the
words that sort before), and a word that both directions find counts once.

The dictionary grows with the corpus, so no task holds all of it. A word goes to the key of each half
that can find it: its first and its last half, as words of its own length, of one less and of one more
see them. Whole keys make blocks, and each block gets two automata of its own. A key of more than
``GROUP_WORDS`` words is cut further: the error is in one half of what the key leaves open, so each of
its words goes on under a key with the other half added, until one code point is left open.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import discard, materialize, numbered, small_batches, table

#: Words of a key that is not cut further, and of the keys that make a block.
GROUP_WORDS, BLOCK_WORDS = 4096, 16384
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]"


class Automaton:
    """The minimal acyclic automaton of words in their order, with each word's number in that order.

    A state is shared by all places with the same words ahead. Each edge knows how many words its state
    has that sort before those of the edge, so a word's number is the sum along its path.
    """

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.ahead: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]

        def settle(node: tuple[list[bool], dict[str, int]]) -> int:
            (final,), out = node
            state = known.setdefault((final, *out.items()), len(self.edges))
            if state == len(self.edges):
                before, edges = int(final), {}
                for label, to in out.items():
                    edges[label] = to, before
                    before += self.ahead[to]
                self.edges.append(edges)
                self.final.append(final)
                self.ahead.append(before)
            return state

        last = ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1][last[len(path) - 1]] = settle(node)
            path += [([False], {}) for _ in word[same:]]
            path[-1][0][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = settle(node)
        self.start = settle(path[0])

    def rest(self, state: int, number: int, ahead: str) -> Iterator[int]:
        """The number of the word that ``ahead`` ends at from ``state``, if there is one."""
        for c in ahead:
            step = self.edges[state].get(c)
            if step is None:
                return
            state, number = step[0], number + step[1]
        if self.final[state]:
            yield number

    def one_error(self, word: str, exact: int) -> Iterator[int]:
        """Numbers of the words that begin like ``word`` for ``exact`` code points and have one error after them; some twice."""
        state, number = self.start, 0
        for i in range(len(word) + 1):
            if i >= exact:
                for label, (to, before) in self.edges[state].items():
                    yield from self.rest(to, number + before, word[i:])
                    if i < len(word) and label != word[i]:
                        yield from self.rest(to, number + before, word[i + 1 :])
                if i < len(word):
                    yield from self.rest(state, number, word[i + 1 :])
            if i < len(word):
                step = self.edges[state].get(word[i])
                if step is None:
                    return
                state, number = step[0], number + step[1]


def found_in(rows: list[tuple], backward: bool) -> Iterator[tuple[int, int, int]]:
    """(number, near, n of near) for the rows (word, number, n, exact) of a block; those with no ``exact`` are only found."""
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    known = {turn(word): (number, n) for word, number, n, _ in rows}
    words = sorted(known)
    automaton = Automaton(words)
    for word, number, _, exact in rows:
        if exact is not None:
            for at in set(automaton.one_error(turn(word), exact)):
                near, n = known[words[at]]
                if near != number:
                    yield number, near, n


FOUND = "number long, near long, near_n long"


def searched(groups: DataFrame) -> DataFrame:
    """(number, near, near_n) from the words under each key; whole keys make a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            found = [x for backward in (False, True) for x in found_in([r[2:] for r in rows if r[1] == backward], backward)]
            columns = list(zip(*found, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "near", "near_n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BLOCK_WORDS and held[-1][0] != row[0]:
                    yield pack(held)
                    held = []
                held.append(row)
        yield pack(held)

    rows = groups.select("key", "backward", "word", "number", "n", F.when(F.col("length") == F.col("l"), F.when(F.col("backward"), F.col("tail")).otherwise(F.col("head"))).alias("exact"))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def keyed(words: DataFrame) -> DataFrame:
    """Each word under its key: the side that is exact, the length that looks for it, and its code points at head and tail."""
    head, tail = F.substring("word", F.lit(1), F.col("head")), F.expr("substring(word, length - tail + 1, tail)")
    return words.withColumn("key", F.xxhash64("backward", "l", "head", "tail", head, tail))


def halves(words: DataFrame) -> DataFrame:
    """The words under both halves, as they are seen by words of each length ``l`` that can be near."""
    out = words.withColumn("length", F.char_length("word")).withColumn("l", F.explode(F.expr("sequence(greatest(length - 1, 1), length + 1)"))).withColumn("backward", F.explode(F.array(F.lit(False), F.lit(True))))
    first = F.expr("l div 2").cast("int")
    return keyed(out.withColumns({"head": F.when(F.col("backward"), 0).otherwise(first), "tail": F.when(F.col("backward"), F.col("l") - first).otherwise(0)}))


def cut_further(groups: DataFrame) -> DataFrame:
    """The words of hot keys under longer keys: half of what is open is added to the head or to the tail."""
    open_ = F.col("l") - F.col("head") - F.col("tail")
    more = F.expr("(l - head - tail) div 2").cast("int")
    both = groups.withColumn("to_tail", F.explode(F.array(F.lit(False), F.lit(True))))
    both = both.withColumns({"head": F.when(F.col("to_tail"), F.col("head")).otherwise(F.col("head") + more), "tail": F.when(F.col("to_tail"), F.col("tail") + open_ - more).otherwise(F.col("tail")), "backward": F.col("to_tail")})
    return keyed(both.drop("to_tail"))


def near_words(words: DataFrame) -> DataFrame:
    """All pairs (number, near, near_n) of near words, each in both orders and once; ``words`` is a table (number, word, n) of distinct words."""
    small_batches(words.sparkSession)
    groups, found, spent = materialize(halves(words), "spelling-halves"), [], []
    while True:
        spent.append(groups)
        sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max((F.col("l") - F.col("head") - F.col("tail")).alias("open")).alias("open"), F.max(F.col("length") == F.col("l")).alias("asked"))
        sizes = materialize(sizes.where("size > 1 AND asked").select("key", ((F.col("size") > GROUP_WORDS) & (F.col("open") > 1)).alias("hot")), "spelling-sizes")
        spent.append(sizes)
        found.append(materialize(searched(groups.join(sizes.where("NOT hot"), "key", "left_semi")), "spelling-found"))
        hot = sizes.where("hot")
        if hot.isEmpty():
            break
        groups = materialize(cut_further(groups.join(hot, "key", "left_semi").drop("key")), "spelling-cut")
    out = materialize(reduce(DataFrame.unionByName, found).distinct(), "spelling-near")
    discard(*spent, *found)
    return out


def last_forms(forms: DataFrame) -> DataFrame:
    """(number, root) from (number, form): where following the forms ends. Each round doubles the way that is followed."""
    now = materialize(forms.select("number", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("number").alias("root"), F.col("root").alias("further"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        then = materialize(now.join(ahead, "root", "left").select("number", F.coalesce("further", "root").alias("root")), "spelling-roots")
        discard(now)
        now = then


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """One row per word of ``words`` (word, n): ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    ``form`` is the near word of largest n (of equal ones the first in code-point order), if its n is at
    least ``factor`` times the word's own; else null. ``root`` is where following the forms ends, the
    word itself without a form. A factor of 2 or more makes the ways short, and free of rings. Null words
    and null counts are left out, a repeated word's counts are summed, and other columns are not read. An
    empty table gives an empty result.
    """
    if factor < 2:
        raise ValueError("forms must be commoner by a factor of 2 or more")
    counted = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    listed = numbered(counted, [F.col("word")], "spelling-words")
    near = near_words(listed)
    best = near.groupBy("number").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct("near_n", -F.col("near"))).alias("best"))
    best = best.select("number", "n_near", (-F.col("best.col2")).alias("form"), F.col("best.near_n").alias("form_n"))
    own = listed.join(best, "number", "left").withColumn("formed", F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False)))
    own = materialize(own.select("number", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(F.col("formed"), F.col(c)).alias(c) for c in ("form", "form_n"))), "spelling-own")
    roots = last_forms(own.where("form IS NOT NULL"))
    name = lambda c: listed.select(F.col("number").alias(c), F.col("word").alias(f"{c}_word"))
    named = roots.join(own.select("number", "form"), "number").join(name("form"), "form").join(name("root"), "root").select("number", "form_word", "root_word")
    named = materialize(named, "spelling-named")
    out = own.select("number", "word", "n", "n_near", "form_n").join(named, "number", "left")
    out = materialize(out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"), "spelling-variants")
    discard(listed, near, own, roots, named)
    return out


def run_with_typo(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, less one code point where ``one_in`` divides the hash of id and run: misspellings that can be told anywhere."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % one_in == 0, less).otherwise(run)


def common_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, some misspelt by rule, of ``least_length`` code points and ``least_n`` occurrences in all texts.

    A null or empty text has no words; a null id counts as an empty one. Counts are combined in each task
    before the shuffle, so a very common word costs a row for each task.
    """
    runs = df.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select(run_with_typo(F.col("id"), F.translate("run", UPPER, LOWER), one_in).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(common_words(table(spark, sf_dir, "documents")))


def op11_sql() -> str:
    return r"""
    WITH RECURSIVE bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i))),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    keyed AS (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM keyed, bits),
    words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
    less AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
    near AS (
        SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, max(n) AS form_n FROM near GROUP BY word),
    formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 5 * w.n THEN b.form_n END AS form_n, (SELECT min(x.near) FROM near x WHERE x.word = w.word AND x.n = b.form_n AND b.form_n >= 5 * w.n) AS form FROM words w LEFT JOIN best b ON w.word = b.word),
    ways AS (SELECT word, word AS root, form AS ahead FROM formed UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN formed f ON w.ahead = f.word)
    SELECT f.word, f.form, w.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM formed f JOIN ways w ON f.word = w.word AND w.ahead IS NULL"""
