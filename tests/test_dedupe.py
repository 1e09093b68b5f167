import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomset.operators import dedupe


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(rnd, x, n, bits=64):
    for spot in rnd.sample(range(bits), n):
        x ^= 1 << spot
    return x


def table(spark, hashes):
    return spark.createDataFrame([(i, None if h is None else signed(h)) for i, h in enumerate(hashes)], "ord long, hash long")


def brute(hashes, distance):
    first = {}
    for i, h in enumerate(hashes):
        if h is not None:
            first.setdefault(h, [i, 0])[1] += 1
    known = sorted((i, n, h) for h, (i, n) in first.items())
    return sorted((a, n, b, m, (x ^ y).bit_count()) for (a, n, x), (b, m, y) in combinations(known, 2) if (x ^ y).bit_count() <= distance)


@pytest.mark.parametrize("distance, bits, hot", [(0, 64, 1 << 20), (1, 64, 1), (5, 64, 1 << 20), (5, 64, 3), (12, 64, 1 << 20), (7, 56, 2), (3, 8, 1 << 20), (12, 30, 5)])
def test_pairs_equal_all_comparisons(spark, distance, bits, hot):
    rnd = random.Random(distance * 100 + bits + hot)
    seeds = [rnd.getrandbits(bits) for _ in range(25)] + [0, (1 << bits) - 1]
    hashes = seeds + [flipped(rnd, rnd.choice(seeds), rnd.randint(0, min(bits, distance + 2)), bits) for _ in range(120)] + [None, seeds[0], seeds[0]]
    rnd.shuffle(hashes)
    assert sorted(map(tuple, dedupe.near_pairs(table(spark, hashes), distance, bits, hot).collect())) == brute(hashes, distance)


def test_bands_leave_no_pair_out():
    for bits, distance, parts in ((64, 5, 3), (64, 12, 3), (56, 7, 2), (43, 5, 2), (20, 3, 4)):
        bands = dedupe.plan_bands([(0, bits)], distance, parts)
        assert sum(radius + 1 for _, _, radius in bands) == distance + 1 and sum(w for _, w, _ in bands) <= bits
    assert dedupe.plan_bands([(0, 10), (20, 10)], 1, 2) == [([(0, 10)], 10, 0), ([(20, 10)], 10, 0)]
    assert len(dedupe.ball(21, 2)) == 1 + 21 + 210


def test_candidates_grow_far_below_all_pairs(spark):
    rnd = random.Random(7)
    for n in (2000, 16000):
        known = dedupe.classes(table(spark, [rnd.getrandbits(64) for _ in range(n)]))
        assert dedupe.near_candidates(known, 5).count() < n  # of n * n / 2 pairs


def test_a_shared_plain_part_is_no_square(spark):
    """A third of the classes agree in a whole band, as pictures with the same sky do."""
    rnd, n = random.Random(8), 6000
    hashes = [rnd.getrandbits(40) << 24 if i % 3 == 0 else rnd.getrandbits(64) for i in range(n)]
    known = dedupe.classes(table(spark, hashes))
    assert dedupe.near_candidates(known, 5, hot_pairs=10_000).count() < 4 * n
    assert dedupe.near_candidates(known, 5, hot_pairs=1 << 40).count() > 100 * n


def test_empty_and_null_hashes(spark):
    none = table(spark, [None, None])
    assert dedupe.near_pairs(none).collect() == [] and dedupe.near_groups(none).collect() == []
    assert dedupe.near_pairs(none.limit(0)).collect() == []
    assert dedupe.near_groups(table(spark, [5, 5, 4, None])).orderBy("member").collect() == [(0, 0), (0, 1), (0, 2)]
    assert dedupe.near_pairs(table(spark, [1, 2]).withColumn("n", F.lit("clash"))).count() == 1
