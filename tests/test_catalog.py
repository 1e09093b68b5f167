import duckdb
import numpy as np
import pytest

from loomset import catalog

SF = "/root/testdata/sf0.001"


def test_name_phrases_of_every_part(spark):
    got = {r.p_partkey: r for r in catalog.QUERIES["name_phrases"](spark, SF).collect()}
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert got.keys() == names.keys()
    for key, name in names.items():
        assert got[key].secret == ("********" if len(name) < 12 else f"{name[:4]}...{name[-4:]}")
        assert got[key].subject == (f"character {name}", name, "the character")[key % 3]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS FROM '{SF}/part.parquet'")
    assert {tuple(r) for r in got.values()} == set(db.execute(catalog.SQL["name_phrases"]).fetchall())


@pytest.mark.parametrize("name", ["mask_overlap", "mask_runs"])
def test_pixels_at_the_limits_of_masks(spark, tmp_path, name):
    """Floats at and beside the limits, missing pixels and pixels beyond the 64: the SQL's decimal limits are floats there."""
    rng, limits = np.random.default_rng(3), np.float32([0.05, 0.1, 0.15, 0])
    near = np.concatenate([limits, np.nextafter(limits, np.float32(1)), np.nextafter(limits, np.float32(-1)), np.float32([-0.3, 0.4])])
    rows = [(k, rng.choice(near, 64).tolist(), 0) for k in range(200)]
    rows += [(200, None, 0), (201, [], 0), (202, [0.4] * 5, 0), (203, [0.4] * 70, 0), (204, [None, 0.4] * 32, 0), (205, [float("nan"), -0.3] * 32, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(got, key=lambda r: r[0]) == sorted(db.execute(catalog.SQL[name]).fetchall(), key=lambda r: r[0])
