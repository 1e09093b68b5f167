import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_stream_agrees_with_one_batch(spark):
    sf = "/root/testdata/sf0.001"
    queries = entry.queries()
    stream = {(r.doc_id, r.caption) for r in queries["incremental_caption"](spark, sf).collect()}
    assert stream == {(r.doc_id, r.caption) for r in queries["finalize_prose"](spark, sf).collect()}
