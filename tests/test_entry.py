import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 60 and set(oracles) <= set(queries)
    df = entry.entry(spark)
    assert df.columns == ["clone_id", "n_hits", "sum_count"] and df.count() > 0
