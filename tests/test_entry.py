import __spark_entry__ as entry


def test_registry_is_whole():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {f"p{n}_found" for n in (1, 2, 4, 6)} <= set(queries)
    if entry.llm:
        assert {f"p{n}_found" for n in (3, 5, 7, 9)} | {"p8_mix"} <= set(queries)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["src_table", "src_id", "verdict", "ref_month"]
