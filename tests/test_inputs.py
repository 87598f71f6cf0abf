from checks import inputs
from checks.queries import QUERIES


def test_citations_are_parsed_once_each_not_for_every_line_item(spark, tmp_path):
    spark.createDataFrame([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    items = [(i, i % 7 + 1, float(i % 50 + 1)) for i in range(500)]
    kinds = "l_orderkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(items, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["validate_address"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan and "Aggregate [raw" not in plan
    want = set()
    for key, number, quantity in items:
        if key % 5 < 2 and number * 3 <= 12:
            end = f"-{int(quantity) + 2}" if number % 2 == 0 else ""
            want.add(f"{('AFRICA', 'ASIA')[key % 5]} {number * 3}:{int(quantity)}{end}")
    assert sorted(r.query_id for r in found.collect()) == sorted(want)
    asked = [r.raw for r in inputs.citations(spark, str(tmp_path)).collect()]
    assert len(asked) == len(set(asked))
