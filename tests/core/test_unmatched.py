"""Set difference of two tables by id."""

import pandas as pd

import __spark_entry__ as entry


def test_unmatched_ids_are_met_in_parts_that_stay_small(spark, tmp_path):
    """Rows are dealt into as many parts as the session's shuffles have, which adaptive execution does not join."""
    pd.DataFrame({"o_orderkey": [1, 2, 2, 3]}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"l_orderkey": [3, 4, 4, 5]}).to_parquet(tmp_path / "lineitem.parquet")
    found = entry.queries()["f10_unmatched"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("lineitem", 4), ("lineitem", 5), ("orders", 1), ("orders", 2), ("orders", 2)]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
