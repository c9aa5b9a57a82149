"""Rows that the generated tables rarely or never hold."""

import __spark_entry__ as entry
from tideline.operators import reports
from tools.check_queries import compare, connect


def test_identical_histories_need_a_status(spark, tmp_path):
    """Customers without orders, or without any status, equal nobody; keys may be long or negative."""
    folder = str(tmp_path / "t")
    orders = [(1, 7, "F"), (2, 7, "O"), (3, 8, "O"), (4, 8, "F"), (5, -3, "F"), (6, -3, "O"), (7, 10**13, "P"), (8, 10**13 + 5, "P"),
              (9, 20, None), (10, 21, None), (11, 22, None), (12, 22, "P"), (13, 23, "P"), (14, 23, None), (15, 24, "P"), (None, 24, "P"), (16, 25, "P"), (17, 25, "P")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    keys = [7, 8, -3, 10**13, 10**13 + 5, 20, 21, 22, 23, 24, 25, 100, 101, 102]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(f"{folder}/customer.parquet")
    con = connect(folder)
    for t in ("orders", "customer"):
        con.execute(f"create or replace view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    name = "dq_identical_files"
    status, _, _, detail = compare(spark, con, folder, name, entry.queries()[name], entry.oracle_sql()[name])
    assert (status, detail) == ("ok", "5 rows"), detail


def test_interval_text_is_rounded_once(spark):
    values = [-2.29496, 2.29496, 0.125, 0.375, 1.005, 0.00499999, -0.001, 1234567.125, 0.0, None]
    stats = spark.createDataFrame([(i, "strategy_sharpe", v, v, v, "ok") for i, v in enumerate(values)],
                                  "ticker int, statistic string, estimate double, ci_low double, ci_high double, status string")
    for digits in (2, 4):
        rows = sorted(reports.interval_table(stats, ["ticker"], digits=digits).collect())
        want = ["—" if v is None else f"{v:.{digits}f}" for v in values]
        assert [r.estimate for r in rows] == want
        assert [r.interval for r in rows] == ["Not estimated" if x == "—" else f"[{x}, {x}]" for x in want]
    scaled = stats.withColumn("statistic", stats.statistic.substr(1, 0)).fillna({"estimate": 0.0}).replace("", "annualized_mean_excess")
    assert [r.estimate for r in sorted(reports.interval_table(scaled, ["ticker"], digits=2).collect())] == [f"{(v or 0.0) * 100:.2f}%" for v in values]


def test_earlier_overlaps_broadcast_nothing(spark, folder):
    """What is counted grows with claims and observations, however small a plan takes it to be."""
    df = entry.queries()["exp_assessment"](spark, folder)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
