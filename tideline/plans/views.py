"""Price tables derived from the business tables, in Spark and as SQL text.

The folder holds no prices; these views shape its tables into daily bars,
quotes, observations and declarations. Each pair is the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import annualization
from ..session import cut_lineage
from ..sources.bars import bars_from_trades
from .registry import Tables

# --- daily bars of order prices: one ticker per priority --------------------------------------------------------------

SQL_BARS = """bars as materialized (select o_orderpriority as ticker, cast(o_orderdate as date) as date,
 arg_min(o_totalprice,o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
 arg_max(o_totalprice,o_orderkey) as close, cast(count(*) as double) as volume from orders group by 1,2)"""


def order_bars(t: Tables) -> DataFrame:
    o = t.orders
    return bars_from_trades(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


# --- volume-weighted bars of line items: smoother, one ticker per flag pair -------------------------------------------

def _vwap_sql(name: str, date: str) -> str:
    return f"""{name} as materialized (select l_returnflag||l_linestatus as ticker, {date} as date,
 avg(l_extendedprice/l_quantity) as open, max(l_extendedprice/l_quantity) as high, min(l_extendedprice/l_quantity) as low,
 sum(l_extendedprice)/sum(l_quantity) as close, sum(l_quantity) as volume from lineitem group by 1,2)"""


SQL_VWAP = _vwap_sql("vwap", "cast(l_shipdate as date)")
SQL_WEEKLY = _vwap_sql("weekly", "cast(date_trunc('week',l_shipdate) as date)")
SQL_ALIGNED = _vwap_sql("weekly_all", "cast(date_trunc('week',l_shipdate) as date)") + """,
weekly as materialized (select w.* from weekly_all w where date in (select date from weekly_all group by date
 having count(*)=(select count(distinct ticker) from weekly_all)))"""


def _vwap(t: Tables, date) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), date.cast("date").alias("date"),
                          unit.alias("u"), "l_extendedprice", "l_quantity")
        .groupBy("ticker", "date")
        .agg(F.avg("u").alias("open"), F.max("u").alias("high"), F.min("u").alias("low"),
             (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))
    )


def vwap_bars(t: Tables) -> DataFrame:
    return _vwap(t, F.col("l_shipdate")).withColumn("ann", annualization(F.col("ticker")))


def weekly_bars(t: Tables) -> DataFrame:
    return _vwap(t, F.date_trunc("week", "l_shipdate")).withColumn("ann", annualization(F.col("ticker")))


def aligned_weekly_bars(t: Tables) -> DataFrame:
    """Weeks in which every ticker traded: a portfolio needs identical dates. Stored once; a book reads them many times."""
    bars = cut_lineage(_vwap(t, F.date_trunc("week", "l_shipdate")))
    width = bars.select("ticker").distinct().agg(F.count(F.lit(1)).alias("width"))
    whole = bars.groupBy("date").agg(F.count(F.lit(1)).alias("n")).join(width, F.col("n") == F.col("width")).select("date")
    return bars.join(whole, "date", "left_semi").withColumn("ann", annualization(F.col("ticker")))


# --- raw quotes with defects ------------------------------------------------------------------------------------------

SQL_QUOTES = """quotes as materialized (select l_orderkey*10+l_linenumber as quote_id, l_returnflag||l_linestatus as ticker,
 cast(l_shipdate as date) as date, l_extendedprice/l_quantity as open,
 (l_extendedprice/l_quantity)*(1+l_tax-l_discount/4) as high, (l_extendedprice/l_quantity)*(1-l_discount) as low,
 case when l_discount=0 and l_tax=0 then 0.0 when l_discount=0.1 and l_tax=0 then null
      else (l_extendedprice/l_quantity)*(1+l_tax/2-l_discount/2) end as close,
 case when l_tax=0.08 then null else l_quantity*(l_tax-0.005) end as volume from lineitem)"""


def quotes(t: Tables) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    tax, disc = F.col("l_tax"), F.col("l_discount")
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("quote_id"),
        F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
        unit.alias("open"), (unit * (1 + tax - disc / 4)).alias("high"), (unit * (1 - disc)).alias("low"),
        F.when((disc == 0) & (tax == 0), 0.0).when((disc == 0.1) & (tax == 0), None)
        .otherwise(unit * (1 + tax / 2 - disc / 2)).alias("close"),
        F.when(tax == 0.08, None).otherwise(F.col("l_quantity") * (tax - 0.005)).alias("volume"),
    )


# --- declarations: one asset per customer ----------------------------------------------------------------------------

SQL_ASSETS = """assets as materialized (select replace(c_name,'#','-') as ticker,
 case when c_nationkey<5 then 'EUR' else 'USD' end as currency,
 case when c_mktsegment='MACHINERY' then 'continuous' else 'exchange' end as calendar,
 case when c_mktsegment='MACHINERY' then 365.0 else 252.0 end as annualization,
 case when c_acctbal<0 then 'unadjusted' when c_acctbal<3000 then 'split_adjusted'
      else 'split_and_dividend_adjusted' end as price_adjustment, c_custkey from customer)"""


def assets(t: Tables) -> DataFrame:
    always = F.col("c_mktsegment") == "MACHINERY"
    return t.customer.select(
        F.regexp_replace("c_name", "#", "-").alias("ticker"),
        F.when(F.col("c_nationkey") < 5, "EUR").otherwise("USD").alias("currency"),
        F.when(always, "continuous").otherwise("exchange").alias("calendar"),
        F.when(always, 365.0).otherwise(252.0).alias("annualization"),
        F.when(F.col("c_acctbal") < 0, "unadjusted").when(F.col("c_acctbal") < 3000, "split_adjusted")
        .otherwise("split_and_dividend_adjusted").alias("price_adjustment"),
        "c_custkey",
    )


# --- dated rates: one change per quarter, from the average discount of the quarter ------------------------------------

SQL_RATES = """rates as materialized (select cast(date_trunc('quarter',l_shipdate) as timestamp) as effective_at,
 round(avg(l_discount),6) as value from lineitem group by 1)"""


def rates(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.date_trunc("quarter", "l_shipdate").alias("effective_at")).agg(
        F.round(F.avg("l_discount"), 6).alias("value"))


# --- observations and claims on date ranges --------------------------------------------------------------------------

SQL_OBSERVATIONS = """observations as materialized (select o_orderkey as event_id, o_orderpriority as ticker,
 cast(o_orderdate as date) as start_date, cast(o_orderdate as date)+cast(floor(o_totalprice/10000) as integer) as end_date,
 o_custkey as run_id, o_orderstatus as kind from orders)"""
SQL_CLAIMS = """claims as materialized (select o_custkey*10+cast(substr(o_orderpriority,1,1) as bigint) as claim_id,
 o_custkey as batch_id, o_orderpriority as ticker, cast(max(o_orderdate) as date)-30 as start_date,
 cast(max(o_orderdate) as date) as end_date from orders group by o_custkey, o_orderpriority)"""


def observations(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("ticker"), day.alias("start_date"),
        F.date_add(day, F.floor(F.col("o_totalprice") / 10000).cast("int")).alias("end_date"),
        F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("kind"))


def claims(t: Tables) -> DataFrame:
    """The last month of every customer's orders per priority; a customer's claims form one batch."""
    last = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderdate").cast("date").alias("end_date"))
    return last.select(
        (F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("bigint")).alias("claim_id"),
        F.col("o_custkey").alias("batch_id"), F.col("o_orderpriority").alias("ticker"),
        F.date_sub("end_date", 30).alias("start_date"), "end_date")
