"""Named queries over a folder of tables, each with the SQL another engine can check it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double so that two engines agree beyond the last bits; -0.0 becomes 0.0.

    A small nudge keeps decimal ties (frequent in cents) off the rounding boundary.
    """
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        d = special.get(name, digits)
        out.append((F.round(c + float(f"1.37e-{d + 1}"), d) + F.lit(0.0)).alias(name) if kind == "double" else c)
    return df.select(*out)


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- SQL text helpers -------------------------------------------------------------------------------------------------

def r(expr: str, digits: int = 6) -> str:
    return f"(round(cast({expr} as double)+1.37e-{digits + 1},{digits})+0.0)"


def over(keys: str = "ticker", order: str = "date", frame: str = "") -> str:
    return f"over (partition by {keys} order by {order} {frame})"


def trail(p: int, shift: int = 0) -> str:
    end = "current row" if shift == 0 else f"{shift} preceding"
    return f"rows between {p - 1 + shift} preceding and {end}"


def full(agg: str, x: str, p: int, shift: int = 0, keys: str = "ticker", order: str = "date") -> str:
    o = over(keys, order, trail(p, shift))
    return f"(case when count({x}) {o}={p} then {agg}({x}) {o} end)"


def lag(x: str, n: int = 1, keys: str = "ticker", order: str = "date") -> str:
    return f"lag({x},{n}) {over(keys, order)}"


def ret(x: str, p: int, shift: int = 0, keys: str = "ticker", order: str = "date") -> str:
    top = x if shift == 0 else lag(x, shift, keys, order)
    return f"({top}/{lag(x, p + shift, keys, order)}-1)"


def ctes(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"


def ewm(name: str, src: str, specs, keys=("ticker",)) -> str:
    """Recursive CTE: exponentially weighted means of ``src`` (columns keys, rn from 0, and the sources)."""
    ks = ", ".join(f"s.{k}" for k in keys)
    first = ", ".join(f"cast(s.{x} as double) as {o}" for x, _, o in specs)
    step = ", ".join(
        f"case when e.{o} is null then s.{x} else e.{o}*(1-{a!r})+s.{x}*{a!r} end" for x, a, o in specs)
    same = " and ".join(f"s.{k}=e.{k}" for k in keys)
    return (f"{name} as (select {ks}, s.rn, {first} from {src} s where s.rn=0 union all "
            f"select {ks}, s.rn, {step} from {name} e join {src} s on {same} and s.rn=e.rn+1)")
