"""Ledgers and books against naive accounts written from their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import portfolio as p
from tideline.operators.ledger import LedgerOptions, ledger, proportional_ledger, sequential_ledger, with_market
from tideline.operators.search import positions

BASE = dict(cost_bps=7, slippage_bps=2, spread_bps=5, execution_lag=1, cash_rate=0.03, financing_rate=0.05, borrow_bps=120, short_rebate_rate=0.01)


def targets(walk, size=1.7):
    bars, _ = walk
    return bars, positions(bars, "tsmom", lookback=5, position_size=size)


def naive(close, volume, days, want, o):
    """One account with scalar arithmetic and bisection on the post-trade weight."""
    nav, asset, rets, dead = o.initial_capital, 0.0, [], False
    for i in range(len(close)):
        if dead:
            rets.append(0.0)
            continue
        r = close[i] / close[i - 1] - 1 if i else 0.0
        dt = days[i] / 365.25
        h = asset / nav
        pre = (h * r + max(1 - max(h, 0), 0) * o.cash_rate * dt + max(-h, 0) * (o.short_rebate_rate - o.borrow_bps / 1e4) * dt
               - max(abs(h) - 1, 0) * o.financing_rate * dt)
        value, now, traded_value = asset * (1 + r), nav * (1 + pre), close[i] * volume[i]
        d = want[i]

        def fee(x):
            if x <= 0:
                return 0.0
            impact = o.impact_bps * (x / traded_value / o.impact_reference_participation) ** o.impact_exponent if o.impact_bps and traded_value > 0 else 0.0
            return max(x * o.cost_bps / 1e4, o.min_fee) + x * (o.slippage_bps + o.spread_bps / 2 + impact) / 1e4

        miss = lambda x: value + x - d * (now - fee(abs(x)))
        if d == 0:
            x = -value
        elif abs(miss(0)) <= 1e-14 * max(now, 1):
            x = 0.0
        else:
            side, lo, hi = (-1 if miss(0) > 0 else 1), 0.0, max(abs(d * now - value), now * 1e-12)
            while miss(side * hi) * miss(0) > 0:
                hi *= 2
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if miss(side * mid) * miss(0) > 0 else (lo, mid)
            x = side * hi
            after = now - fee(abs(x))
            if not (after > 0 and abs((value + x) / after - d) < abs(value / now - d)):
                x = 0.0
        limit = abs(x)
        if o.impact_bps or o.max_participation is not None:
            limit = min(limit, traded_value * (o.max_participation or 1.0))
        paid = fee(limit)
        out = pre - paid / nav
        asset, nav = value + np.sign(x) * limit, nav * (1 + out)
        dead = out <= -1
        rets.append(out)
    return rets


@pytest.mark.parametrize("extra", [{}, {"min_fee": 30.0}, {"impact_bps": 15, "max_participation": 0.4, "min_fee": 5.0}])
def test_ledger_matches_naive_account(walk, extra):
    bars, pdf = walk
    o = LedgerOptions(**BASE, **extra, initial_capital=50_000)
    _, target = targets(walk)
    rows = ledger(with_market(bars, o).join(target, ["ticker", "date"]), o).select("ticker", "date", "ret", "target").toPandas().sort_values(["ticker", "date"])
    for name, part in rows.groupby("ticker"):
        src = pdf[pdf.ticker == name]
        want = np.concatenate([[0.0], np.clip(part["target"].to_numpy(), -2, 2)[:-1]])
        days = [0, *[(b - a).days for a, b in zip(src["date"], src["date"][1:])]]
        got = naive(src["close"].to_numpy(), src["volume"].to_numpy(), days, want, o)
        np.testing.assert_allclose(part["ret"], got, rtol=1e-8, atol=1e-12)


def test_both_forms_agree(walk):
    o = LedgerOptions(**BASE)
    bars, target = targets(walk)
    df = with_market(bars, o).join(target, ["ticker", "date"])
    cols = ["ret", "equity", "trade", "position", "held", "txn_cost"]
    a = proportional_ledger(df, o).select("ticker", "date", *cols).toPandas().sort_values(["ticker", "date"])
    b = sequential_ledger(df, o).select("ticker", "date", *cols).toPandas().sort_values(["ticker", "date"])
    np.testing.assert_allclose(a[cols], b[cols], rtol=1e-9, atol=1e-12)


def test_buy_and_hold_without_costs_is_the_price(walk):
    bars, pdf = walk
    o = LedgerOptions(cost_bps=0)
    led = ledger(with_market(bars, o).withColumn("target", F.lit(1.0)), o).toPandas().sort_values(["ticker", "date"])
    for name, part in led.groupby("ticker"):
        close = pdf[pdf.ticker == name]["close"].to_numpy()
        np.testing.assert_allclose(part["equity"], close / close[0], rtol=1e-10)


def test_costs_reduce_equity(walk):
    bars, target = targets(walk)
    ends = []
    for bps in (0, 10, 100):
        o = LedgerOptions(cost_bps=bps, execution_lag=1)
        ends.append(ledger(with_market(bars, o).join(target, ["ticker", "date"]), o).groupBy().agg(F.sum("equity")).first()[0])
    assert ends[0] > ends[1] > ends[2]


@pytest.mark.parametrize("name", ["tsmom", "ma_cross", "rsi", "donchian", "zscore", "supertrend", "heikin_ashi", "stacked"])
def test_no_look_ahead(walk, name):
    bars, pdf = walk
    cut = sorted(pdf["date"].unique())[99]
    params = {"stacked": dict(momentum_lb=10, ma_filter=10, base_lookback=5)}.get(name, {})
    key = lambda df: {(r.ticker, r.date): r.target for r in df.collect()}
    early = key(positions(bars.filter(F.col("date") <= F.lit(cut)), name, **params))
    late = key(positions(bars, name, **params))
    assert all(abs(late[x] - v) < 1e-12 for x, v in early.items())


def test_options_are_validated():
    for bad in (dict(cost_bps=-1), dict(max_leverage=0), dict(execution_lag=-1), dict(max_participation=2), dict(cash_rate=-1), dict(vol_target=0.1, vol_lookback=1)):
        with pytest.raises(ValueError):
            LedgerOptions(**bad)
    for bad in (dict(execution_lag=0), dict(max_turnover=3), dict(cost_bps=10000), dict(initial_capital=0)):
        with pytest.raises(ValueError):
            p.ExecutionOptions(**bad)
    for bad in (dict(lookback=5, skip_recent=5), dict(top_k=0), dict(rebalance="yearly"), dict(max_weight=0)):
        with pytest.raises(ValueError):
            p.MomentumOptions(**bad)


def test_book_forms_agree_and_finance_themselves(walk):
    bars, _ = walk
    prices = p.with_book(bars.select("ticker", "date", "close"))
    t = p.momentum_targets(prices, p.MomentumOptions(lookback=10, top_k=1, rebalance="weekly", max_weight=0.8))
    opts = dict(cost_bps=40, cash_rate=0.02)
    nav, legs = p.book(t, prices, p.ExecutionOptions(**opts))
    same, _ = p.book(t, prices, p.ExecutionOptions(**opts, max_turnover=2.0))
    cols = ["nav", "cash", "turnover", "transaction_cost", "asset_pnl", "cash_interest"]
    a, b = nav.orderBy("date").toPandas(), same.orderBy("date").toPandas()
    np.testing.assert_allclose(a[cols], b[cols], rtol=1e-9, atol=1e-6)
    held = legs.groupBy("date").agg(F.sum("asset_value").alias("v")).orderBy("date").toPandas()["v"]
    np.testing.assert_allclose(held + a["cash"], a["nav"], rtol=1e-10)
    np.testing.assert_allclose(a["nav"].shift(1).fillna(1e6) + a["asset_pnl"] + a["cash_interest"] - a["transaction_cost"], a["nav"], rtol=1e-10)
    tight, _ = p.book(t, prices, p.ExecutionOptions(**opts, max_turnover=0.0))
    assert tight.agg(F.sum("turnover")).first()[0] == 0
