"""One budgeted account, bar by bar: the part of the portfolio book that is inherently sequential."""

from __future__ import annotations

import numpy as np


def account_after_cost(nav, values, weights, rate):
    """Largest account value whose rebalance to ``weights`` can be paid from ``nav``.

    ``n + rate * sum|w n - v|`` is convex and piecewise linear: try each linear
    piece from the highest breakpoint down.
    """
    if rate == 0:
        return nav
    positive = weights > 0
    points = np.where(positive, values / np.where(positive, weights, 1.0), np.inf)
    edges = np.sort(points[positive & (points < nav)])[::-1]
    for edge in (*edges, 0.0):
        if edge + rate * np.abs(weights * edge - values).sum() <= nav:
            buying = positive & (points <= edge)
            sign = np.where(buying, 1.0, -1.0)
            return (nav + rate * (sign * values).sum()) / (1 + rate * (sign * weights).sum())
    return 0.0


def run_budgeted_book(close, orders, days, opts):
    """``close`` and ``orders`` are sessions x assets; an all-NaN order row holds."""
    n, m = close.shape
    per_leg = {c: np.zeros((n, m)) for c in ("weight", "units", "asset_value", "trade", "requested_trade", "unfilled_trade")}
    per_day = {c: np.zeros(n) for c in ("nav", "cash", "asset_pnl", "cash_interest", "pre_trade_nav", "transaction_cost", "traded_notional",
                                        "turnover", "requested_notional", "unfilled_notional", "fill_fraction")}
    limited, executed = np.zeros(n, dtype=bool), np.isfinite(orders).all(axis=1)
    units, cash, budget = np.zeros(m), float(opts.initial_capital), opts.max_turnover
    for i in range(n):
        interest = cash * np.expm1(np.log1p(opts.cash_rate) * days[i] / 365.0)
        pnl = float(units @ (close[i] - close[i - 1])) if i else 0.0
        cash += interest
        values = units * close[i]
        pre = cash + values.sum()
        wanted, filled, share = np.zeros(m), np.zeros(m), 0.0
        if executed[i]:
            wanted = orders[i] * account_after_cost(pre, values, orders[i], opts.rate) - values
            asked = np.abs(wanted).sum() / pre
            share = 1.0
            if budget is not None and asked > budget:
                share, limited[i] = budget / asked, True
            filled = wanted * share
            if share > 0:
                values = values + filled
                cash = max(0.0, pre - np.abs(filled).sum() * opts.rate - values.sum())
                units = values / close[i]
        nav = cash + values.sum()
        moved = np.abs(filled).sum()
        per_leg["weight"][i], per_leg["units"][i], per_leg["asset_value"][i] = values / nav, units, values
        per_leg["trade"][i], per_leg["requested_trade"][i], per_leg["unfilled_trade"][i] = filled, wanted, wanted - filled
        for name, value in (("nav", nav), ("cash", cash), ("asset_pnl", pnl), ("cash_interest", interest), ("pre_trade_nav", pre),
                            ("transaction_cost", moved * opts.rate), ("traded_notional", moved), ("turnover", moved / pre),
                            ("requested_notional", np.abs(wanted).sum()), ("unfilled_notional", np.abs(wanted - filled).sum()),
                            ("fill_fraction", share)):
            per_day[name][i] = value
    wide = {name: np.repeat(v[:, None], m, axis=1) for name, v in {**per_day, "turnover_limited": limited, "executed": executed}.items()}
    return {**per_leg, **wide}
