"""The broker simulation: cash and shares settle some days after a trade, a trailing stop only tightens."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "symbol string, trades long, stops long, blocked_liquidity long, blocked_settlement long, final_equity double, max_drawdown double, exposure double, buy_hold double"


def simulate(bars: pd.DataFrame, capital: float = 10_000_000.0, entry: float = 0.52, stop_mult: float = 6.0, fee: float = 0.003, slippage: float = 0.002, settle: int = 2, confirm: int = 2, least_shares: int = 5, risk: float = 0.01, volume_share: float = 0.1) -> dict:
    """One symbol's run over its date-ordered bars; sizes follow the stop's distance and are whole shares."""
    cash, shares = capital, 0
    cash_due: deque[tuple[int, float]] = deque()
    shares_due: deque[tuple[int, int]] = deque()
    stop, above, curve, held = 0.0, 0, [], 0
    count = dict.fromkeys(("trades", "stops", "blocked_liquidity", "blocked_settlement"), 0)
    limit = bars["volume"].rolling(20, min_periods=1).mean().to_numpy()
    for k, (close, low, atr, prob) in enumerate(zip(bars["close"], bars["low"], bars["atr"].ffill().fillna(0.0), bars["prob"])):
        while cash_due and cash_due[0][0] <= k:
            cash += cash_due.popleft()[1]
        while shares_due and shares_due[0][0] <= k:
            shares += shares_due.popleft()[1]
        pending = sum(n for _, n in shares_due)
        above = above + 1 if prob > entry else 0
        if shares or pending:
            stop = max(stop, close - stop_mult * atr)
            stopped = low <= stop
            if stopped or prob < entry - 0.05:
                if shares:
                    price = (min(close, stop) if stopped else close) * (1 - slippage)
                    cash_due.append((k + settle, shares * price * (1 - fee)))
                    count["trades"] += 1
                    count["stops"] += int(stopped)
                    shares, stop = 0, 0.0
                else:
                    count["blocked_settlement"] += 1
        elif above >= confirm and not cash_due:
            price, distance = close * (1 + slippage), max(stop_mult * atr, 1e-9)
            n = int(min(cash * risk / distance, cash / (price * (1 + fee))))
            if limit[k] * volume_share * 1_000 < n:
                count["blocked_liquidity"] += 1
            elif n > least_shares:
                cash -= n * price * (1 + fee)
                shares_due.append((k + settle, n))
                stop = close - stop_mult * atr
                count["trades"] += 1
        elif above >= confirm:
            count["blocked_settlement"] += 1
        owned = shares + sum(n for _, n in shares_due)
        held += owned > 0
        curve.append(cash + sum(c for _, c in cash_due) + owned * close)
    curve = np.array(curve)
    return count | {"final_equity": float(curve[-1]), "max_drawdown": float((curve / np.maximum.accumulate(curve) - 1).min()), "exposure": held / len(curve), "buy_hold": float(capital * bars["close"].iloc[-1] / bars["close"].iloc[0])}


def backtest(bars: DataFrame, **options) -> DataFrame:
    """simulate() over every symbol: the state runs from bar to bar, so a symbol is a group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"symbol": key[0]} | simulate(rows.sort_values("date"), **options)])

    return bars.groupBy("symbol").applyInPandas(run, SCHEMA)
