"""A backtest as one call: checked arguments in, metrics, portfolio and diagnostics out.

The panel comes from a loader, so any store can be behind it.  What reaches the
driver is the daily table, one row a day.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import expression as E
from ..sources import files
from ..sources.panel import with_calendar
from . import backtest as B

#: (universe, fields, first day, last day) -> (panel with day_idx, calendar or None)
Loader = Callable[[str, list[str], str, str], tuple[DataFrame, DataFrame | None]]

#: Names of the metrics in an answer, by the columns of ``backtest.metrics``.
METRICS = {
    "information_ratio": "Information_Ratio_with_cost",
    "annualized_return": "Annualized_Return_with_cost",
    "annualized_volatility": "Annualized_Volatility_with_cost",
    "max_drawdown": "Max_Drawdown_with_cost",
    "average_turnover": "Average_Daily_Turnover",
    "total_return": "Total_Return_with_cost",
    "total_return_without_cost": "Total_Return_without_cost",
    "benchmark_total_return": "Benchmark_Total_Return",
}


def exported(spark: SparkSession, path: str, start: str, end: str) -> Loader:
    """Loads an export that covers the period and is unchanged; scans begin where its data do."""
    from ..sources.sinks import validate_manifest

    found = validate_manifest(spark, path, start, end)

    def load(universe: str, fields: list[str], first: str, last: str) -> tuple[DataFrame, DataFrame | None]:
        days = files.calendar(spark, path)
        return with_calendar(files.market_panel(spark, path, universe, fields, found["warmup_start"], last), days), days

    return load


class BacktestEngine:
    """Runs one factor at a time over what ``load`` gives."""

    def __init__(self, load: Loader, config: B.Config = B.Config(), source: str = "injected-fixture", span: tuple[str, str] | None = None):
        self.load, self.config, self.source, self.span = load, config, source, span

    def prepared(self, exprs: dict[str, str], stock_pool: str, industry_neutralization: str | None, shuffle_cross_section: bool, **given: Any) -> tuple[str, str, str, B.Config, list[str]]:
        """(name, expression, universe, settings, fields), or the error of the first argument that does not fit."""
        universe = stock_pool.upper()
        if universe not in B.UNIVERSES:
            raise ValueError(f"unsupported universe {stock_pool!r}, not one of {', '.join(B.UNIVERSES)}")
        if len(exprs) != 1:
            raise ValueError(f"one factor expression at a time, not {len(exprs)}")
        neutral = (industry_neutralization or "none").lower()
        seed = B.SHUFFLE_SEED if shuffle_cross_section else None
        config = replace(self.config, neutralization=neutral, shuffle_seed=seed, **given).checked()
        ((name, expression),) = exprs.items()
        tree = E.evaluable(E.parse(expression))
        fields = E.fields(tree) | {"return", "tradestatus"} | ({"industry"} if neutral == "industry" else set())
        return name, expression, universe, config, sorted(fields)

    def backtest(
        self,
        *,
        exprs: dict[str, str],
        backtest_start_time: str,
        backtest_end_time: str,
        update_freq: int = 5,
        stock_pool: str = "CSI500",
        position_size: float = 1.0,
        max_pos_each_stock: float = 0.2,
        industry_neutralization: str | None = None,
        shift_bars: int = 0,
        shuffle_cross_section: bool = False,
        **_: Any,
    ) -> dict[str, Any]:
        """{metrics, portfolio, diagnostics}; other arguments are taken and do nothing."""
        own = {"update_freq": update_freq, "position_size": position_size, "max_pos_each_stock": max_pos_each_stock, "shift_bars": shift_bars}
        name, expression, universe, config, fields = self.prepared(exprs, stock_pool, industry_neutralization, shuffle_cross_section, **own)
        panel, days = self.load(universe, fields, backtest_start_time, backtest_end_time)
        table = B.backtest(panel, expression, backtest_start_time, backtest_end_time, config, days)
        rows = table.orderBy("d").collect()
        if not rows:
            raise RuntimeError(f"the window {backtest_start_time} to {backtest_end_time} has no tradable rows")
        figures = B.metrics(panel.sparkSession.createDataFrame(rows, table.schema), config.annualization).first()
        return {
            "metrics": {shown: float(figures[c]) for c, shown in METRICS.items()},
            "portfolio": {
                "dates": [r.datetime.isoformat() for r in rows],
                "nav": [r.nav for r in rows],
                "benchmark_nav": [r.benchmark_nav for r in rows],
                "daily_return": [r.net for r in rows],
            },
            "diagnostics": {
                "factor_name": name,
                "expression": expression,
                "universe": universe,
                "signal_lag_bars": B.AS_OF_BARS + shift_bars,
                "shuffle_cross_section": shuffle_cross_section,
                "rebalance_every_bars": update_freq,
                "mean_holdings": float(figures.mean_holdings),
                "benchmark": f"{universe}_equal_weight",
                "rows": sum(r.n_rows for r in rows),
            },
        }
