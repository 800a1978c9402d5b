"""Registered queries over the driver tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expression as E
from ..functions import text as X
from ..operators import market as M
from ..operators import probes as P
from ..operators import records as R
from ..operators import tools as tools
from ..operators import training as T
from ..sources.panel import OFF_TIES, calendar, panel
from . import backtest as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLAGSHIP = "RANK($close / TS_MEAN($close, 4))"
START, END = "1995-01-01", "1998-12-31"
CONFIG = B.Config()

#: SQL of the panel; queries add their own tables to it.
PANEL = """
    px AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS datetime, l_suppkey AS instrument, l_extendedprice / l_quantity AS px,
        l_quantity, l_extendedprice, l_returnflag FROM lineitem),
    p0 AS (SELECT datetime, instrument, round(avg(px) + 3e-8, 6) AS close, round(median(px) + 3e-8, 6) AS open, round(max(px) + 3e-8, 6) AS high, round(min(px) + 3e-8, 6) AS low,
        sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount, CAST(max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS INTEGER) AS tradestatus
        FROM px GROUP BY datetime, instrument),
    panel AS (SELECT p0.*, CAST(s_nationkey AS DOUBLE) AS industry,
        round((close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1) * 0.005::DOUBLE, 9) AS ret,
        CAST(dense_rank() OVER (ORDER BY datetime) - 1 AS INTEGER) AS day_idx FROM p0 JOIN supplier ON s_suppkey = instrument)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"WITH {PANEL} SELECT datetime, instrument, day_idx, open, high, low, close, volume, amount, ret, industry, tradestatus FROM panel")
def panel_build(spark, sf_dir):
    return panel(spark, sf_dir).select("datetime", "instrument", "day_idx", "open", "high", "low", "close", "volume", "amount", F.col("return").alias("ret"), "industry", "tradestatus")


def _signal(name: str, expression: str, sql: str, digits: int = 6) -> None:
    """A query of one expression; ``sql`` is its value over ``panel``, window w4 and lag l3 at hand."""

    def run(spark, sf_dir):
        out = E.with_signals(panel(spark, sf_dir), {"value": expression})
        return out.select("datetime", "instrument", F.round(F.col("value") + OFF_TIES, digits).alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"""WITH {PANEL}, w AS (SELECT *, avg(close) OVER w4 AS mean4, stddev_pop(close) OVER w4 AS std4, min(close) OVER w4 AS min4, max(close) OVER w4 AS max4,
        sum(close) OVER w4 AS sum4, count(close) OVER w4 AS n4, max(close) OVER l3 AS lag3 FROM panel
        WINDOW w4 AS (PARTITION BY instrument ORDER BY day_idx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW),
               l3 AS (PARTITION BY instrument ORDER BY day_idx RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING)),
        v AS (SELECT datetime, instrument, {sql} AS value FROM w)
        SELECT datetime, instrument, round(CASE WHEN isfinite(value) THEN value END + 3e-8, {digits}) AS value FROM v"""


_RANK = "CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY datetime ORDER BY {0} NULLS LAST) + (count({0}) OVER (PARTITION BY datetime, {0}) - 1) / 2.0::DOUBLE) / count({0}) OVER (PARTITION BY datetime) END"
_NEUTRAL = "({0} - avg({0}) OVER (PARTITION BY datetime, industry)) / nullif(stddev_pop({0}) OVER (PARTITION BY datetime, industry), 0)"
for _name, _text, _sql in (
    ("ts_mean", "TS_MEAN($close, 4)", "CASE WHEN n4 = 4 THEN mean4 END"),
    ("ts_std", "TS_STD($close, 4)", "CASE WHEN n4 = 4 THEN std4 END"),
    ("ts_min", "TS_MIN($close, 4)", "CASE WHEN n4 = 4 THEN min4 END"),
    ("ts_max", "TS_MAX($close, 4)", "CASE WHEN n4 = 4 THEN max4 END"),
    ("ts_sum", "TS_SUM($close, 4)", "CASE WHEN n4 = 4 THEN sum4 END"),
    ("ts_pctchange", "TS_PCTCHANGE($close, 3)", "close / lag3 - 1"),
    ("delay", "DELAY($close, 3)", "lag3"),
    ("delta", "DELTA($close, 3)", "close - lag3"),
    ("rank_pct", "RANK($close)", _RANK.format("close")),
    ("industry_neutralize", "INDUSTRY_NEUTRALIZE($volume, $industry)", _NEUTRAL.format("volume")),
    ("log_abs_sign", "LOG($close - 1500) + ABS($close - $open) * SIGN(DELTA($close, 3))", "CASE WHEN close > 1500 THEN ln(close - 1500) END + abs(close - open) * sign(close - lag3)"),
    ("safe_divide", "$amount / ($high - $low)", "amount / nullif(high - low, 0)"),
    ("unary_arithmetic", "--$close * -2 + .5 * $open - 1e1", "close * -2 + 0.5::DOUBLE * open - 10"),
    ("constant_signal", "LOG(2) * 3 - ABS(0 - 1) / 4", "ln(2::DOUBLE) * 3 - 0.25::DOUBLE"),
    ("nested_expr", FLAGSHIP, _RANK.format("(close / nullif(CASE WHEN n4 = 4 THEN mean4 END, 0))")),
):
    _signal(_name, _text, _sql, 2 if _name == "ts_std" else 6)

_MANY = {"reversal": "-TS_PCTCHANGE($close, 4)", "liquidity": "RANK($amount / TS_MEAN($amount, 4))", "calm": "-TS_STD($return, 4)", "trend": FLAGSHIP}


@query(
    f"""WITH {PANEL}, w AS (SELECT *, max(close) OVER l4 AS lag4, avg(amount) OVER w4 AS am4, count(amount) OVER w4 AS an4, avg(close) OVER w4 AS cm4, count(close) OVER w4 AS cn4, stddev_pop(ret) OVER w4 AS rs4, count(ret) OVER w4 AS rn4 FROM panel
        WINDOW w4 AS (PARTITION BY instrument ORDER BY day_idx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), l4 AS (PARTITION BY instrument ORDER BY day_idx RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING)),
    r AS (SELECT *, CASE WHEN an4 = 4 THEN amount / am4 END AS liq, CASE WHEN cn4 = 4 THEN close / cm4 END AS tr FROM w)
    SELECT datetime, instrument, round(1 - close / lag4 + 3e-8, 6) AS reversal, round({_RANK.format("liq")} + 3e-8, 6) AS liquidity, round(CASE WHEN rn4 = 4 THEN -rs4 END + 3e-8, 6) AS calm, round({_RANK.format("tr")} + 3e-8, 6) AS trend FROM r"""
)
def many_factors(spark, sf_dir):
    """Several factors over one panel: equal subtrees and exchanges are shared."""
    out = E.with_signals(panel(spark, sf_dir), _MANY)
    return out.select("datetime", "instrument", *[F.round(F.col(n) + OFF_TIES, 6).alias(n) for n in _MANY])


_SCORE = f"""{PANEL},
    b0 AS (SELECT *, avg(close) OVER w AS m4, count(close) OVER w AS n4 FROM panel
        WINDOW w AS (PARTITION BY instrument ORDER BY day_idx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)),
    b1 AS (SELECT *, CASE WHEN n4 = 4 THEN close / nullif(m4, 0) END AS ratio FROM b0),
    b2 AS (SELECT *, {_RANK.format("ratio")} AS signal FROM b1),
    b3 AS (SELECT *, max(signal) OVER (PARTITION BY instrument ORDER BY day_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS score FROM b2)"""


@query(f"WITH {_SCORE} SELECT datetime, instrument, round(score, 6) AS score FROM b3")
def signal_lag(spark, sf_dir):
    return B.scored(panel(spark, sf_dir), FLAGSHIP).select("datetime", "instrument", F.round("score", 6).alias("score"))


_HELD = f"""{_SCORE},
    t0 AS (SELECT datetime, instrument, score, ret AS r, dense_rank() OVER (ORDER BY datetime) - 1 AS d FROM b3
        WHERE datetime BETWEEN DATE '{START}' AND DATE '{END}' AND coalesce(tradestatus, 0) > 0),
    c0 AS (SELECT d, instrument, count(*) OVER (PARTITION BY d) AS n, row_number() OVER (PARTITION BY d ORDER BY score DESC, instrument) AS place
        FROM t0 WHERE d % 5 = 0 AND score IS NOT NULL AND r IS NOT NULL),
    c1 AS (SELECT d, instrument, least(1.0::DOUBLE / greatest(1, ceil(n * 0.1::DOUBLE)), 1.0::DOUBLE) AS w FROM c0 WHERE place <= greatest(1, ceil(n * 0.1::DOUBLE))),
    h0 AS (SELECT t0.datetime, t0.d, t0.instrument, c1.w, t0.r, row_number() OVER (PARTITION BY c1.d, t0.instrument ORDER BY t0.d) AS pace, c1.d AS d0
        FROM t0 JOIN c1 ON c1.d = t0.d - t0.d % 5 AND c1.instrument = t0.instrument WHERE t0.r IS NOT NULL),
    held AS (SELECT datetime, d, instrument, w, r FROM h0 WHERE pace = d - d0 + 1)"""
_DAILY = f"""{_HELD},
    days AS (SELECT d, datetime, coalesce(avg(r), 0) AS benchmark FROM t0 GROUP BY d, datetime),
    mv AS (SELECT d, instrument, sum(w) AS dw FROM (SELECT d, instrument, w FROM held UNION ALL SELECT d + 1, instrument, -w FROM held) GROUP BY d, instrument),
    bs AS (SELECT d, sum(greatest(dw, 0)) AS buys, sum(greatest(-dw, 0)) AS sells FROM mv GROUP BY d),
    gr AS (SELECT d, sum(w * r) AS gross, count(*) FILTER (w > 0) AS n_held FROM held GROUP BY d),
    dy AS (SELECT days.*, coalesce(gross, 0) AS gross, coalesce(n_held, 0) AS n_held,
        coalesce(buys, 0) * 0.0005::DOUBLE + coalesce(sells, 0) * 0.0015::DOUBLE AS cost, (coalesce(buys, 0) + coalesce(sells, 0)) / 2 AS turnover
        FROM days LEFT JOIN gr USING (d) LEFT JOIN bs USING (d)),
    nv AS (SELECT *, gross - cost AS net, product(1 + gross - cost) OVER run AS nav, product(1 + gross) OVER run AS gross_nav, product(1 + benchmark) OVER run AS benchmark_nav
        FROM dy WINDOW run AS (ORDER BY d ROWS UNBOUNDED PRECEDING)),
    dd AS (SELECT *, nav / max(nav) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM nv)"""


def _rows(spark, sf_dir):
    days = calendar(spark, sf_dir)
    return B.tradable(B.scored(B.bounded(panel(spark, sf_dir), START, FLAGSHIP, CONFIG, days), FLAGSHIP, CONFIG), START, END, days)


def _backtest(spark, sf_dir, expression=FLAGSHIP, config=CONFIG):
    return B.backtest(panel(spark, sf_dir), expression, START, END, config, calendar(spark, sf_dir))


@query(f"WITH {_HELD} SELECT d, instrument, round(w, 9) AS w FROM c1")
def topk_select(spark, sf_dir):
    return B.chosen(_rows(spark, sf_dir), CONFIG).select(F.col("d").cast("long").alias("d"), "instrument", F.round("w", 9).alias("w"))


@query(f"WITH {_HELD} SELECT d, instrument, round(w, 9) AS w, r FROM held")
def holdings_carry(spark, sf_dir):
    return B.holdings(_rows(spark, sf_dir), CONFIG).select(F.col("d").cast("long").alias("d"), "instrument", F.round("w", 9).alias("w"), "r")


@query(f"WITH {_DAILY} SELECT d, round(cost, 9) AS cost, round(turnover, 9) AS turnover, n_held FROM dy")
def turnover_cost(spark, sf_dir):
    days = B.daily(_rows(spark, sf_dir), CONFIG)
    return days.select(F.col("d").cast("long").alias("d"), F.round("cost", 9).alias("cost"), F.round("turnover", 9).alias("turnover"), "n_held")


@query(f"WITH {_DAILY} SELECT datetime, round(gross + 1.234567e-10, 6) AS gross, round(net + 1.234567e-10, 6) AS net, round(nav, 6) AS nav, round(gross_nav, 6) AS gross_nav, round(benchmark_nav, 6) AS benchmark_nav FROM dd")
def daily_nav(spark, sf_dir):
    days = _backtest(spark, sf_dir)
    return days.select("datetime", *[F.round(F.col(c) + 1.234567e-10, 6).alias(c) for c in ("gross", "net")], *[F.round(c, 6).alias(c) for c in ("nav", "gross_nav", "benchmark_nav")])


@query(f"WITH {_DAILY} SELECT datetime, round(drawdown, 6) AS drawdown FROM dd")
def drawdown(spark, sf_dir):
    days = _backtest(spark, sf_dir)
    return days.select("datetime", F.round("drawdown", 6).alias("drawdown"))


@query(f"WITH {_DAILY} SELECT datetime, round(benchmark + 1.234567e-10, 6) AS benchmark FROM dy")
def benchmark_return(spark, sf_dir):
    return B.daily(_rows(spark, sf_dir), CONFIG).select("datetime", F.round(F.col("benchmark") + 1.234567e-10, 6).alias("benchmark"))


@query(
    f"""WITH {_DAILY} SELECT round(CASE WHEN stddev_pop(net - benchmark) > 0 THEN avg(net - benchmark) / stddev_pop(net - benchmark) * sqrt(252::DOUBLE) ELSE 0 END, 6) AS information_ratio,
    round(pow(max_by(nav, d), 252::DOUBLE / count(*)) - 1, 6) AS annualized_return, round(stddev_pop(net) * sqrt(252::DOUBLE), 6) AS annualized_volatility,
    round(min(drawdown), 6) AS max_drawdown, round(avg(turnover), 6) AS average_turnover, round(max_by(nav, d) - 1, 6) AS total_return,
    round(max_by(gross_nav, d) - 1, 6) AS total_return_without_cost, round(max_by(benchmark_nav, d) - 1, 6) AS benchmark_total_return,
    round(avg(n_held), 6) AS mean_holdings, count(*) AS n_days FROM dd"""
)
def portfolio_metrics(spark, sf_dir):
    row = B.metrics(_backtest(spark, sf_dir))
    return row.select(*[F.round(c, 6).alias(c) if c != "n_days" else F.col(c) for c in row.columns])


_DEALT = """,
    s4 AS (SELECT *, row_number() OVER (PARTITION BY datetime, score IS NULL ORDER BY instrument) AS sn,
        row_number() OVER (PARTITION BY datetime, score IS NULL ORDER BY md5('{0}:' || CAST(datetime AS VARCHAR) || ':' || instrument), instrument) AS sm FROM s3),
    b3 AS (SELECT x.* EXCLUDE (score), y.score FROM s4 x JOIN s4 y ON x.datetime = y.datetime AND (x.score IS NULL) = (y.score IS NULL) AND x.sn = y.sm)"""


def _shuffled_sql(score: str, seed: int) -> str:
    return score.replace("b3 AS (", "s3 AS (") + _DEALT.format(seed)


@query(f"WITH {_shuffled_sql(_SCORE, 7)} SELECT datetime, instrument, round(score, 6) AS score FROM b3")
def shuffle_contrast(spark, sf_dir):
    """A seeded deal of each date's scores."""
    return B.scored(panel(spark, sf_dir), FLAGSHIP, B.Config(shuffle_seed=7)).select("datetime", "instrument", F.round("score", 6).alias("score"))


def _nav_sql(sql: str, lag: int, seed: int | None = None) -> str:
    """SQL of the metrics with another signal and lag, or with the scores dealt anew."""
    score = _SCORE.replace("1 PRECEDING AND 1 PRECEDING", f"{lag} PRECEDING AND {lag} PRECEDING")
    if sql:
        score = score[: score.index("b2 AS")] + f"b2 AS (SELECT *, {sql} AS signal FROM b1),\n    b3 AS" + score[score.index("b3 AS") + 5 :]
    score = score if seed is None else _shuffled_sql(score, seed)
    return f"""WITH {_DAILY.replace(_SCORE, score)} SELECT round(CASE WHEN stddev_pop(net - benchmark) > 0 THEN avg(net - benchmark) / stddev_pop(net - benchmark) * sqrt(252::DOUBLE) ELSE 0 END, 6) AS information_ratio,
        round(max_by(nav, d) - 1, 6) AS total_return, round(min(drawdown), 6) AS max_drawdown, round(avg(n_held), 6) AS mean_holdings, count(*) AS n_days FROM dd"""


def _shown(row):
    return row.select(*[F.round(c, 6).alias(c) for c in ("information_ratio", "total_return", "max_drawdown", "mean_holdings")], "n_days")


@query(_nav_sql("", 2))
def lagged_backtest(spark, sf_dir):
    """The flagship factor one bar later."""
    return _shown(B.metrics(_backtest(spark, sf_dir, config=B.Config(shift_bars=1))))


@query(_nav_sql(_NEUTRAL.format("volume"), 2))
def neutralized_backtest(spark, sf_dir):
    """A factor that the engine neutralizes by industry, one bar later."""
    return _shown(B.metrics(_backtest(spark, sf_dir, "$volume", B.Config(neutralization="industry", shift_bars=1))))


#: Factors that are compared, with the SQL of their signals over ``b1``.
_CANDIDATES = {"trend": (FLAGSHIP, ""), "small": ("-$volume", "-volume"), "wide": ("RANK($high - $low)", _RANK.format("(high - low)"))}
_CONTRASTS = {"reference": (1, None), "lag_one": (2, None), "shuffle_cross_section": (1, B.SHUFFLE_SEED)}
_CONTRAST_ROWS = " UNION ALL ".join(
    f"SELECT '{f}' AS factor, '{k}' AS contrast, * FROM ({_nav_sql(sql, lag, seed)})" for f, (_, sql) in _CANDIDATES.items() for k, (lag, seed) in _CONTRASTS.items()
)


def _contrasts(spark, sf_dir):
    return B.contrasts(panel(spark, sf_dir, END), {f: e for f, (e, _) in _CANDIDATES.items()}, START, END, CONFIG, calendar(spark, sf_dir))


@query(_CONTRAST_ROWS)
def contrast_metrics(spark, sf_dir):
    """Three factors, each as it is, a bar later and dealt anew: nine backtests in one plan."""
    rows = _contrasts(spark, sf_dir)
    return rows.select("factor", "contrast", *[F.round(c, 6).alias(c) for c in ("information_ratio", "total_return", "max_drawdown", "mean_holdings")], "n_days")


@query(
    f"""WITH m AS (SELECT factor, max(information_ratio) FILTER (contrast = 'reference') AS r, max(information_ratio) FILTER (contrast = 'lag_one') AS l,
        max(information_ratio) FILTER (contrast = 'shuffle_cross_section') AS s FROM ({_CONTRAST_ROWS}) GROUP BY factor)
    SELECT factor, round((greatest(0, 1 - abs(r - l) / greatest(abs(r), 0.1)) + greatest(0, 1 - abs(s) / greatest(abs(r), 0.1))) / 2, 4) AS robustness FROM m"""
)
def contrast_robustness(spark, sf_dir):
    """How robust each factor is, from its own contrasts."""
    of = lambda k: F.max(F.when(F.col("contrast") == k, F.col("information_ratio")))
    rows = _contrasts(spark, sf_dir).groupBy("factor").agg(*[of(k).alias(k) for k in _CONTRASTS])
    return rows.select("factor", F.round(R.robustness(*[F.col(k) for k in _CONTRASTS]), 4).alias("robustness"))


def _snapshots(spark, sf_dir):
    """Quarterly memberships: a supplier belongs to its market while it ships enough in the quarter."""
    lines = _table(spark, sf_dir, "lineitem").select(F.date_trunc("quarter", "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("instrument"), "l_quantity")
    sums = lines.groupBy("date", "instrument").agg(F.sum("l_quantity").alias("q")).where("q >= 500")
    return sums.select(F.when(F.col("instrument") % 2 == 0, "even").otherwise("odd").alias("universe"), "date", "instrument")


_SNAPSHOTS = """sn AS (SELECT CASE WHEN instrument % 2 = 0 THEN 'even' ELSE 'odd' END AS universe, date, instrument FROM (
        SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, l_suppkey AS instrument, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) WHERE q >= 500)"""
_RANGES = f"""{_SNAPSHOTS}, cal AS (SELECT DISTINCT datetime FROM panel),
    sd AS (SELECT universe, date, lead(date) OVER (PARTITION BY universe ORDER BY date) AS nxt FROM (SELECT DISTINCT universe, date FROM sn)),
    sp AS (SELECT universe, date, greatest(date, (SELECT min(datetime) FROM cal)) AS "from", max(datetime) AS "to" FROM sd JOIN cal
        ON cal.datetime >= sd.date AND (nxt IS NULL OR cal.datetime < nxt) GROUP BY universe, date),
    mr AS (SELECT universe, instrument, "from", "to" FROM sn JOIN sp USING (universe, date))"""


@query(f"WITH {PANEL}, {_RANGES} SELECT * FROM mr")
def membership_ranges(spark, sf_dir):
    return M.membership_ranges(_snapshots(spark, sf_dir), calendar(spark, sf_dir))


@query(
    f"""WITH {PANEL}, {_RANGES} SELECT datetime, instrument, close FROM panel p
    WHERE EXISTS (SELECT 1 FROM mr WHERE mr.instrument = p.instrument AND p.datetime BETWEEN mr."from" AND mr."to")"""
)
def universe_semijoin(spark, sf_dir):
    rows = panel(spark, sf_dir)
    ranges = M.membership_ranges(_snapshots(spark, sf_dir), calendar(spark, sf_dir))
    return M.within_membership(rows, ranges).select("datetime", "instrument", "close")


@query(f"WITH {_SNAPSHOTS} SELECT universe, count(DISTINCT date) AS n_snapshots FROM sn GROUP BY universe")
def snapshot_counts(spark, sf_dir):
    return M.snapshot_counts(_snapshots(spark, sf_dir))


@query(f"WITH {_SNAPSHOTS} SELECT DISTINCT universe, instrument, first_value(date) OVER (PARTITION BY universe, instrument ORDER BY date) AS date FROM sn")
def dedupe_snapshots(spark, sf_dir):
    s = _snapshots(spark, sf_dir)
    return M.first_of(s.unionByName(s), ["universe", "instrument"], ["date"]).select("universe", "instrument", "date")


@query(
    f"""WITH {PANEL}, iv AS (SELECT c_nationkey AS k, CAST(o_orderdate AS DATE) AS at, max(o_orderpriority) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    l AS (SELECT datetime, instrument, CAST(industry AS INTEGER) AS k FROM panel)
    SELECT l.datetime, l.instrument, coalesce(iv.v, 'UNKNOWN') AS industry FROM l ASOF LEFT JOIN iv ON l.k = iv.k AND l.datetime >= iv.at"""
)
def asof_industry(spark, sf_dir):
    """The newest order priority of the supplier's nation at each date, as a changing industry."""
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    right = orders.select(F.col("c_nationkey").cast("int").alias("k"), F.col("o_orderdate").cast("date").alias("datetime"), F.col("o_orderpriority").alias("v"))
    left = panel(spark, sf_dir).select("datetime", "instrument", F.col("industry").cast("int").alias("k"))
    return M.as_of(left, right, "k", "datetime", "v", "UNKNOWN").select("datetime", "instrument", F.col("v").alias("industry"))


@query(f"WITH {PANEL} SELECT datetime, CAST(row_number() OVER (ORDER BY datetime) - 1 AS INTEGER) AS day_idx FROM (SELECT DISTINCT datetime FROM panel WHERE tradestatus = 1)")
def calendar_index(spark, sf_dir):
    return M.trading_calendar(panel(spark, sf_dir))


@query("SELECT c_mktsegment AS value, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS DOUBLE) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def category_codes(spark, sf_dir):
    return M.category_codes(_table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return M.duplicate_keys(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    f"""WITH {PANEL}, sp AS (SELECT instrument, min(day_idx) AS a, max(day_idx) AS z FROM panel GROUP BY instrument),
    c AS (SELECT DISTINCT day_idx, datetime FROM panel)
    SELECT sp.instrument, c.day_idx, c.datetime, p.close FROM sp JOIN c ON c.day_idx BETWEEN a AND z LEFT JOIN panel p ON p.instrument = sp.instrument AND p.day_idx = c.day_idx"""
)
def calendar_reindex(spark, sf_dir):
    return M.reindexed(panel(spark, sf_dir), ["close"], calendar(spark, sf_dir))


@query(f"WITH {PANEL} SELECT count(*) AS n_rows, count(DISTINCT instrument) AS n_instruments, min(datetime) AS first_day, max(datetime) AS last_day FROM panel")
def manifest_counts(spark, sf_dir):
    return M.coverage(panel(spark, sf_dir), "datetime", "instrument")


@query("SELECT DISTINCT 'sh' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, 'sh.' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS vendor FROM supplier")
def instrument_codes(spark, sf_dir):
    vendor = F.concat(F.lit("SH."), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    return _table(spark, sf_dir, "supplier").select(M.instrument_code(vendor).alias("code")).distinct().withColumn("vendor", M.vendor_code(F.col("code")))


@query(
    """WITH r AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders),
    m AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', a)::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE)) AS month_end, z FROM r)
    SELECT month_end FROM m WHERE month_end <= z"""
)
def month_ends(spark, sf_dir):
    span = _table(spark, sf_dir, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("z"))
    return M.month_ends(span, "a", "z")


@query(
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(CAST(TRY_CAST(event_type AS DOUBLE) AS INTEGER), 0) AS flag FROM events"""
)
def numeric_coercion(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("flag"))
    return M.coerced(rows, ["k"], ["flag"])


_CHUNK = """n AS (SELECT doc_id, text, length(text) AS n FROM documents),
    k AS (SELECT doc_id, text, n, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 1800 THEN 1 ELSE 1 + CAST(ceil((n - 1800) / 1600.0::DOUBLE) AS BIGINT) END)) AS no FROM n),
    ch AS (SELECT doc_id, CAST(no AS INTEGER) AS chunk_no, CAST(no * 1600 AS INTEGER) AS char_start, CAST(least(no * 1600 + 1800, n) AS INTEGER) AS char_end,
        substring(text, CAST(no * 1600 + 1 AS BIGINT), 1800) AS chunk FROM k)"""


@query(f"WITH {_CHUNK} SELECT doc_id, chunk_no, 'p0-c' || lpad(CAST(chunk_no AS VARCHAR), 4, '0') AS chunk_id, char_start, char_end, sha256(chunk) AS chunk_sha FROM ch")
def chunk_documents(spark, sf_dir):
    rows = X.chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "chunk_no", X.chunk_id(F.lit(None).cast("int"), F.col("chunk_no")).alias("chunk_id"), "char_start", "char_end", X.content_hash(F.col("chunk")).alias("chunk_sha"))


@query(f"WITH {_CHUNK} SELECT doc_id, chunk_no, char_start FROM ch WHERE contains(lower(chunk), 'license') ORDER BY doc_id, chunk_no LIMIT 20")
def report_search(spark, sf_dir):
    rows = X.chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return X.search(rows, " License ", "chunk", ["doc_id", "chunk_no"], 20).select("doc_id", "chunk_no", "char_start")


@query("SELECT doc_id, list_reduce(list_prepend('', list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(text, '([0-9]+)'), lambda x: TRY_CAST(x AS BIGINT)))), lambda x: CAST(x AS VARCHAR))), lambda a, b: a || ',' || b) AS numbers FROM documents")
def numbers_in_text(spark, sf_dir):
    found = F.array_join(F.transform(F.sort_array(X.numbers(F.col("text"))), lambda n: n.cast("string")), ",")
    return _table(spark, sf_dir, "documents").select("doc_id", F.when(found == "", "").otherwise(F.concat(F.lit(","), found)).alias("numbers"))


@query("SELECT doc_id, sha256(text) AS content_hash, substring(sha256(text), 1, 16) AS hash_id FROM documents")
def content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"), X.document_id(F.col("text")).alias("hash_id"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '::' || lang WHEN 1 THEN source || '::unknown' WHEN 2 THEN 'unknown::' || lang WHEN 3 THEN CAST(doc_id AS VARCHAR)
        WHEN 4 THEN 'case' || doc_id ELSE 'own' || doc_id % 10 END AS group_key FROM documents"""
)
def group_key(spark, sf_dir):
    """Both, one or none of institution and series, padded with blanks; a document, a case or an explicit group."""
    d, n = _table(spark, sf_dir, "documents"), F.col("doc_id") % 6
    given = lambda c: F.concat(F.lit("  "), F.col(c), F.lit(" "))
    key = R.group_key(
        F.when(n == 5, F.concat(F.lit("own"), (F.col("doc_id") % 10).cast("string"))).otherwise(""),
        F.when((n < 2) | (n == 5), given("source")).otherwise(" "),
        F.when((n == 0) | (n == 2), given("lang")).otherwise(""),
        F.when(n != 4, F.col("doc_id").cast("string")),
        F.concat(F.lit("case"), F.col("doc_id").cast("string")),
    )
    return d.select("doc_id", key.alias("group_key"))


_SPLIT = "SELECT d.doc_id, d.source, d.lang, CASE WHEN quality = 1 THEN 'train' ELSE 'holdout' END AS split FROM documents d JOIN labels USING (doc_id)"


@query(f"WITH s AS ({_SPLIT}) SELECT source FROM s WHERE split = 'train' INTERSECT SELECT source FROM s WHERE split = 'holdout'")
def leak_groups(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").withColumn("split", F.when(F.col("quality") == 1, "train").otherwise("holdout"))
    return R.leaked(rows, "source")


def _cases(spark, sf_dir):
    """Gold records and reports out of the documents, and a prediction that is damaged by the id."""
    d = _table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    w = (n % 60 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (n % len(v) + 1).cast("int"))
    ones = lambda k: F.substring(F.lit("一二三四五六七八九"), k, F.lit(1))
    tens = F.when(w < 10, "").when(w < 20, "十").otherwise(F.concat(ones((w / 10).cast("int")), F.lit("十")))
    written = F.concat(tens, F.when(w % 10 > 0, ones(w % 10)).otherwise(""))
    quote = F.when(n % 4 == 2, F.concat(F.lit("过去"), written, F.lit("日"))).otherwise(F.concat(F.lit("over "), w.cast("string"), F.lit(" days")))
    none = F.lit(None).cast("int")
    evidence = F.array(F.struct(F.lit("p0-c0000").alias("chunk_id"), quote.alias("quote"), F.when(n % 7 < 5, n % 3).cast("int").alias("page_start"), *[none.alias(c) for c in ("page_end",)], (n % 11).cast("int").alias("char_start"), none.alias("char_end")))
    gold = F.struct(
        F.concat(F.lit("f"), n.cast("string")).alias("name"),
        pick("CSI300", "CSI500").alias("universe"),
        pick("daily", "weekly", "monthly").alias("frequency"),
        pick("none", "industry").alias("neutralization"),
        F.lit("monthly").alias("rebalance"),
        F.concat(F.lit("RANK($close / TS_MEAN($close, "), w.cast("string"), F.lit("))")).alias("expr"),
        F.array(w).alias("windows"),
        F.when(n % 5 < 3, evidence).otherwise(F.filter(evidence, lambda e: F.lit(False))).alias("evidence"),
    )
    report = F.concat(F.lit("We rank closes "), quote, F.lit(". "), "text")
    return R.settled(d.select("doc_id", "lang", "source", report.alias("report")), {"gold": gold})


#: SQL of the window, its Chinese numeral and the quotation of a case, over a table with doc_id.
_W = "(doc_id % 60 + 1)"
_NUMERAL = f"(CASE WHEN {_W} < 10 THEN '' WHEN {_W} < 20 THEN '十' ELSE substr('一二三四五六七八九', {_W} // 10, 1) || '十' END || CASE WHEN {_W} % 10 > 0 THEN substr('一二三四五六七八九', {_W} % 10, 1) ELSE '' END)"
_QUOTE = f"(CASE WHEN doc_id % 4 = 2 THEN '过去' || {_NUMERAL} || '日' ELSE 'over ' || {_W} || ' days' END)"
_CITED = "doc_id % 5 < 3"
_PAGE = "CASE WHEN doc_id % 7 < 5 THEN CAST(doc_id % 3 AS VARCHAR) ELSE 'null' END"


def _spec_sql(colon: str, comma: str) -> str:
    """The record's JSON text, with the given marks between its parts."""
    name = lambda k: f"'\"{k}\"{colon}'"
    text = lambda x: f"'\"' || {x} || '\"'"
    fields = {
        "name": text("'f' || doc_id"), "universe": text("(CASE WHEN doc_id % 2 = 0 THEN 'CSI300' ELSE 'CSI500' END)"), "frequency": text("['daily', 'weekly', 'monthly'][doc_id % 3 + 1]"),
        "neutralization": text("(CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'industry' END)"), "rebalance": "'\"monthly\"'",
        "expr": text(f"'RANK($close / TS_MEAN($close, ' || {_W} || '))'"), "windows": f"'[' || {_W} || ']'", "evidence": f"CASE WHEN {_CITED} THEN {_evidence_sql(colon, comma)} ELSE '[]' END",
    }
    return "'{' || " + f" || '{comma}' || ".join(f"{name(k)} || {v}" for k, v in fields.items()) + " || '}'"


def _evidence_sql(colon: str, comma: str) -> str:
    parts = {"chunk_id": "'\"p0-c0000\"'", "quote": f"'\"' || {_QUOTE} || '\"'", "page_start": _PAGE, "page_end": "'null'", "char_start": "doc_id % 11", "char_end": "'null'"}
    return "'[{' || " + f" || '{comma}' || ".join(f"'\"{k}\"{colon}' || {v}" for k, v in parts.items()) + " || '}]'"


@query(
    """WITH c AS (SELECT doc_id, k, doc_id % 60 + 1 AS w, doc_id % 5 < 3 AS cited, doc_id % 2 = 1 AS ind, doc_id % 3 AS f, text FROM documents,
        (SELECT unnest(['gold', 'drop_neutralization', 'wrong_frequency', 'wrong_window', 'hallucinated_expr', 'illegal_expr']) AS k)),
    e AS (SELECT *, CASE k WHEN 'hallucinated_expr' THEN 4 WHEN 'illegal_expr' THEN 4 WHEN 'drop_neutralization' THEN CASE WHEN ind THEN 4 ELSE 5 END
            WHEN 'wrong_frequency' THEN 4 WHEN 'wrong_window' THEN 4 ELSE 5 END - CASE WHEN k = 'hallucinated_expr' THEN 1 ELSE 0 END AS hits,
        CASE WHEN k = 'illegal_expr' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS executable,
        list_append(list_transform(regexp_extract_all(text, '([0-9]+)'), lambda x: TRY_CAST(x AS BIGINT)), w) AS seen FROM c),
    g AS (SELECT *, hits / 5.0::DOUBLE AS fields, CASE WHEN NOT cited THEN 0.0::DOUBLE WHEN k = 'hallucinated_expr' THEN 1.0::DOUBLE
            WHEN k = 'wrong_window' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS grounding,
        k = 'hallucinated_expr' OR (k = 'wrong_window' AND NOT list_contains(seen, w * 3)) AS invented FROM e),
    r AS (SELECT *, 0.25::DOUBLE + 0.25::DOUBLE * executable + 0.4::DOUBLE * fields + 0.1::DOUBLE * grounding AS raw FROM g)
    SELECT doc_id, k AS kind, executable, fields, grounding, round(raw, 6) AS raw,
        CASE WHEN k = 'illegal_expr' THEN 'illegal_expr_cap' WHEN invented THEN 'hallucinated_expr_cap' ELSE '' END AS caps,
        round(least(raw, CASE WHEN k = 'illegal_expr' THEN 0.15::DOUBLE WHEN invented THEN 0.35::DOUBLE ELSE 1 END), 6) AS reward FROM r"""
)
def inject_negatives(spark, sf_dir):
    """Gold and damaged copies of every case, scored."""
    rows = R.scored(R.injected(_cases(spark, sf_dir)))
    return rows.select("doc_id", "kind", "executable", "fields", "grounding", F.round("raw", 6).alias("raw"), F.array_join("caps", ",").alias("caps"), F.round("reward", 6).alias("reward"))


def _results(spark, sf_dir):
    """Scored rows that the labels and the lengths give, for the summaries."""
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    caps = R.compacted(("hallucinated_expr_cap", F.col("toxic") == 1), ("invalid_json_cap", F.col("n_chars") < 100), ("invalid_citation_cap", F.col("n_chars") % 7 == 0))
    fields = F.when(F.col("quality") == 1, 1.0).otherwise((F.col("doc_id") % 5) / 5)
    rows = d.withColumns({"caps": caps, "fields": fields, "grounding": (F.col("n_chars") % 3) / 2, "executable": F.lit(1.0)})
    raw = 0.5 + 0.4 * F.col("fields") + 0.1 * F.col("grounding")
    return rows.withColumn("reward", R.capped(raw, F.col("caps"), R.CAPS))


_RESULTS = """s0 AS (SELECT d.*, quality, toxic, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE doc_id % 5 / 5.0::DOUBLE END AS fields, n_chars % 3 / 2.0::DOUBLE AS grounding,
        toxic = 1 AS hal, n_chars < 100 AS inv, n_chars % 7 = 0 AS cit FROM documents d JOIN labels USING (doc_id)),
    s AS (SELECT *, least(0.5::DOUBLE + 0.4::DOUBLE * fields + 0.1::DOUBLE * grounding, CASE WHEN inv THEN 0 WHEN cit THEN 0.2::DOUBLE WHEN hal THEN 0.35::DOUBLE ELSE 1 END) AS reward,
        hal OR inv OR cit AS any_cap FROM s0)"""
_FIGURES = """count(*) AS n, round(avg(reward), 6) AS mean_reward, round(avg(CASE WHEN inv THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS parse_ok, round(avg(fields), 6) AS field_mean,
    round(avg(grounding), 6) AS grounding_mean, round(avg(CASE WHEN reward >= 0.7 AND NOT any_cap THEN 1.0::DOUBLE ELSE 0 END), 6) AS gate_pass_rate,
    round(avg(CASE WHEN hal THEN 1.0::DOUBLE ELSE 0 END), 6) AS hallucination_rate,
    round(avg(CASE WHEN reward >= 0.7 AND NOT any_cap AND fields >= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS task_success_rate,
    round(avg(CASE WHEN grounding >= 1 AND NOT cit THEN 1.0::DOUBLE ELSE 0 END), 6) AS evidence_grounding_rate"""


@query(f"WITH {_RESULTS} SELECT {_FIGURES} FROM s")
def headline_summary(spark, sf_dir):
    out = R.summarized(_results(spark, sf_dir))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_FIGURE_NAMES = ("mean_reward", "parse_ok", "field_mean", "grounding_mean", "gate_pass_rate", "hallucination_rate", "task_success_rate", "evidence_grounding_rate")


@query(
    f"""WITH {_RESULTS}, g AS (SELECT coalesce(CASE WHEN doc_id % 50 <> 7 THEN source END, 'c' || doc_id) AS "group", * FROM s),
    e AS (SELECT "group", {_FIGURES} FROM g GROUP BY "group")
    SELECT 'group' AS level, * FROM e UNION ALL SELECT 'pooled', NULL, {_FIGURES} FROM s
    UNION ALL SELECT 'median', NULL, count(*), {", ".join(f"round(median({n}), 6)" if n in R.MEDIANS else "NULL" for n in _FIGURE_NAMES)} FROM e"""
)
def group_summary_median(spark, sf_dir):
    """By source, pooled, and the medians over the sources; some rows have no source and are groups of their own."""
    rows = _results(spark, sf_dir).withColumn("case_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")))
    out = R.summarized_by_group(rows, F.when(F.col("doc_id") % 50 != 7, F.col("source")))
    return out.select("level", "group", "n", *[F.round(c, 6).alias(c) for c in _FIGURE_NAMES])


@query(f"WITH {_RESULTS} SELECT doc_id, reward >= 0.7 AND NOT any_cap AND doc_id % 4 <> 1 AS passed FROM s")
def gate_pass(spark, sf_dir):
    """The gate over rewards, caps and expressions, of which a quarter are not legal."""
    expr = F.when(F.col("doc_id") % 4 == 1, "FOO($close)").otherwise("RANK($close)")
    return _results(spark, sf_dir).select("doc_id", R.passes_gate(F.col("reward"), F.col("caps"), E.listed(expr)["ok"]).alias("passed"))


_HALVES = f"""h AS (SELECT doc_id % 2 AS half, {_FIGURES} FROM s GROUP BY 1),
    p AS (SELECT unnest(['task_success_rate', 'evidence_grounding_rate', 'illegal_tool_call_rate']) AS metric),
    v AS (SELECT metric, half, CASE metric WHEN 'task_success_rate' THEN task_success_rate WHEN 'evidence_grounding_rate' THEN evidence_grounding_rate ELSE CASE WHEN half = 0 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END END AS v FROM h, p),
    w AS (SELECT metric, coalesce(max(CASE WHEN half = 0 THEN v END), 0) AS b, coalesce(max(CASE WHEN half = 1 THEN v END), 0) AS a FROM p LEFT JOIN v USING (metric) GROUP BY metric)"""


@query(f"WITH {_RESULTS}, {_HALVES} SELECT metric, round_even(b * 100, 1) AS before, round_even(a * 100, 1) AS after, round_even((a - b) * 100, 1) AS delta_pp FROM w")
def compare_pp(spark, sf_dir):
    """The headline rates of two runs in percentage points; the calls are 10, of which 2 and 1 are illegal."""

    def half(n):
        audits = spark.createDataFrame([(7, 1 - n), (3, 1)], "tool_calls long, illegal_tool_calls long")
        s = R.summarized(_results(spark, sf_dir).where(F.col("doc_id") % 2 == n), audits).select(*[F.round(c, 6).alias(c) for c in R.HEADLINE])
        return s.unpivot([], list(R.HEADLINE), "metric", "value")

    return R.compared(half(0), half(1))


@query(
    """WITH c AS (SELECT doc_id, k, doc_id % 60 + 1 AS w, doc_id % 5 < 3 AS cited, doc_id % 2 = 1 AS ind, list_append(list_transform(regexp_extract_all(text, '([0-9]+)'), lambda x: TRY_CAST(x AS BIGINT)), doc_id % 60 + 1) AS seen
        FROM documents, (SELECT unnest(['gold', 'drop_neutralization', 'wrong_frequency', 'wrong_window', 'hallucinated_expr', 'illegal_expr']) AS k)),
    e AS (SELECT k, least(0.25::DOUBLE + CASE WHEN k = 'illegal_expr' THEN 0 ELSE 0.25::DOUBLE END + 0.08::DOUBLE * CASE k WHEN 'gold' THEN 5 WHEN 'drop_neutralization' THEN CASE WHEN ind THEN 4 ELSE 5 END WHEN 'hallucinated_expr' THEN 3 ELSE 4 END
            + 0.1::DOUBLE * CASE WHEN NOT cited THEN 0 WHEN k = 'wrong_window' THEN 0 ELSE 1 END,
        CASE WHEN k = 'illegal_expr' THEN 0.15::DOUBLE WHEN k = 'hallucinated_expr' OR (k = 'wrong_window' AND NOT list_contains(seen, w * 3)) THEN 0.35::DOUBLE ELSE 1 END) AS reward FROM c)
    SELECT count(*) AS n, round(avg(CASE WHEN k = 'gold' THEN reward END), 6) AS gold_mean, round(avg(CASE WHEN k <> 'gold' THEN reward END), 6) AS inject_mean FROM e"""
)
def injection_gap(spark, sf_dir):
    out = R.injection_gap(R.scored(R.injected(_cases(spark, sf_dir))))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("gold_mean", "inject_mean")])


def _listed_map(m):
    """A map of counts as text, by key: maps compare in no engine."""
    entries = F.sort_array(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def _calls(spark, sf_dir):
    """Turns as tool calls: two turns a step, faults by the length of the text."""
    c, n = _table(spark, sf_dir, "conversations"), F.length("text")
    return c.select(
        F.col("conv_id").alias("trajectory"),
        F.floor(F.col("turn") / 2).alias("step"),
        "turn",
        F.col("role").alias("name"),
        (n % 11 == 0).alias("unparsable"),
        (n % 3 != 0).alias("ok"),
        F.when(n % 2 == 0, "environment").otherwise("model").alias("source"),
        F.when(n % 5 == 0, "max evaluation rounds reached").when(n % 5 == 1, "invalid FactorSpec: x").alias("error"),
        (n % 7 == 0).alias("drifted"),
    )


_CALLS = """c0 AS (SELECT conv_id AS trajectory, turn // 2 AS step, turn, role AS name, length(text) AS n FROM conversations),
    c1 AS (SELECT *, n % 3 <> 0 AS ok, CASE WHEN n % 2 = 0 THEN 'environment' ELSE 'model' END AS source, count(*) OVER (PARTITION BY trajectory, step) AS in_step FROM c0),
    c2 AS (SELECT *, CASE WHEN name NOT IN ('user', 'assistant') THEN 'unknown_tool' WHEN n % 11 = 0 THEN 'unparsable_arguments' WHEN NOT (ok OR source = 'environment') AND n % 5 = 0 THEN 'budget_exceeded'
        WHEN NOT (ok OR source = 'environment') AND n % 5 = 1 THEN 'schema_invalid' WHEN n % 7 = 0 THEN 'frozen_field_mutation' WHEN in_step > 1 THEN 'multi_tool_per_step' END AS illegal_kind FROM c1)"""


@query(f"WITH {_CALLS} SELECT trajectory, turn, illegal_kind FROM c2")
def multi_tool_steps(spark, sf_dir):
    return R.classified(_calls(spark, sf_dir), ["user", "assistant"]).select("trajectory", "turn", "illegal_kind")


@query(
    f"""WITH {_CALLS}, k AS (SELECT trajectory, illegal_kind, count(*) AS n FROM c2 WHERE illegal_kind IS NOT NULL GROUP BY ALL),
    l AS (SELECT trajectory, string_agg(illegal_kind || '=' || n, ',' ORDER BY illegal_kind) AS illegal_by_kind FROM k GROUP BY 1),
    t AS (SELECT trajectory, count(*) AS tool_calls, count(illegal_kind) AS illegal_tool_calls, count(illegal_kind) / count(*)::DOUBLE AS illegal_tool_call_rate,
        count(*) FILTER (NOT ok AND source = 'environment') AS environment_failures FROM c2 GROUP BY trajectory)
    SELECT t.*, coalesce(illegal_by_kind, '') AS illegal_by_kind FROM t LEFT JOIN l USING (trajectory)"""
)
def protocol_audit(spark, sf_dir):
    out = R.audited(R.classified(_calls(spark, sf_dir), ["user", "assistant"]))
    return out.withColumn("illegal_by_kind", _listed_map(F.col("illegal_by_kind")))


@query(f"WITH {_CALLS} SELECT illegal_kind, count(*) AS n FROM c2 WHERE illegal_kind IS NOT NULL GROUP BY 1")
def illegal_histogram(spark, sf_dir):
    return R.histogram(R.classified(_calls(spark, sf_dir), ["user", "assistant"]), "illegal_kind")


def _records(spark, sf_dir):
    """Events as rollouts: a case for each user and month."""
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id")
    caps = R.compacted(("invalid_json_cap", n % 4 == 0), ("invalid_citation_cap", n % 9 == 0))
    return e.select(
        F.col("user_id").alias("case_id"),
        F.round(F.least(F.lit(1.0), F.abs("value") / 100), 6).alias("reward"),
        caps.alias("active_caps"),
        (n % 3 + 1).alias("tool_calls"),
        (n % 2).alias("illegal_tool_calls"),
        F.when(n % 6 == 0, 1).otherwise(0).alias("tool_error_model"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("tool_error_environment"),
        *[F.lit(False).alias(c) for c in ("parse_error", "grounding_error", "spec_drift", "backtest_failed")],
        (n % 5 == 0).alias("max_step_hit"),
    )


_METRICS = """e AS (SELECT user_id AS case_id, round(least(1.0::DOUBLE, abs(value) / 100), 6) AS reward, event_id AS n, event_type FROM events),
    m AS (SELECT case_id, count(*) AS k, min(reward) AS min_reward, max(reward) AS max_reward, round(avg(reward), 6) AS mean_reward, round(stddev_pop(reward), 6) AS reward_std,
        round(max(reward) - min(reward), 6) AS reward_spread, avg((reward >= 0.8)::INTEGER) AS success_at_k, bool_or(reward >= 0.8) AS any_success,
        avg((n % 4 = 0)::INTEGER) AS parse_error_rate, avg((n % 9 = 0)::INTEGER) AS grounding_error_rate, sum(n % 2) / sum(n % 3 + 1)::DOUBLE AS illegal_tool_call_rate,
        avg((n % 6 = 0)::INTEGER) AS tool_error_rate, avg((event_type = 'error')::INTEGER) AS environment_error_rate, 0.0::DOUBLE AS spec_drift_rate, 0.0::DOUBLE AS backtest_failure_rate,
        avg((n % 5 = 0)::INTEGER) AS max_step_hit_rate, concat_ws(',', CASE WHEN bool_or(n % 9 = 0) THEN 'invalid_citation_cap=' || count(*) FILTER (n % 9 = 0) END,
            CASE WHEN bool_or(n % 4 = 0) THEN 'invalid_json_cap=' || count(*) FILTER (n % 4 = 0) END) AS hard_cap_distribution FROM e GROUP BY case_id)"""
_ROUTES = """rt AS (SELECT *, CASE WHEN case_id % 10 = 0 THEN 'heldout_eval' WHEN case_id % 13 = 0 THEN 'quarantine' WHEN environment_error_rate >= 0.5 THEN 'backtest_gap'
    WHEN parse_error_rate >= 0.5 THEN 'sft_format' WHEN grounding_error_rate >= 0.5 THEN 'sft_grounding' WHEN tool_error_rate >= 0.5 THEN 'sft_tool'
    WHEN min_reward >= 0.8 AND reward_spread <= 0.1 THEN 'all_high_eval' WHEN any_success AND reward_spread >= 0.3 THEN 'rl_main' WHEN max_step_hit_rate >= 0.5 THEN 'long_trajectory'
    WHEN max_reward < 0.8 AND reward_spread <= 0.1 THEN 'sft_curriculum' ELSE 'more_probe' END AS route FROM m)"""


def _metrics(spark, sf_dir):
    m = R.group_metrics(_records(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("mean_reward", "reward_std", "reward_spread")}
    return m.withColumns(rounded | {"hard_cap_distribution": _listed_map(F.col("hard_cap_distribution"))})


@query(f"WITH {_METRICS} SELECT * FROM m")
def group_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


def _routed(spark, sf_dir):
    split = F.when(F.col("case_id") % 10 == 0, "holdout").otherwise("train")
    return _metrics(spark, sf_dir).withColumn("route", R.route(split, F.col("case_id") % 13 != 0))


@query(f"WITH {_METRICS}, {_ROUTES} SELECT case_id, route FROM rt")
def route_cases(spark, sf_dir):
    return _routed(spark, sf_dir).select("case_id", "route")


@query(f"WITH {_METRICS}, {_ROUTES} SELECT route, count(*) AS n FROM rt GROUP BY route")
def pool_counts(spark, sf_dir):
    return R.histogram(_routed(spark, sf_dir), "route")


def _turns(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("trajectory"), F.col("event_id").alias("turn"), F.round("value", 4).alias("metric"), (F.col("event_type") != "error").alias("ok"), F.lit(50.0).alias("baseline"))


_DELTA = """t AS (SELECT user_id AS trajectory, event_id AS turn, round(value, 4) AS metric, event_type <> 'error' AS ok FROM events),
    b AS (SELECT *, max(CASE WHEN ok THEN metric END) OVER (PARTITION BY trajectory ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t),
    d AS (SELECT *, CASE WHEN ok AND metric IS NOT NULL THEN metric - greatest(50.0::DOUBLE, coalesce(seen, 50)) ELSE 0 END AS delta FROM b)"""


@query(f"WITH {_DELTA} SELECT trajectory, turn, round(delta, 6) AS delta FROM d")
def best_so_far_delta(spark, sf_dir):
    return R.best_so_far(_turns(spark, sf_dir)).select("trajectory", "turn", F.round("delta", 6).alias("delta"))


@query(
    f"""WITH {_DELTA}, s AS (SELECT trajectory, avg((turn % 7 <> 0)::INTEGER) AS validity, 1 - max((turn % 23 = 0)::INTEGER) AS no_drift, 1 - max((turn % 31 = 0)::INTEGER) AS protocol,
        avg(ok::INTEGER) AS backtest_success, greatest(0, least(1, 0.5::DOUBLE + max(delta) / 2)) AS performance, avg((turn % 2 = 0)::INTEGER) AS novelty FROM d GROUP BY trajectory),
    w AS (SELECT *, validity * 0.15::DOUBLE + no_drift * 0.15::DOUBLE + protocol * 0.10::DOUBLE + backtest_success * 0.10::DOUBLE + performance * 0.35::DOUBLE + 0.5::DOUBLE * 0.10::DOUBLE + novelty * 0.05::DOUBLE AS raw FROM s)
    SELECT trajectory, round(validity, 6) AS validity, CAST(no_drift AS DOUBLE) AS no_drift, CAST(protocol AS DOUBLE) AS protocol, round(backtest_success, 6) AS backtest_success, round(performance, 6) AS performance,
        0.5::DOUBLE AS robustness, round(novelty, 6) AS novelty, concat_ws(',', CASE WHEN protocol = 0 THEN 'multi_tool_per_step_cap' END, CASE WHEN validity < 1 THEN 'illegal_expr_cap' END, CASE WHEN no_drift = 0 THEN 'spec_drift_cap' END) AS caps,
        round(raw, 6) AS raw, round(least(raw, CASE WHEN protocol = 0 THEN 0 WHEN validity < 1 THEN 0.15::DOUBLE WHEN no_drift = 0 THEN 0.30::DOUBLE ELSE 1 END), 6) AS reward FROM w"""
)
def evolution_scores(spark, sf_dir):
    n = F.col("turn")
    rows = R.best_so_far(_turns(spark, sf_dir)).withColumns(
        {"legal": n % 7 != 0, "drifted": n % 23 == 0, "crowded": n % 31 == 0, "novel": n % 2 == 0, "robustness": F.lit(None).cast("double")}
    )
    out = R.evolution_scores(rows)
    return out.select("trajectory", *[F.round(c, 6).alias(c) for c in (*R.EVOLVE_WEIGHTS, "raw", "reward")], F.array_join("caps", ",").alias("caps"))


_SIDES = """r AS (SELECT user_id AS case_id, event_type = 'click' AS seed, round(avg(value) + 3e-8, 4) AS v, count(*) % 7 <> 0 AS ok FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
    p AS (SELECT case_id, max(CASE WHEN seed AND ok THEN v END) AS a, max(CASE WHEN NOT seed AND ok THEN v END) AS b, concat_ws('; ', max(CASE WHEN seed AND NOT ok THEN 'seed failed' END), max(CASE WHEN NOT seed AND NOT ok THEN 'evolved failed' END)) AS error FROM r GROUP BY case_id)"""


def _sides(spark, sf_dir):
    """Clicks as results of seeds, purchases as those of evolved records; some fail."""
    rows = _table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    side = F.when(F.col("event_type") == "click", "seed").otherwise("evolved")
    rows = rows.groupBy(F.col("user_id").alias("case_id"), side.alias("side")).agg(F.round(F.avg("value") + OFF_TIES, 4).alias("metric"), (F.count("*") % 7 != 0).alias("ok"))
    return R.eval_pairs(rows.withColumn("error", F.when(F.col("ok"), "").otherwise(F.concat("side", F.lit(" failed")))))


@query(f"WITH {_SIDES} SELECT case_id, a AS seed, b AS evolved, round(b - a, 6) AS delta, (b - a) IS NOT NULL AS ok, error FROM p")
def eval_pairs(spark, sf_dir):
    return _sides(spark, sf_dir).withColumn("delta", F.round("delta", 6))


@query(
    f"""WITH {_SIDES}, q AS (SELECT *, (b - a) IS NOT NULL AS ok FROM p) SELECT count(*) AS n, count(b - a) AS n_scored, round(median(a) FILTER (ok), 6) AS median_seed_metric, round(median(b) FILTER (ok), 6) AS median_evolved_metric,
    round(median(b - a), 6) AS median_delta, round(coalesce(avg((b > a)::INTEGER), 0), 6) AS improved_share FROM q"""
)
def eval_window_median(spark, sf_dir):
    out = R.eval_window(_sides(spark, sf_dir))
    return out.select("n", "n_scored", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(
    """WITH z AS (SELECT vec_id, embedding AS r, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + (i % 3) * 0.05::DOUBLE) AS t FROM embeddings),
    u AS (SELECT vec_id, unnest(r)::DOUBLE AS r, unnest(t) AS t, generate_subscripts(r, 1) AS i FROM z),
    s AS (SELECT vec_id, sum(t - r) AS lr, avg(abs(t - r)) AS mean FROM u WHERE i % 4 <> 0 GROUP BY vec_id)
    SELECT vec_id, round(lr, 6) AS log_ratio, round(least(2, greatest(0.5::DOUBLE, exp(lr))), 6) AS clipped_ratio, lr < ln(0.5::DOUBLE) OR lr > ln(2.0::DOUBLE) AS was_clipped, round(mean, 6) AS mean_abs_logprob_delta FROM s"""
)
def tis_masked(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("r"))
    e = e.withColumns({"t": F.transform("r", lambda x, i: x + ((i + 1) % 3) * 0.05), "m": F.transform("r", lambda x, i: F.when((i + 1) % 4 != 0, 1).otherwise(0))})
    c = e.select("vec_id", R.sequence_correction(F.col("r"), F.col("t"), F.col("m")).alias("c"))
    return c.select("vec_id", F.round("c.log_ratio", 6).alias("log_ratio"), F.round("c.clipped_ratio", 6).alias("clipped_ratio"), "c.was_clipped", F.round("c.mean_abs_logprob_delta", 6).alias("mean_abs_logprob_delta"))


@query(
    """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS r, generate_subscripts(embedding, 1) AS i FROM embeddings),
    s AS (SELECT vec_id, sum((i % 3) * 0.05::DOUBLE * (vec_id % 2)) AS lr, avg((i % 3) * 0.05::DOUBLE * (vec_id % 2)) AS mean FROM u WHERE i % 4 <> 0 GROUP BY vec_id)
    SELECT count(*) AS sample_count, round(avg(mean), 6) AS mean_abs_logprob_delta, round(avg((lr > ln(2.0::DOUBLE))::INTEGER), 6) AS clip_rate, 2.0::DOUBLE AS threshold, avg(mean) >= 0.02 AS recommended,
        CASE WHEN avg(mean) >= 0.02 THEN 'systematic rollout/training log-prob gap' ELSE 'gap below enable threshold' END AS reason FROM s"""
)
def correction_diagnostics(spark, sf_dir):
    """Half of the samples agree; the others are off by up to 0.1 a token."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("rollout_log_probs"))
    off = lambda x, i: x + ((i + 1) % 3) * 0.05 * (F.col("vec_id") % 2)
    e = e.withColumns({"training_log_probs": F.transform("rollout_log_probs", off), "response_mask": F.transform("rollout_log_probs", lambda x, i: F.when((i + 1) % 4 != 0, 1).otherwise(0))})
    out = R.correction_report(e)
    return out.select("sample_count", F.round("mean_abs_logprob_delta", 6).alias("mean_abs_logprob_delta"), F.round("clip_rate", 6).alias("clip_rate"), "threshold", "recommended", "reason")


@query("SELECT vec_id, CAST(least(len(embedding), vec_id % 40 + 1) AS INTEGER) AS n_kept, CAST(embedding[least(len(embedding), vec_id % 40 + 1)] AS DOUBLE) AS last_kept FROM embeddings")
def truncated_response(spark, sf_dir):
    """Responses cut to a length that each row has."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", R.truncated(F.col("embedding"), (F.col("vec_id") % 40 + 1).cast("int")).alias("kept"))
    return rows.select("vec_id", F.size("kept").alias("n_kept"), F.element_at("kept", -1).cast("double").alias("last_kept"))


@query(
    """WITH s AS (SELECT conv_id, turn, role, length(text) % 5 AS n FROM conversations)
    SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS n_trained FROM s GROUP BY conv_id"""
)
def mask_flatten(spark, sf_dir):
    n = (F.length("text") % 5).cast("int")
    ids = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.when(F.col("role") == "assistant", "model").otherwise("tool").alias("type"), ids.alias("token_ids")).alias("s"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("segments"))
    tokens, mask = R.response_mask(F.col("segments"))
    return rows.select("conv_id", F.size(tokens).cast("long").alias("n_tokens"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("n_trained"))


@query(
    """WITH l AS (SELECT user_id, event_type, event_id, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value > 20)
    SELECT user_id, event_type, event_id, value FROM l WHERE n = 1"""
)
def ledger_latest(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("entry_id"), F.col("ts").alias("created_at"), "value", (F.col("value") > 20).alias("ok"))
    return R.latest_success(log, ["user_id", "event_type"]).select("user_id", "event_type", F.col("entry_id").alias("event_id"), "value")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN CAST(doc_id % 60 + 1 AS VARCHAR) ELSE '' END AS undeclared FROM documents"""
)
def undeclared_params(spark, sf_dir):
    rows = _cases(spark, sf_dir).withColumn("gold", F.when(F.col("doc_id") % 4 == 3, F.col("gold").withField("windows", F.array().cast("array<int>"))).otherwise(F.col("gold")))
    return rows.select("doc_id", F.array_join(F.transform(R.undeclared(F.col("gold")), lambda n: n.cast("string")), ",").alias("undeclared"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'neutralization_missing_in_expr' ELSE '' END AS issues, CASE WHEN doc_id % 5 < 3 THEN '' ELSE CAST(doc_id % 60 + 1 AS VARCHAR) END AS uncited FROM documents"""
)
def declaration_issues(spark, sf_dir):
    gold = F.col("gold")
    text = lambda a: F.array_join(F.transform(a, lambda n: n.cast("string")), ",")
    return _cases(spark, sf_dir).select("doc_id", F.array_join(R.declaration_issues(gold), ",").alias("issues"), text(R.uncited(gold)).alias("uncited"))


_EXPRESSIONS = {
    "RANK($close)": "ok", "COUNT($close)": "ok", "FOO($close)": "unknown func FOO", "$clsoe": "unknown var $clsoe", "import os": "forbidden token", "  ": "empty expr", "foo($close) + E": "ok",
    "RANK($close": "ok", "TS_MEAN($volume, 5) * eval(1)": "forbidden token", "LOG($amount) + Ts_Mean": "ok",
}


@query(
    "SELECT doc_id, "
    + "list_extract([" + ", ".join(f"'{e}'" for e in _EXPRESSIONS) + f"], doc_id % {len(_EXPRESSIONS)} + 1) AS expr, "
    + "list_extract([" + ", ".join(f"'{r}'" for r in _EXPRESSIONS.values()) + f"], doc_id % {len(_EXPRESSIONS)} + 1) AS reason FROM documents"
)
def expression_check(spark, sf_dir):
    """The loose whitelist over a column of expressions."""
    given = F.array(*[F.lit(x) for x in _EXPRESSIONS])
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.element_at(given, (F.col("doc_id") % len(_EXPRESSIONS) + 1).cast("int")).alias("expr"))
    return rows.select("doc_id", "expr", E.listed(F.col("expr"))["reason"].alias("reason"))


@query("SELECT doc_id FROM documents WHERE doc_id % 6 = 0")
def leak_ids(spark, sf_dir):
    """Keys in both splits: every second row of one split, every third of the other."""
    d = _table(spark, sf_dir, "documents").select("doc_id")
    train, holdout = d.where("doc_id % 2 = 0").withColumn("split", F.lit("train")), d.where("doc_id % 3 = 0").withColumn("split", F.lit("holdout"))
    return R.leaked(train.unionByName(holdout), "doc_id")


@query("SELECT vec_id, vec_id % 5 NOT IN (1, 2, 3) AS fits FROM embeddings")
def valid_masks(spark, sf_dir):
    """Masks that fit, of the wrong length, with a 2, with no 1, and empty responses."""
    n, ids = F.col("vec_id") % 5, F.col("embedding")
    ones = F.transform(ids, lambda x: F.lit(1))
    mask = F.when(n == 1, F.slice(ones, 2, F.size(ones))).when(n == 2, F.transform(ids, lambda x: F.lit(2))).when(n == 3, F.transform(ids, lambda x: F.lit(0))).otherwise(ones)
    return _table(spark, sf_dir, "embeddings").select("vec_id", R.valid_mask(ids, mask, ids).alias("fits"))


@query("SELECT doc_id, 20 AS bars, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 20 END AS step FROM documents")
def rebalance_bars(spark, sf_dir):
    """Bars between two rebalances, by name."""
    bars = lambda c: R.lookup(R.STEP_BARS, F.col(c))
    return _cases(spark, sf_dir).select("doc_id", bars("gold.rebalance").alias("bars"), bars("gold.frequency").alias("step"))


_ANSWERED = "doc_id % 3 <> 2"


def _answered(spark, sf_dir):
    """Records in fenced, bare and broken answers."""
    rows, n = _cases(spark, sf_dir), F.col("doc_id") % 3
    body = F.to_json(F.col("gold").withField("windows", F.transform(F.col("gold.windows"), lambda w: w.cast("string"))))
    answer = F.when(n == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(n == 1, F.concat(F.lit("It is "), body, F.lit(" ."))).otherwise(F.substring(body, 1, 20))
    return rows.withColumn("pred", X.parse_spec(answer))


@query(f"SELECT doc_id, CASE WHEN {_ANSWERED} THEN {_spec_sql(':', ',')} END AS record FROM documents")
def parse_answers(spark, sf_dir):
    """Whole records out of answers, evidence and all."""
    return _answered(spark, sf_dir).select("doc_id", T.spec_json(F.col("pred")).alias("record"))


@query(
    f"""SELECT doc_id, CASE WHEN NOT {_ANSWERED} THEN 0 WHEN {_CITED} THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS reward,
    CASE WHEN {_ANSWERED} THEN '' ELSE 'invalid_json_cap: could not parse FactorSpec JSON' END AS reasons FROM documents"""
)
def score_rows(spark, sf_dir):
    """Answers read and scored."""
    rows = R.scored(_answered(spark, sf_dir))
    reasons = F.array_join(F.transform(F.map_entries("cap_reasons"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return rows.select("doc_id", F.round("reward", 6).alias("reward"), reasons.alias("reasons"))


def _labelled(spark, sf_dir):
    """Cases as they are read from files, split by the labels."""
    split = F.when(F.col("quality") == 1, "train").otherwise("holdout")
    rows = _cases(spark, sf_dir).join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    text = F.lit(None).cast("string")
    meta = F.struct(F.col("doc_id").cast("string").alias("doc_id"), *[text.alias(c) for c in ("source_path", "source_format", "title")], F.lit("").alias("institution"), F.lit("").alias("series"), *[text.alias(c) for c in ("published_at", "content_hash")])
    return rows.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("case_id"), "report", "gold", split.alias("split"), F.lit(4).alias("max_steps"), F.lit("v1").alias("version"), F.lit("").alias("notes"), F.lit("").alias("group_id"), meta.alias("document"))


def _messages(messages, *parts):
    """The parts of all messages, hashed; nulls are empty."""
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat_ws("|", *[F.coalesce(p(m), F.lit("")) for p in parts])), chr(1)), 256)


def _message_hash(*messages: str) -> str:
    """SQL of the same hash; each message is the SQL of its parts, joined."""
    return "sha256(" + " || chr(1) || ".join(f"({m})" for m in messages) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_message(role: str, content: str, call: str = "''", arguments: str = "''", answers: str = "''") -> str:
    return f"concat_ws('|', '{role}', {content}, {call}, {arguments}, {answers})"


_PARTS = (
    lambda m: m["role"],
    lambda m: m["content"],
    lambda m: m["tool_calls"][0]["function"]["name"],
    lambda m: m["tool_calls"][0]["function"]["arguments"],
    lambda m: F.coalesce(m["tool_call_id"], m["tool_calls"][0]["id"]),
)
_REPORT = f"'We rank closes ' || {_QUOTE} || '. ' || text"
_KEY = "'k' || doc_id"
_PAYLOAD = f"""'{{"spec": ' || {_spec_sql(": ", ", ")} || '}}'"""
_PAGED = "doc_id % 7 < 5"
_LOOK = f"CASE WHEN {_PAGED} THEN 'read_report_pages' ELSE 'search_report' END"
_LOOKED = f"""CASE WHEN {_PAGED} THEN '{{"page_start": ' || doc_id % 3 || ', "page_end": ' || doc_id % 3 || '}}' ELSE '{{"query": "' || {_QUOTE} || '", "limit": 5}}' END"""
_HEAD = [_sql_message("system", _quoted(T.EXTRACT_SYSTEM)), _sql_message("user", f"{_quoted(T.EXTRACT_USER[0])} || {_REPORT} || {_quoted(T.EXTRACT_USER[1])}")]
_READ = [
    _sql_message("assistant", "''", _LOOK, _LOOKED, f"{_KEY} || '-read'"),
    _sql_message("tool", f"""'{{"ok": true, "evidence": ' || {_evidence_sql(": ", ", ")} || '}}'""", answers=f"{_KEY} || '-read'"),
]
_CHECK = [_sql_message("assistant", "''", "'validate_factor_spec'", _PAYLOAD, f"{_KEY} || '-validate'"), _sql_message("tool", _quoted(T.VALIDATED), answers=f"{_KEY} || '-validate'")]
_REPLY = [_sql_message("assistant", _spec_sql(":", ","))]
_EVOLVE = [
    _sql_message("system", _quoted(T.EVOLVE_SYSTEM)),
    _sql_message("user", f"{_quoted(T.EVOLVE_SFT_USER[0])} || {_spec_sql(':', ',')} || {_quoted(T.EVOLVE_SFT_USER[1])}"),
    _sql_message("assistant", "''", "'validate_expr'", _PAYLOAD, f"{_KEY} || '-validate-expr'"),
    _sql_message("tool", _quoted(T.LEGAL), answers=f"{_KEY} || '-validate-expr'"),
    *_REPLY,
]


def _sft_sql(stage: str, mask: str, messages: str) -> str:
    return f"""SELECT {_KEY} AS case_id, CAST(doc_id AS VARCHAR) AS group_id, 'train' AS split, '{stage}' AS stage, '{stage}_lora' AS adapter, 'factor_{stage}' AS data_source, {mask} AS mask,
        sha256({_spec_sql(":", ",")}) AS response_sha256, {messages} AS messages_sha256 FROM documents JOIN labels USING (doc_id) WHERE quality = 1"""


def _sft(spark, sf_dir, stage):
    rows = T.sft_rows(_labelled(spark, sf_dir), stage)
    mask = F.array_join(F.transform("message_loss_mask", lambda m: m.cast("string")), "")
    info = [F.col(f"extra_info.{c}").alias(c) for c in ("case_id", "group_id", "split", "stage", "adapter")]
    return rows.select(*info, "data_source", mask.alias("mask"), F.sha2("response", 256).alias("response_sha256"), _messages(F.col("messages"), *_PARTS).alias("messages_sha256"))


@query(_sft_sql("extract", f"CASE WHEN {_CITED} THEN '0010101' ELSE '00101' END", f"CASE WHEN {_CITED} THEN {_message_hash(*_HEAD, *_READ, *_CHECK, *_REPLY)} ELSE {_message_hash(*_HEAD, *_CHECK, *_REPLY)} END"))
def sft_extract(spark, sf_dir):
    """Supervised rows: every message, tool call and mask."""
    return _sft(spark, sf_dir, "extract")


@query(_sft_sql("evolve", "'00101'", _message_hash(*_EVOLVE)))
def sft_evolve(spark, sf_dir):
    return _sft(spark, sf_dir, "evolve")


def _grpo(spark, sf_dir, stage):
    cases = _labelled(spark, sf_dir)
    entries = cases.where(F.col("gold.frequency") != "daily").select("case_id", F.concat(F.lit("batch/"), "case_id").alias("case_path"), F.create_map(F.lit("gold"), F.sha2("case_id", 256)).alias("content_hashes"))
    rows = T.grpo_rows(cases, stage, entries)
    truth = lambda path: F.get_json_object("reward_model.ground_truth", path)
    return rows.select(
        F.col("extra_info.case_id").alias("case_id"), F.col("extra_info.stage").alias("stage"), F.col("extra_info.adapter").alias("adapter"), "data_source", F.col("extra_info.case_path").alias("case_path"),
        F.col("extra_info.content_hashes")["gold"].alias("gold_hash"), _messages(F.col("prompt"), lambda m: m["role"], lambda m: m["content"]).alias("prompt_sha256"),
        truth("$.case_id").alias("truth_id"), F.sha2(truth("$.report"), 256).alias("report_sha256"), truth("$.gold.windows[0]").alias("first_window"), truth("$.document.doc_id").alias("truth_doc"), truth("$.max_steps").alias("max_steps"),
    )


def _grpo_sql(stage: str, system: str, user: str) -> str:
    return f"""SELECT {_KEY} AS case_id, '{stage}' AS stage, '{stage}_lora' AS adapter, 'factor_{stage}' AS data_source, CASE WHEN doc_id % 3 <> 0 THEN 'batch/' || {_KEY} END AS case_path,
        CASE WHEN doc_id % 3 <> 0 THEN sha256({_KEY}) END AS gold_hash, sha256('system|' || {_quoted(system)} || chr(1) || 'user|' || {user}) AS prompt_sha256,
        {_KEY} AS truth_id, sha256({_REPORT}) AS report_sha256, CAST({_W} AS VARCHAR) AS first_window, CAST(doc_id AS VARCHAR) AS truth_doc, '4' AS max_steps
        FROM documents JOIN labels USING (doc_id) WHERE quality = 1"""


@query(_grpo_sql("extract", T.EXTRACT_SYSTEM, f"{_quoted(T.EXTRACT_USER[0])} || {_REPORT} || {_quoted(T.EXTRACT_USER[1])}"))
def grpo_extract(spark, sf_dir):
    """Prompt rows with their cases as ground truth and what a manifest adds."""
    return _grpo(spark, sf_dir, "extract")


@query(_grpo_sql("evolve", T.EVOLVE_SYSTEM, f"{_quoted(T.EVOLVE_GRPO_USER[0])} || {_spec_sql(':', ',')} || {_quoted(T.EVOLVE_GRPO_USER[1])}"))
def grpo_evolve(spark, sf_dir):
    return _grpo(spark, sf_dir, "evolve")


@query(
    f"""SELECT {_KEY} AS case_id, CASE WHEN doc_id % 7 = 0 THEN 0.0::DOUBLE WHEN doc_id % 7 = 3 AND doc_id % 2 = 0 THEN 0.82::DOUBLE ELSE 0.9::DOUBLE END
    + CASE WHEN doc_id % 7 <> 0 AND {_CITED} THEN 0.1::DOUBLE ELSE 0 END AS reward FROM documents JOIN labels USING (doc_id) WHERE quality = 1"""
)
def hook_scores(spark, sf_dir):
    """The reward hook over prompt rows: the ground truth's record as the answer, or nothing that can be read, or another universe."""
    rows = T.grpo_rows(_labelled(spark, sf_dir)).select("extra_info.case_id", "reward_model.ground_truth")
    n, truth = F.substring("case_id", 2, 20).cast("long"), F.get_json_object("ground_truth", "$.gold")
    answer = F.when(n % 7 == 0, "I cannot say.").when(n % 7 == 3, F.replace(truth, F.lit("CSI300"), F.lit("CSI500"))).otherwise(truth)
    out = T.answer_scores(rows.withColumn("solution_str", answer))
    return out.select("case_id", F.round("reward", 6).alias("reward"))


def _flawed(rows):
    """Labels of which some have an illegal expression or a quotation that their report does not hold."""
    n, gold = F.substring("case_id", 2, 20).cast("long"), F.col("gold")
    misquoted = F.transform(gold["evidence"], lambda e: e.withField("quote", F.lit("no such quote")))
    return rows.withColumn("gold", F.when(n % 7 == 0, gold.withField("expr", F.lit("import os"))).when(n % 7 == 3, gold.withField("evidence", misquoted)).otherwise(gold))


_LABEL_REWARD = f"CASE WHEN doc_id % 7 = 0 THEN 0.15::DOUBLE WHEN doc_id % 7 = 3 AND {_CITED} THEN 0.2::DOUBLE WHEN {_CITED} THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END"


@query(f"SELECT {_KEY} AS case_id, NOT (doc_id % 7 = 0 OR doc_id % 7 = 3 AND {_CITED}) AS passed, {_LABEL_REWARD} AS reward FROM documents JOIN labels USING (doc_id)")
def dry_run(spark, sf_dir):
    """Every case with its label as the answer; labels that are not sound do not pass."""
    return T.dry_run(_flawed(_labelled(spark, sf_dir))).select("case_id", "passed", F.round("reward", 6).alias("reward"))


_HOLD = f"SELECT CAST(doc_id AS VARCHAR) AS g, {_LABEL_REWARD} AS reward, CASE WHEN {_CITED} AND doc_id % 7 <> 3 THEN 1.0::DOUBLE ELSE 0 END AS cited FROM documents JOIN labels USING (doc_id) WHERE quality <> 1"


@query(
    f"""WITH h AS ({_HOLD}) SELECT 'group' AS level, g AS "group", 1 AS n, reward AS mean_reward, cited AS grounding_mean FROM h
    UNION ALL SELECT 'pooled', NULL, count(*), round(avg(reward), 6), round(avg(cited), 6) FROM h UNION ALL SELECT 'median', NULL, count(*), median(reward), NULL FROM h"""
)
def holdout_report(spark, sf_dir):
    out = T.holdout_report(_flawed(_labelled(spark, sf_dir)))
    return out.select("level", "group", "n", *[F.round(c, 6).alias(c) for c in ("mean_reward", "grounding_mean")])


@query(
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'f' || doc_id WHEN 1 THEN 'g' || doc_id WHEN 2 THEN 'f' || doc_id END AS name,
    CASE doc_id % 4 WHEN 0 THEN 'RANK($close / TS_MEAN($close, ' || {_W} || '))' WHEN 1 THEN 'RANK($open)' WHEN 2 THEN '-$close' END AS expr,
    CASE WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN 'universe,frequency' ELSE '' END AS drift FROM documents"""
)
def candidates(spark, sf_dir):
    """What tool calls propose: whole records, in them or around the seed; and which frozen fields they change."""
    rows, n, gold = _cases(spark, sf_dir), F.col("doc_id"), F.col("gold")
    moved = gold.withField("universe", F.lit("ALL")).withField("frequency", F.when(gold["frequency"] == "daily", "weekly").otherwise("daily"))
    whole = T.spec_json(F.when(n % 8 == 0, moved).otherwise(gold))
    payload = (
        F.when(n % 4 == 0, F.concat(F.lit('{"spec":'), whole, F.lit("}")))
        .when(n % 4 == 1, F.concat(F.lit('{"factor_expr":"RANK($open)","factor_name":"g'), n.cast("string"), F.lit('"}')))
        .when(n % 4 == 2, '{"spec":{"factor_expr":"-$close"}}')
        .otherwise('{"name":"no record"}')
    )
    found = rows.withColumn("c", X.candidate(payload, gold))
    drift = F.when(F.col("c").isNotNull(), F.array_join(R.spec_drift(gold, F.col("c")), ",")).otherwise("")
    return found.select("doc_id", "c.name", "c.expr", drift.alias("drift"))


@query(
    """WITH e AS (SELECT doc_id, doc_id % 600 AS a, doc_id % 9 + 1 AS b FROM documents)
    SELECT doc_id, a BETWEEN 1 AND 504 AND doc_id % 11 <> 5 AS ok, CASE WHEN a BETWEEN 1 AND 504 AND doc_id % 11 <> 5 THEN CASE doc_id % 3 WHEN 0 THEN 'close' WHEN 1 THEN 'close,volume' ELSE 'open' END END AS fields,
        CASE WHEN a BETWEEN 1 AND 504 AND doc_id % 11 <> 5 THEN CAST(CASE doc_id % 3 WHEN 0 THEN a WHEN 1 THEN greatest(a, b) ELSE a + b END AS INTEGER) END AS max_lookback FROM e"""
)
def validated_expressions(spark, sf_dir):
    """A column of expressions read by the strict language."""
    a, b = (F.col("doc_id") % 600).cast("string"), (F.col("doc_id") % 9 + 1).cast("string")
    one = F.concat(F.lit("RANK(TS_MEAN($close, "), a, F.lit("))"))
    two = F.concat(F.lit("ts_sum($volume, "), b, F.lit(".0) / (1 - 1) + DELTA($close, "), a, F.lit(")"))
    three = F.concat(F.lit("-TS_STD(DELAY($open, "), b, F.lit("), "), a, F.lit(")"))
    n = F.col("doc_id") % 3
    rows = _table(spark, sf_dir, "documents").select("doc_id", E.validated(F.when(F.col("doc_id") % 11 == 5, F.concat(F.lit("COUNT($close) + "), one)).when(n == 0, one).when(n == 1, two).otherwise(three)).alias("v"))
    return rows.select("doc_id", "v.ok", F.array_join("v.fields", ",").alias("fields"), "v.max_lookback")


@query(
    f"""SELECT doc_id, {_NUMERAL} || '日，' || text AS raw, CAST({_W} AS BIGINT) AS numeral,
        replace({_NUMERAL} || '日', {_NUMERAL}, {_NUMERAL} || '(' || {_W} || ')') AS normal FROM documents"""
)
def numerals_in_text(spark, sf_dir):
    """Chinese numerals before each text: their values, and the text that shows them."""
    rows = _cases(spark, sf_dir).select("doc_id", F.regexp_extract(F.when(F.col("doc_id") % 4 == 2, F.col("report")), "过去(.*?)日", 1).alias("_"), F.element_at("gold.windows", 1).alias("w"))
    ones = lambda k: F.substring(F.lit("一二三四五六七八九"), k, F.lit(1))
    w = F.col("w")
    written = F.concat(F.when(w < 10, "").when(w < 20, "十").otherwise(F.concat(ones((w / 10).cast("int")), F.lit("十"))), F.when(w % 10 > 0, ones(w % 10)).otherwise(""))
    rows = rows.join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.concat(written, F.lit("日，"), "text").alias("raw"))
    return rows.select("doc_id", "raw", F.element_at(X.numerals(F.substring_index("raw", "，", 1)), 1).alias("numeral"), F.substring_index(X.with_numerals("raw"), "，", 1).alias("normal"))


@query(
    f"""WITH {_CHUNK} SELECT doc_id, chunk_no, doc_id % 9 AS page FROM ch WHERE doc_id % 9 BETWEEN 2 AND 4"""
)
def page_range(spark, sf_dir):
    """Chunks of the pages asked for; every ninth document has no pages."""
    rows = X.chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("page_start", F.nullif(F.col("doc_id") % 9, F.lit(0)))
    return P.page_range(rows, 2, 4).select("doc_id", "chunk_no", F.col("page_start").alias("page"))


_TOOL = "CASE doc_id % 5 WHEN 0 THEN 'search_report' WHEN 1 THEN 'read_report_pages' WHEN 2 THEN 'validate_factor_spec' WHEN 3 THEN 'search_report' ELSE 'other' END"


def _tool_rows(spark, sf_dir):
    """A call for each document and the chunks of all of them, every fourth of which has no page."""
    rows, n = _cases(spark, sf_dir), F.col("doc_id")
    pieces = X.chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    page = F.when(n % 4 != 0, F.col("chunk_no") + 1)
    chunks = pieces.select("doc_id", X.chunk_id(F.lit(None).cast("int"), F.col("chunk_no")).alias("chunk_id"), F.col("chunk").alias("text"), page.alias("page_start"), page.alias("page_end"), "char_start", "char_end")
    whole = F.concat(F.lit('{"spec":'), T.spec_json(F.col("gold")), F.lit("}"))
    arguments = F.when(n % 5 == 0, '{"query":" E ","limit":2}').when(n % 5 == 1, '{"page_start":2,"page_end":"3"}').when(n % 5 == 2, whole).when(n % 5 == 3, "not json").otherwise("{}")
    names = F.array(*[F.lit(x) for x in ("search_report", "read_report_pages", "validate_factor_spec", "search_report", "other")])
    calls = rows.select(n.alias("call_id"), "doc_id", F.col("doc_id").alias("trajectory"), F.lit(0).alias("step"), F.element_at(names, (n % 5 + 1).cast("int")).alias("name"), arguments.alias("arguments"))
    return calls, chunks


@query(
    f"""WITH {_CHUNK}, h AS (SELECT doc_id, count(*) FILTER (contains(lower(chunk), 'e')) AS with_e, count(*) FILTER (doc_id % 4 <> 0 AND chunk_no BETWEEN 1 AND 2) AS paged FROM ch GROUP BY doc_id)
    SELECT doc_id, {_TOOL} AS name, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN NOT ({_CITED}) ELSE false END AS ok,
        CASE doc_id % 5 WHEN 0 THEN least(2, coalesce(with_e, 0)) WHEN 1 THEN coalesce(paged, 0) END AS n_found,
        CASE WHEN doc_id % 5 = 2 THEN CASE WHEN {_CITED} THEN '["p0-c0000"]' ELSE '[]' END END AS citation_errors,
        CASE doc_id % 5 WHEN 3 THEN 'unparsable_arguments' WHEN 4 THEN 'unknown_tool' END AS illegal_kind FROM documents LEFT JOIN h USING (doc_id)"""
)
def tool_results(spark, sf_dir):
    """Calls of a report's tools, answered from its chunks; no report quotes its case's label."""
    out = tools.observed(*_tool_rows(spark, sf_dir))
    n = F.col("doc_id") % 5
    listed = F.when(n == 0, F.get_json_object("result", "$.matches[*].chunk_id")).when(n == 1, F.get_json_object("result", "$.chunks[*].chunk_id"))
    found = F.when(n < 2, F.coalesce(F.regexp_count(listed, F.lit("p0-c")), F.lit(0)).cast("long"))
    return out.select("doc_id", "name", "ok", found.alias("n_found"), F.get_json_object("result", "$.citation_errors").alias("citation_errors"), "illegal_kind")


@query(
    """WITH p AS (SELECT conv_id, turn, text FROM conversations)
    SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS joined_sha256 FROM p GROUP BY conv_id"""
)
def joined_pages(spark, sf_dir):
    """Turns as the pages of a document."""
    rows = X.joined_pages(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", F.sha2("text", 256).alias("joined_sha256"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' WHEN turn % 2 = 0 THEN 'validate_expr:{"n":' || turn || '}' ELSE 'evaluate_factor:{},validate_expr:{"m":1}' END AS calls, turn % 5 = 4 AS failed FROM conversations"""
)
def text_tool_calls(spark, sf_dir):
    """Tool calls written into turns, one, two or broken."""
    t = F.col("turn")
    one = F.concat(F.lit('<tool_call>{"id":"x","function":{"name":"validate_expr","arguments":{"n":'), t.cast("string"), F.lit("}}}</tool_call>"))
    two = F.lit('<tool_call> {"name":"evaluate_factor"} </tool_call> then <tool_call>{"name":"validate_expr","parameters":{"m":1}}</tool_call>')
    said = F.concat("text", F.when(t % 5 == 4, F.lit("<tool_call>{broken}</tool_call>")).when(t % 2 == 0, one).otherwise(two))
    rows = _table(spark, sf_dir, "conversations").withColumn("said", said)
    calls = F.array_join(F.transform(X.tool_calls(F.col("said")), lambda c: F.concat(c["name"], F.lit(":"), c["arguments"])), ",")
    return rows.select("conv_id", "turn", calls.alias("calls"), X.tool_call_error(F.col("said")).isNotNull().alias("failed"))


@query(
    f"""WITH {_CHUNK}, k2 AS (SELECT doc_id, chunk_no, substring(chunk, 1, 12) AS q FROM ch)
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'p9-c0000' ELSE 'p0-c' || lpad(CAST(chunk_no AS VARCHAR), 4, '0') END AS chunk_id,
        CASE WHEN doc_id % 3 = 0 THEN 'not in it: ' || q ELSE q END AS quote FROM k2 WHERE doc_id % 4 = 0 OR doc_id % 3 = 0"""
)
def citation_errors(spark, sf_dir):
    """Evidence that names an unknown chunk or quotes what its chunk does not hold."""
    rows = X.chunks(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("chunk_id", X.chunk_id(F.lit(None).cast("int"), F.col("chunk_no")))
    n, quote = F.col("doc_id"), F.substring("chunk", 1, 12)
    span = F.struct(
        F.when(n % 4 == 0, "p9-c0000").otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(n % 3 == 0, F.concat(F.lit("not in it: "), quote)).otherwise(quote).alias("quote")
    )
    specs = rows.select("doc_id", F.struct(F.array(span).alias("evidence")).alias("spec"))
    return P.citation_errors(specs, rows.select("doc_id", "chunk_id", F.col("chunk").alias("text")))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN '' ELSE 'no evidence span; parameters without a citation: [' || (doc_id % 60 + 1) || ']' END AS problems FROM documents"""
)
def missing_requirements(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", F.array_join(P.missing_requirements(F.col("gold")), "; ").alias("problems"))


_INTACT = "c AS (SELECT doc_id, doc_id % 5 < 3 AS cited, doc_id % 7 = 0 AS lost FROM documents)"


def _checked(spark, sf_dir):
    """Cases of which every seventh has lost its report, and with it what it cites."""
    rows = _cases(spark, sf_dir).withColumn("report", F.when(F.col("doc_id") % 7 == 0, "gone").otherwise(F.col("report")))
    return P.integrity(rows)


@query(
    f"""WITH {_INTACT} SELECT doc_id, NOT (lost AND cited) AS intact, CASE WHEN lost AND cited THEN 'gold_replay_failed,gold_citation_not_in_report' ELSE '' END AS errors,
    CASE WHEN cited AND lost THEN 0.2::DOUBLE WHEN cited THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS gold_reward FROM c"""
)
def case_integrity(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", "intact", F.array_join("errors", ",").alias("errors"), F.round("gold_reward", 6).alias("gold_reward"))


@query(
    f"""WITH {_INTACT}, r AS (SELECT *, doc_id % 3 = 0 AS low FROM c)
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'heldout_eval' WHEN lost AND cited THEN 'quarantine' WHEN low THEN 'sft_curriculum' ELSE 'rl_main' END AS route,
        CASE WHEN NOT (lost AND cited) THEN 4 ELSE 0 END AS k FROM r"""
)
def probe_routes(spark, sf_dir):
    """Four rollouts of each intact case, their metrics and the case's route."""
    checked = _checked(spark, sf_dir).withColumns({"case_id": F.col("doc_id"), "split": F.when(F.col("doc_id") % 11 == 0, "holdout").otherwise("train")})
    n, i = F.col("case_id"), F.col("rollout")
    empty = F.array().cast("array<string>")
    rollouts = P.planned_rollouts(checked, 4).select(
        "case_id", F.when(n % 3 == 0, 0.2).otherwise(i * 0.3).alias("reward"), empty.alias("active_caps"), F.lit(1).alias("tool_calls"), F.lit(0).alias("illegal_tool_calls"),
        *[F.lit(0).alias(c) for c in ("tool_error_model", "tool_error_environment")],
        *[F.lit(False).alias(c) for c in ("parse_error", "grounding_error", "spec_drift", "backtest_failed", "max_step_hit")],
    )
    return P.probed(checked, rollouts).select("doc_id", "route", F.coalesce("k", F.lit(0)).cast("int").alias("k"))


@query(
    """WITH e AS (SELECT user_id, event_id AS n, round(least(1.0::DOUBLE, abs(value) / 100), 6) AS reward FROM events)
    SELECT count(*) AS rollout_count, count(DISTINCT user_id) AS case_count, round(avg(reward), 6) AS mean_reward, round(stddev_pop(reward), 6) AS reward_std, min(reward) AS min_reward,
        max(reward) AS max_reward, CAST(sum(n % 3 + 1) AS BIGINT) AS tool_calls, CAST(sum(n % 2) AS BIGINT) AS illegal_tool_calls, round(sum(n % 2) / sum(n % 3 + 1)::DOUBLE, 6) AS illegal_tool_call_rate,
        'invalid_citation_cap=' || count(*) FILTER (n % 9 = 0) || ',invalid_json_cap=' || count(*) FILTER (n % 4 = 0) AS caps, 'unknown_tool=' || CAST(sum(n % 2) AS BIGINT) AS kinds FROM e"""
)
def run_summary(spark, sf_dir):
    rows = _records(spark, sf_dir)
    rows = rows.withColumn("illegal_by_kind", F.when(F.col("illegal_tool_calls") > 0, F.create_map(F.lit("unknown_tool"), F.col("illegal_tool_calls"))))
    out = P.run_summary(rows)
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    plain = out.columns[:9]
    digits = ("mean_reward", "reward_std", "illegal_tool_call_rate")
    return out.select(*[F.round(c, 6).alias(c) if c in digits else c for c in plain], text("hard_cap_distribution").alias("caps"), text("illegal_tool_call_kinds").alias("kinds"))


@query(
    """WITH r AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders),
    y AS (SELECT unnest(generate_series(year(a), year(z))) AS y, a, z FROM r),
    d AS (SELECT make_date(y, 6, 30) AS date, a, z FROM y UNION ALL SELECT make_date(y, 12, 31), a, z FROM y)
    SELECT date FROM d WHERE date BETWEEN a AND z UNION SELECT a FROM r UNION SELECT z FROM r"""
)
def adjustment_dates(spark, sf_dir):
    span = _table(spark, sf_dir, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("z"))
    return P.adjustment_dates(span, "a", "z")


@query(
    """WITH e AS (SELECT user_id, event_id, round(value, 4) AS metric FROM events WHERE event_type <> 'error' AND value IS NOT NULL)
    SELECT user_id AS trajectory, event_id AS turn, metric FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY metric DESC, event_id) = 1"""
)
def best_candidate(spark, sf_dir):
    return P.best_candidate(_turns(spark, sf_dir))


@query(
    """SELECT event_id, event_id % 3 <> 2 AS ok, CASE event_id % 3 WHEN 0 THEN round(value, 4) WHEN 1 THEN 0.5::DOUBLE END AS metric,
    CASE WHEN event_id % 3 = 2 THEN 'environment' END AS error_source, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 2 END AS n_metrics, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS n_reported FROM events"""
)
def metric_results(spark, sf_dir):
    """Metrics of a service's answer, with its second name for the metric and a text that is no number."""
    n, v = F.col("event_id"), F.round("value", 4).cast("string")
    pairs = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    given = F.when(n % 3 == 0, pairs("Information_Ratio_with_cost", v, "turnover", "0.25", "note", "n/a")).when(n % 3 == 1, pairs("IR", "0.5", "turnover", "1e-1")).otherwise(pairs("turnover", "0.1"))
    rows = _table(spark, sf_dir, "events").select("event_id", P.metric_result(given, "score").alias("r"))
    return rows.select("event_id", "r.ok", "r.metric", "r.error_source", F.size("r.metrics").alias("n_metrics"), F.size(P.reported(F.col("r.metrics"))).alias("n_reported"))


#: Date columns are returned as text, which all readers of results take alike.


def _as_text(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(spark, sf_dir)
        return out.withColumns({c: F.col(c).cast("string") for c, t in out.dtypes if t == "date"})

    return dated


_DATED = {
    "panel_build": "datetime", "signal_lag": "datetime", "daily_nav": "datetime", "drawdown": "datetime", "benchmark_return": "datetime", "membership_ranges": "from to",
    "universe_semijoin": "datetime", "dedupe_snapshots": "date", "asof_industry": "datetime", "calendar_index": "datetime", "calendar_reindex": "datetime",
    "many_factors": "datetime", "shuffle_contrast": "datetime", "manifest_counts": "first_day last_day", "month_ends": "month_end", "adjustment_dates": "date",
}
_DATED |= {n: "datetime" for n, sql in ORACLES.items() if sql.endswith(") AS value FROM v")}
QUERIES = {n: _as_text(q) for n, q in QUERIES.items()}
ORACLES = {
    n: f"SELECT * REPLACE ({', '.join(f'strftime({chr(34)}{c}{chr(34)}, {chr(39)}%Y-%m-%d{chr(39)}) AS {chr(34)}{c}{chr(34)}' for c in _DATED[n].split())}) FROM ({sql})" if n in _DATED else sql
    for n, sql in ORACLES.items()
}
