import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tessera.functions import expression as E


@pytest.mark.parametrize("text", ["", "RANK($close) ", "COUNT($close)", "__import__('os')", "TS_MEAN($close, 0)", "TS_MEAN($close, 505)", "TS_MEAN($close, $open)", "$nope", "$", "2..5", "RANK($close", "$close $open", "x" * 4097])
def test_rejects(text):
    assert not E.validate(text)["ok"]


def test_reads():
    assert E.validate("ts_mean($close, 4)") == {"ok": True, "fields": ["close"], "max_lookback": 4}
    assert E.parse("-$close*$open") == E.Binary("*", E.Sign("-", E.Field("close")), E.Field("open"))
    tree = E.parse("DELAY(TS_SUM($close, 4), 3)")
    assert (E.lookback(tree), E.reach(tree)) == (7, 6)
    assert E.validate("TS_MEAN($close, 4.0) + .5 * 1e1 - 2.")["max_lookback"] == 4
    for text in ("1/(1-1)", "LOG(0-1)"):
        assert E.validate(text) == {"ok": True, "fields": [], "max_lookback": 0}
        with pytest.raises(E.ExpressionError):
            E.evaluable(E.parse(text))
    assert E.parse("1e+2") == E.Number(100.0) and not E.validate("1e")["ok"] and not E.validate("$close é")["ok"]
    assert E.neutralized(E.parse("RANK($close)")).name == "INDUSTRY_NEUTRALIZE"


def random_panel(seed=3, days=24, names=7):
    r = np.random.default_rng(seed)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(d), f"i{i}", float(r.integers(-3, 9)), None if r.random() < 0.1 else float(r.integers(1, 5)), float(i % 3) if i else None) for d in range(days) for i in range(names) if r.random() > 0.15 or d == 0 and i == 0]
    return pd.DataFrame(rows, columns=["datetime", "instrument", "close", "open", "industry"])


def wide(p, c):
    return p.pivot(index="datetime", columns="instrument", values=c).astype(float)


CASES = {
    "TS_MEAN($open, 3)": lambda o, c: o.rolling(3).mean(),
    "TS_STD($open, 3)": lambda o, c: o.rolling(3).std(ddof=0),
    "DELAY($open, 2)": lambda o, c: o.shift(2),
    "TS_PCTCHANGE($close, 1)": lambda o, c: (c / c.shift(1) - 1).replace([np.inf, -np.inf], np.nan),
    "RANK($close)": lambda o, c: c.rank(axis=1, pct=True),
    "RANK(TS_PCTCHANGE($close, 1))": lambda o, c: (c / c.shift(1) - 1).rank(axis=1, pct=True),
    "$open / $close": lambda o, c: o / c.replace(0, np.nan),
    "LOG($close) + ABS($close) * SIGN($close)": lambda o, c: np.log(c.where(c > 0)) + c.abs() * np.sign(c),
    "TS_SUM(TS_PCTCHANGE($close, 1), 2)": lambda o, c: (c / c.shift(1) - 1).replace([np.inf, -np.inf], np.nan).rolling(2).sum(),
}


def test_against_pandas(spark):
    from tessera.sources.panel import with_calendar

    p = random_panel()
    rows = with_calendar(spark.createDataFrame(p.astype(object).where(p.notna(), None), "datetime date, instrument string, close double, open double, industry double"))
    got = E.with_signals(rows, {f"v{i}": t for i, t in enumerate(CASES)}).toPandas()
    o, c = wide(p, "open"), wide(p, "close")
    for i, (text, want) in enumerate(CASES.items()):
        have = got.set_index(["datetime", "instrument"])[f"v{i}"].astype(float)
        want = want(o, c).stack(future_stack=True).reindex(have.index)
        assert np.allclose(have, want, equal_nan=True), text


def test_neutralize_and_null_group(spark):
    rows = spark.createDataFrame([("2024-01-01", n, 0, v, g) for n, v, g in (("a", 1.0, 0.0), ("b", 3.0, 0.0), ("c", 5.0, 1.0), ("d", 2.0, None))], "datetime string, instrument string, day_idx int, close double, industry double")
    got = {r[0]: r[1] for r in E.with_signals(rows, {"v": "INDUSTRY_NEUTRALIZE($close, $industry)"}).select("instrument", "v").collect()}
    assert got == {"a": -1.0, "b": 1.0, "c": None, "d": None}
