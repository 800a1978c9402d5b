"""Market data from a vendor: what a source has to offer, one over a session-and-cursor API, and the preparation.

A client is given as a factory, so executors make their own; nothing here goes
to the network by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import probes as P
from ..plans.backtest import UNIVERSES
from . import downloads, files, sinks

#: How the vendor names the universes' queries and the fields of a daily bar, and forward adjustment.
QUERIES = {"CSI300": "query_hs300_stocks", "CSI500": "query_zz500_stocks"}
BAR_FIELDS = "date,code,open,high,low,close,preclose,volume,amount,adjustflag,turn,tradestatus,pctChg,isST"
ADJUST = "2"


class MarketSource(Protocol):
    """What the preparation asks of a source."""

    name: str

    def open(self) -> None: ...

    def close(self) -> None: ...

    def memberships(self, start: str, end: str, universes: Iterable[str]) -> DataFrame:
        """(universe, date, instrument) snapshots."""

    def industries(self, start: str, end: str) -> DataFrame:
        """(date, instrument, industry) snapshots."""

    def prices(self, instruments: DataFrame, start: str, end: str, cache: str | None = None) -> DataFrame:
        """Daily bars of the column ``instrument``."""


def drained(cursor: Any) -> pd.DataFrame:
    """All rows of a cursor, as texts; a code other than "0" is an error."""
    if cursor.error_code != "0":
        raise RuntimeError(f"vendor error {cursor.error_code}: {cursor.error_msg}")
    rows = []
    while cursor.next():
        rows.append(cursor.get_row_data())
    return pd.DataFrame(rows, columns=list(cursor.fields), dtype=str)


def logged_in(connect: Callable[[], Any], tries: int = 4, wait: float = 1.0) -> Any:
    """A client that is logged in; the wait doubles after each refusal."""
    client = connect()
    for attempt in range(tries):
        if (answer := client.login()).error_code == "0":
            return client
        if attempt < tries - 1:
            time.sleep(wait * 2**attempt)
    raise RuntimeError(f"login failed: {answer.error_msg}")


def _code(instrument: str) -> str:
    return f"{instrument[:2].lower()}.{instrument[2:]}"


class Session:
    """A client that logs in when it is first asked, and again after a question that failed."""

    def __init__(self, connect: Callable[[], Any], wait: float):
        self.connect, self.wait, self.client = connect, wait, None

    def bars(self, instrument: str, first: str, last: str) -> pd.DataFrame:
        if self.client is None:
            self.client = logged_in(self.connect, wait=self.wait)
        try:
            return drained(self.client.query_history_k_data_plus(_code(instrument), BAR_FIELDS, start_date=first, end_date=last, frequency="d", adjustflag=ADJUST))
        except Exception:
            self.close()
            raise

    def close(self) -> None:
        client, self.client = self.client, None
        if client is not None:
            client.logout()


class VendorSource:
    """Snapshots are asked for by the driver, one small answer a date; bars by the executors, a task for each batch.

    With a ``cache`` folder bars are kept there with the days that were asked
    for, and only days that it lacks are asked for: a run that broke goes on
    where it was, and a longer period fetches what is new.
    """

    def __init__(self, spark: SparkSession, connect: Callable[[], Any], name: str = "vendor", batch: int = 10, tries: int = 3, wait: float = 1.0, wave: int = 64):
        self.spark, self.connect, self.name, self.batch, self.tries, self.wait, self.wave = spark, connect, name, batch, tries, wait, wave
        self.client: Any = None

    def open(self) -> None:
        self.client = logged_in(self.connect, wait=self.wait)

    def close(self) -> None:
        if self.client is not None:
            self.client.logout()
            self.client = None

    def _dates(self, plan, start: str, end: str) -> list[str]:
        span = self.spark.createDataFrame([(start, end)], "a string, z string").select(F.to_date("a").alias("a"), F.to_date("z").alias("z"))
        return sorted(str(r[0]) for r in plan(span, "a", "z").collect())  # a few dates a year

    def _asked(self, query: str, dates: list[str], *columns: str) -> pd.DataFrame:
        """The answers for the dates; a row without a date has the one asked for."""
        out = []
        for day in dates:
            found = drained(getattr(self.client, query)(date=day))
            if len(found):
                at = "updateDate" if "updateDate" in found else "date"
                out.append(found.assign(date=found[at].where(found[at] != "", day))[["date", *columns]])
        if not out:
            raise RuntimeError(f"{query} has no snapshot")
        return pd.concat(out, ignore_index=True).drop_duplicates()

    def _frame(self, found: pd.DataFrame, schema: str) -> DataFrame:
        rows = self.spark.createDataFrame(found, schema)
        return rows.withColumns({"date": F.to_date("date"), "instrument": M.instrument_code(F.col("code"))}).drop("code")

    def memberships(self, start: str, end: str, universes: Iterable[str]) -> DataFrame:
        dates = self._dates(P.adjustment_dates, start, end)
        found = [self._asked(QUERIES[u], dates, "code").assign(universe=u) for u in universes]
        rows = self._frame(pd.concat(found, ignore_index=True)[["date", "code", "universe"]], "date string, code string, universe string")
        return rows.select("universe", "date", "instrument").distinct()

    def industries(self, start: str, end: str) -> DataFrame:
        dates = self._dates(M.month_ends_to, start, end)[::12]
        found = self._asked("query_stock_industry", dates, "code", "industry")
        return self._frame(found[["date", "code", "industry"]], "date string, code string, industry string").select("date", "instrument", "industry").distinct()

    def prices(self, instruments: DataFrame, start: str, end: str, cache: str | None = None) -> DataFrame:
        """Bars of the period; an instrument without any is an error, after what came of the others is kept in the cache.

        Bars are adjusted forward, so those of one instrument that were fetched at
        different times can stand on different bases; another ``cache`` folder
        fetches all of them anew.
        """
        connect, tries, wait, names = self.connect, self.tries, self.wait, BAR_FIELDS.split(",")

        def bars_of(asked: list[tuple[str, str, str]]) -> Iterator[tuple[pd.DataFrame | None, str | None]]:
            """The bars of each (instrument, first day, last day), in sessions that are opened anew after a failure."""
            session = Session(connect, wait)
            try:
                for code, first, last in asked:
                    try:
                        yield downloads.attempts(lambda: session.bars(code, first, last), tries, wait), None
                    except Exception as e:
                        yield None, str(e)
            finally:
                session.close()

        if cache is not None:
            held = downloads.RangeCache(self.spark, cache, names, self.batch, self.wave)
            keys = instruments.select(F.col("instrument").alias("key"))
            held.fill(keys, start, end, bars_of)
            return files.bars(held.rows(keys, start, end).withColumnRenamed("key", "instrument"))

        def fetch(codes: list[str]) -> pd.DataFrame:
            out = []
            for code, (rows, error) in zip(codes, bars_of([(c, start, end) for c in codes])):
                if error or rows is None or not len(rows):
                    raise RuntimeError(f"{code}: {error or 'no bars'}")
                out.append(rows.assign(instrument=code))
            return pd.concat(out, ignore_index=True)

        schema = ", ".join(f"`{c}` string" for c in [*names, "instrument"])
        return files.bars(files.fetched(instruments, fetch, schema, self.batch, 1, wait))


def prepared(source: MarketSource, path: str, start: str, end: str, universes: Iterable[str] = UNIVERSES) -> dict:
    """Fetches, joins industries as of each day, codes them, and exports with a manifest, which is returned.

    Snapshots that lie below ``path`` and cover the period are used again.
    """
    wanted = [u.upper() for u in universes]
    if other := sorted(set(wanted) - set(QUERIES)):
        raise ValueError(f"universes that cannot be fetched: {other}")
    source.open()
    try:
        spark = SparkSession.active()
        kept = {n: f"{path}/snapshots/{n}" for n in ("memberships", "industries")}
        known = all(files.exists(spark, p) for p in kept.values())
        if not known or not files.snapshots_cover(spark.read.parquet(kept["memberships"]), spark.read.parquet(kept["industries"]), start, end, wanted):
            source.memberships(start, end, wanted).write.mode("overwrite").parquet(kept["memberships"])
            source.industries(start, end).write.mode("overwrite").parquet(kept["industries"])
        members, industries = (spark.read.parquet(kept[n]) for n in kept)
        bars = source.prices(members.select("instrument").distinct(), start, end, f"{path}/bars")
        named = M.as_of(bars, industries.withColumnRenamed("date", "datetime"), "instrument", "datetime", "industry", "UNKNOWN")
        codes = M.category_codes(named, "industry")
        market = named.join(F.broadcast(codes), named.industry == codes.value).drop("industry", "value").withColumnRenamed("code", "industry")  # a code for each industry
        market.write.mode("overwrite").parquet(f"{path}/market")
    finally:
        source.close()
    sinks.export_panel(spark.read.parquet(f"{path}/market"), members, f"{path}/panel", source.name, start, end)
    return sinks.validate_manifest(spark, f"{path}/panel", start, end)
