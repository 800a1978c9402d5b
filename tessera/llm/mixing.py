"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import fresh, keys_are_unique

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    """The words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` of all sizes.  A target stops at ``most`` times the source's size
    and the excess is shared again by weight: with sources ordered by bound per
    weight, the first that no level of water reaches are at their bound and the
    rest share what is left.  Works on the aggregate of the sources only.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    bound = F.col("source_size") * F.lit(float(most))
    s = sources.withColumns({"weight": weight, "bound": bound})
    everything = W.partitionBy()
    rising = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    below = rising.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    left = F.col("total") - F.coalesce(F.sum("bound").over(below), F.lit(0.0))
    weights_left = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", left / weights_left)
    # levels fall from the first source whose bound is above its share, which sets it for all after
    level = F.max(F.when(F.col("bound") > F.col("weight") * F.col("level"), F.col("level"))).over(everything)
    target = F.least(F.col("bound"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return s.select("source", "source_size", target.alias("target"))


def drawn(seed: int, *parts):
    """A number in [0, 1) that the seed and the parts fix: 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


NAMES = ("size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, names: tuple[str, ...] = NAMES) -> DataFrame:
    """``docs`` with size, source_size, target and copies, one row a document.

    A source's rate is target / source_size; a document is emitted floor(rate)
    times and once more if the draw of its id lies below the fraction.  Where
    rows share a doc_id, null included, each draws from its id, its text and its
    place in the table, so a source made of them meets its target as well, and
    reruns agree as long as the table's files are the same.  A null text has
    size 0; null sources are one source, last.  Columns of the input that have one of
    these names are replaced; ``names`` gives the results others.  A source of
    size 0 has target 0 and no copies.  Partial sums by source leave the map
    side, so a hot source costs nothing.
    """
    size, source_size, target, copies = names
    rows = docs.drop(*names).withColumn(size, words(F.col("text")))
    key, draw = fresh(rows, "source_key", "draw")
    parts = [F.col("doc_id")]
    if not keys_are_unique(docs, "doc_id"):
        parts += [F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.withColumn(draw, drawn(seed, *parts))
    sources = rows.groupBy("source").agg(F.sum(size).alias("source_size"))
    plan = targets(sources, weights, share, most).select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    rate = F.coalesce(F.try_divide(F.col(target), F.col(source_size)), F.lit(0.0))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col(key)), "left").drop(key)
    extra = (F.col(draw) < rate - F.floor(rate)).cast("long")
    return rows.withColumn(copies, F.floor(rate).cast("long") + extra).drop(draw)


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document ``copies`` times, with the columns of ``docs`` as they are."""
    *names, each = fresh(docs, *NAMES, "copy")
    rows = mixed(docs, names=tuple(names), **options).where(F.col(names[-1]) > 0)
    return rows.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[-1])))).select(*[F.col(f"`{c}`") for c in docs.columns])
