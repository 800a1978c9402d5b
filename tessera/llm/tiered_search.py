"""Ranked lexical search over an index in tiers of impact.

1.  Texts are cut to blocks of documents of like length, each with the postings
    of its terms: nothing is shuffled, as a document's postings stay together.
2.  With the corpus's figures (documents N, terms L) a posting's impact is known.
    Each block keeps its postings in tiers, those of high impact first, in
    columns of their own, so a search reads the tiers that it wants; and for
    each term and tier the largest impact in the tiers below, its residual bound.
3.  Items are searched tier by tier.  In a block, the impacts of the tiers read
    are added per document; a document can still gain the residual bounds of
    those terms for which it has no posting yet.  Where no document of the block
    can reach the k-th best score that the item is sure of, that is the proof
    that the tiers read are enough, and the item is done with the block.  An
    item without that proof falls through to the block's next tier; after the
    last one its scores are exact.  The first tiers of all blocks give the
    scores that an item is sure of before lower tiers are read at all.

Terms are told by 64-bit hashes of their bytes.  Items come to the tasks in
groups of about ``group_terms`` terms, each group one search over the index, so
that what is sent has a bound however many items there are; the driver holds one
group's terms, their document counts and k-th scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel as K
from .shared import NULL_ID, batch, ids_of, keyed, stage, unstage

#: Impacts from which a posting is in the first and the second tier: a term that is there twice, and once, in a text of the mean length.
TIERS = (714_285, 555_555)
#: Bytes of a row group of the index: what a task reads at once.
ROW_GROUP = 16 << 20
_POSTINGS = pa.schema([("ids", pa.binary()), ("n", pa.binary()), ("terms", pa.binary()), ("df", pa.binary()), ("docs", pa.binary()), ("tf", pa.binary())])
_POSTINGS_SQL = "ids binary, n binary, terms binary, df binary, docs binary, tf binary"
_HITS_SQL = "slot long, doc_id long, score long"
_HITS = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _tier_columns(t: int) -> list[str]:
    return [f"df{t}", f"rest{t}", f"docs{t}", f"impact{t}"]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as many bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes() if len(x) else b""


def _unpacked(blob, n: int) -> np.ndarray:
    raw = blob.as_buffer()
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _array(blob, dtype) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), dtype)


def _terms(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term of some texts, in order."""
    low = K.LOWER[raw]
    first, last, row = K.words(low, starts, K.LETTER)
    return K.spans_hash(low, first, last), row


def _postings(batches, most: int):
    """A row for each block of documents of like length."""
    for b in batches:
        order = pa.array(np.argsort(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0)), kind="stable"))
        ids, texts = ids_of(b.column(0).take(order)), b.column(1).take(order)
        for at, raw, starts in K.slices(texts, most):
            h, row = _terms(raw, starts)
            n = np.bincount(row, minlength=len(starts) - 1)
            by = np.argsort(h, kind="stable")  # rows rise within a term
            h, row = h[by], row[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            head = np.flatnonzero(new)
            tf, term, doc = np.diff(np.append(head, len(h))), h[head], row[head]
            lead = np.flatnonzero(np.append([True], term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            df = np.diff(np.append(lead, len(term)))
            own = ids[at : at + len(starts) - 1]
            yield batch(_POSTINGS, [[own.tobytes()], [_packed(n)], [term[lead].tobytes()], [_packed(df)], [_packed(doc)], [_packed(tf)]])


def _tiered(batches, n_docs: int, n_terms: int, tiers: tuple[int, ...], schema: pa.Schema):
    """The postings of each block by tiers of impact."""
    for b in batches:
        for i in range(b.num_rows):
            ids, n, terms, df, docs, tf = (b.column(c)[i] for c in range(6))
            many = len(terms.as_buffer()) // 8
            if not many:
                continue
            df, n = _unpacked(df, many), _unpacked(n, len(ids.as_buffer()) // 8)
            total = int(df.sum())
            docs, tf = _unpacked(docs, total), _unpacked(tf, total)
            m = 25 + 75 * n * n_docs // n_terms
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
            tier = np.searchsorted(-np.array(tiers), -impact)  # 0 from tiers[0] up
            term, row = np.repeat(np.arange(many), df), [ids.as_py(), terms.as_py()]
            for t in range(len(tiers) + 1):
                at = np.flatnonzero(tier == t)
                rest = np.zeros(many, np.int64)
                below = np.flatnonzero(tier > t)
                np.maximum.at(rest, term[below], impact[below])
                row += [_packed(np.bincount(term[at], minlength=many)), _packed(rest), _packed(docs[at]), _packed(impact[at])]
            yield batch(schema, [[x] for x in row])


class Index:
    """The staged index of a table of documents: ``table``, ``n_docs`` (with a term) and ``n_terms``."""

    def __init__(self, docs: DataFrame, tiers: tuple[int, ...] = TIERS, block: int = 1 << 20):
        """Reads doc_id and text of ``docs``; ``block`` is the bytes of text of a block."""
        self.tiers = tiers
        raw = stage(keyed(docs, "text").mapInArrow(lambda it: _postings(it, block), _POSTINGS_SQL), "postings", **{"parquet.block.size": ROW_GROUP})
        counts = raw.select("ids", "n").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
        self.n_docs, self.n_terms = counts[0] or 0, counts[1] or 0
        names = ["ids", "terms", *(c for t in range(len(tiers) + 1) for c in _tier_columns(t))]
        schema, found = pa.schema([(c, pa.binary()) for c in names]), (self.n_docs, self.n_terms)
        self.table = stage(raw.mapInArrow(lambda it: _tiered(it, *found, tiers, schema), ", ".join(f"{c} binary" for c in names)), "tiers", **{"parquet.block.size": ROW_GROUP})
        unstage(raw)

    def counts(self, terms: np.ndarray) -> np.ndarray:
        """How many documents hold each of some terms (sorted hashes)."""
        names = [f"df{t}" for t in range(len(self.tiers) + 1)]
        found = self.table.select("terms", *names).mapInArrow(lambda it: _found(it, terms), "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
        df = np.zeros(len(terms), np.int64)
        for r in found:
            df[r.place] = r.df
        return df


def _sizes(batches):
    schema = pa.schema([("docs", pa.int64()), ("terms", pa.int64())])
    for b in batches:
        for ids, n in zip(b.column(0), b.column(1)):
            n = _unpacked(n, len(ids.as_buffer()) // 8)
            yield batch(schema, [[int((n > 0).sum())], [int(n.sum())]])


def _places(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among those wanted, place in the block) of the terms wanted that the block has."""
    at = np.searchsorted(have, wanted)
    good = np.flatnonzero(have[np.minimum(at, len(have) - 1)] == wanted)
    return good, at[good]


def _found(batches, wanted: np.ndarray):
    schema = pa.schema([("place", pa.int32()), ("df", pa.int64())])
    total = np.zeros(len(wanted), np.int64)
    for b in batches:
        for i in range(b.num_rows):
            have = _array(b.column(0)[i], "<u8")
            good, at = _places(have, wanted)
            for c in range(1, b.num_columns):
                total[good] += _unpacked(b.column(c)[i], len(have))[at]
    there = np.flatnonzero(total)
    yield batch(schema, [there.astype(np.int32), total[there]])


class _Group:
    """Items as (slot, places among the sorted terms, weight times repeats), with the k-th scores that they are sure of."""

    def __init__(self, slots: list[int], terms: list[np.ndarray]):
        self.slots = slots
        self.terms = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        self.items = [np.unique(np.searchsorted(self.terms, t), return_counts=True) for t in terms]
        self.sure = np.ones(len(slots), np.int64)  # scores are above 0

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.items = [(at, weight[at] * times) for at, times in self.items]


def _added(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    if len(value) and float(value.max()) * len(value) < 2**53:  # sums in doubles are whole
        return np.bincount(doc, value, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, doc, value)
    return out


def _searched(batches, group: _Group, upto: int, last: bool, k: int, tally: bool = False):
    """Each item's k best (document, score) of a task's blocks, from the tiers up to ``upto``.

    Before the last tier scores are what documents are sure to reach.  With
    ``tally`` rows are (tier, items and blocks that read it, 0) instead.
    """
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in group.slots]
    sure, asked = group.sure.copy(), np.zeros(upto + 1, np.int64)
    for b in batches:
        for i in range(b.num_rows):
            ids, have = _array(b.column(0)[i], "<i8"), _array(b.column(1)[i], "<u8")
            good, at = _places(have, group.terms)
            place = np.full(len(group.terms), -1)
            place[good] = at
            tiers: list = []
            for slot, (wanted, weight) in enumerate(group.items):
                here = place[wanted] >= 0
                own, w = place[wanted[here]], weight[here]
                score, open_ = None, len(own) > 0
                parts: list = []
                for t in range(upto + 1):
                    if not open_:
                        break
                    asked[t] += 1
                    if t == len(tiers):
                        df = _unpacked(b.column(2 + 4 * t)[i], len(have))
                        n = int(df.sum())
                        tiers.append((df, np.cumsum(df) - df, _unpacked(b.column(3 + 4 * t)[i], len(have)), _unpacked(b.column(4 + 4 * t)[i], n), _unpacked(b.column(5 + 4 * t)[i], n)))
                    df, begin, rest, docs, impact = tiers[t]
                    size = df[own]
                    at = K.ragged(begin[own], size)
                    parts.append((docs[at], np.repeat(w, size) * impact[at], size))
                    doc = np.concatenate([p[0] for p in parts])
                    score = _added(doc, np.concatenate([p[1] for p in parts]), len(ids))
                    left = w * rest[own]  # what a document without the term's posting can still gain
                    if left.any():
                        gained = _added(doc, np.concatenate([np.repeat(left, p[2]) for p in parts]), len(ids))
                        open_ = int((score - gained).max()) + int(left.sum()) >= sure[slot]
                    else:
                        open_ = int(score.max()) >= sure[slot]
                if score is None or last and not open_:
                    continue
                hit = np.flatnonzero(score >= sure[slot])
                if not len(hit):
                    continue
                d, s = np.concatenate([best[slot][0], ids[hit]]), np.concatenate([best[slot][1], score[hit]])
                pick = np.lexsort((d, -s))[:k]
                best[slot] = d[pick], s[pick]
                if len(pick) == k:
                    sure[slot] = max(sure[slot], s[pick[-1]])
    if tally:
        yield batch(_HITS, [np.arange(upto + 1), asked, np.zeros(upto + 1, np.int64)])
    elif sum(len(d) for d, _ in best):
        slots = np.repeat(np.array(group.slots, np.int64), [len(d) for d, _ in best])
        yield batch(_HITS, [slots, np.concatenate([d for d, _ in best]), np.concatenate([s for _, s in best])])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("slot").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def _item_terms(batches):
    schema = pa.schema([("slot", pa.int64()), ("item_id", pa.int64()), ("terms", pa.binary()), ("n", pa.int64())])
    for b in batches:
        found: list[bytes] = []
        for _, raw, starts in K.slices(b.column(2)):
            h, row = _terms(raw, starts)
            found += [h[row == i].tobytes() for i in range(len(starts) - 1)]
        yield batch(schema, [b.column(0), b.column(1), found, [len(t) // 8 for t in found]])


def search(index: Index, items: DataFrame, k: int = 10, group_terms: int = 1 << 18, tally: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the largest score above 0.

    ``items`` has item_id and text.  Equal scores go by doc_id, nulls first; rows
    that share a doc_id are documents of their own, and rows that share an
    item_id are each asked.  Items without terms, or whose terms no document
    holds, have no rows; nor has anything where either table is empty.  With
    ``tally`` the rows are (tier, asked): how many pairs of item and block had to
    read each tier in the last search.
    """
    spark = items.sparkSession
    asked = stage(items.select(F.monotonically_increasing_id().alias("slot"), F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "slot long, item_id long, terms binary, n long"), "items")
    groups, found = -(-(asked.agg(F.sum("n")).first()[0] or 0) // group_terms), []
    for g in range(groups if index.n_terms else 0):
        rows = asked.where((F.col("n") > 0) & (F.pmod(F.xxhash64("slot"), F.lit(groups)) == g)).select("slot", "terms").collect()
        if not rows:
            continue
        group = _Group([r.slot for r in rows], [np.frombuffer(r.terms, "<u8") for r in rows])
        group.weigh(index.n_docs, index.counts(group.terms))
        place = {s: i for i, s in enumerate(group.slots)}
        for t in range(len(index.tiers) + 1):
            last = t == len(index.tiers)
            read = index.table.select("ids", "terms", *(c for s in range(t + 1) for c in _tier_columns(s)))
            hits = read.mapInArrow(lambda it, group=group, t=t, last=last: _searched(it, group, t, last, k, tally and last), _HITS_SQL)
            if last:
                found.append(hits if tally else stage(_ranked(hits, k), "ranked"))
                break
            for r in _ranked(hits, k).groupBy("slot").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).collect():
                group.sure[place[r.slot]] = max(group.sure[place[r.slot]], r.score)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    if tally:
        return hits.groupBy(F.col("slot").alias("tier")).agg(F.sum("doc_id").alias("asked"))
    return hits.join(asked.select("slot", "item_id"), "slot").select("item_id", "rank", F.nullif(F.col("doc_id"), F.lit(NULL_ID)).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """:func:`search` over an index of all of ``docs``.

    Null texts have no terms.  Columns other than doc_id, text and item_id are
    not read.
    """
    return search(Index(docs), items, k)
