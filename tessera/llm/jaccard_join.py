"""Similarity join on word shingles by a blocked sparse matrix product.

The incidence of documents and shingles is a sparse matrix; the overlap of two
documents is an entry of its product with its own transpose.  Only rows that can
reach the bound are multiplied, in blocks, and counts below the bound that the
two sizes give are discarded.

1.  One pass over the texts gives each document's set (64-bit hashes) and deals
    the incidence by hash.  Documents with equal sets are one class.
2.  Each bucket of hashes keeps those that two classes share.  A class that
    shares less than the threshold's part of its set links with nothing.  A
    shingle that many documents of one batch share is known to be shared: all but
    its name goes straight to its classes, so no shingle gathers a share of all
    rows, and it counts as the most frequent wherever it is.
3.  The rest order their shared shingles by rising frequency.  Two that link
    share one of the first ``n - ceil(t n) + 1``; tying each such shingle's
    classes to the smallest gives clusters that no link leaves.
4.  A cluster is multiplied within one task.  Rows are multiplied until all
    rows that are left lie in one component: what a further row could add is
    then known.  So a group of near copies needs few rows, not all pairs.
5.  A cluster of more than ``block`` entries is cut into blocks.  Each is
    multiplied alone; then one row of each component with those of the others;
    then every row outside the cluster's largest component with all blocks.
    Rows within it are known to be linked, so a large group of near copies costs
    as much as its blocks, and only rows outside are dealt to all of them.

Hash collisions: 64 bits for shingles and for classes, whatever the words look
like.  The chance that any two of N distinct values collide is about N^2 / 3.7e19.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .graph import components
from .shared import batch, buckets, grouped, ids_of, joined, keyed, split_rows, stage, unkeyed, unstage

_DEALT = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("sigs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("hot", pa.binary()), ("known", pa.binary())])
_SHARED = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("shared", pa.binary())])
_CLASSES = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("least", pa.int64()), ("row", pa.binary())])
#: Documents of a batch that share a shingle, beyond which it is hot.
HOT = 64
_MOST = np.uint32(2**32 - 1)
_DOC = np.dtype([("doc", "<i8"), ("key", "<i8"), ("n", "<i8"), ("sig", "<u8")])
_CELL = np.dtype([("sig", "<u8"), ("h", "<u8"), ("df", "<u4")])
_DEALT_SQL = "bucket int, docs binary, sigs binary, counts binary, hashes binary, hot binary, known binary"
_SHARED_SQL = "bucket int, docs binary, shared binary"
_CLASSES_SQL = "kind int, doc_id long, key long, n long, rep long, least long, row binary"


def _dealt(key: int, **blobs: bytes):
    return batch(_DEALT, [[key], *[[blobs.get(f.name)] for f in list(_DEALT)[1:]]])


def _deal(batches, nb: int, k: int, most: int):
    for b in batches:
        ids = ids_of(b.column(0))
        n, sig, rows, hashes = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.uint64), [], []
        for lo, raw, starts in K.slices(b.column(1)):
            own, h = K.shingle_sets(raw, starts, k)
            if len(h):
                head = np.flatnonzero(np.diff(own, prepend=-1))
                n[lo + own[head]] = np.diff(np.append(head, len(own)))
                sig[lo + own[head]] = np.add.reduceat(K.mix(h + np.uint64(0x5851F42D4C957F2D)), head)
            rows.append((own + lo).astype(np.int32))
            hashes.append(h)
        sig = K.mix(sig + n.astype(np.uint64))
        docs = np.zeros(len(ids), _DOC)
        docs["doc"], docs["key"], docs["n"], docs["sig"] = ids, ids_of(b.column(2)), n, sig
        for key, (part,) in split_rows((sig % np.uint64(nb)).astype(np.int64), nb, docs):
            yield _dealt(key, docs=part)
        if not rows:
            continue
        row, h = np.concatenate(rows), np.concatenate(hashes)
        rows, hashes = [], []
        _, firsts = np.unique(sig, return_index=True)  # copies within the batch count once
        keep = np.zeros(len(ids), bool)
        keep[firsts] = True
        if not keep.all():
            row, h = row[keep[row]], h[keep[row]]
        hot = K.frequent(h, most)
        if hot.any():
            known = np.zeros(int(hot.sum()), _CELL)
            known["sig"], known["h"], known["df"] = sig[row[hot]], h[hot], _MOST
            for key, (part,) in split_rows((known["sig"] % np.uint64(nb)).astype(np.int64), nb, known):
                yield _dealt(key, known=part)
            names = np.unique(known["h"])
            for key, (part,) in split_rows(((names >> np.uint64(32)) % np.uint64(nb)).astype(np.int64), nb, names):
                yield _dealt(key, hot=part)
            row, h = row[~hot], h[~hot]
        bucket = ((h >> np.uint64(32)) % np.uint64(nb)).astype(np.uint16 if nb <= 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        row, h, ends, lo = row[order], h[order], np.cumsum(np.bincount(bucket, minlength=nb)), 0
        del bucket, order
        for key in range(nb):
            hi = int(ends[key])
            if hi > lo:
                head = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
                counts = np.diff(np.append(head, hi - lo)).astype(np.uint32)
                yield _dealt(key, sigs=sig[row[lo:hi][head]].tobytes(), counts=counts.tobytes(), hashes=h[lo:hi].tobytes())
            lo = hi


def _share(key, table, nb: int):
    bucket = key[0].as_py()
    out = [batch(_SHARED, [[bucket], [joined(table["docs"], _DOC).tobytes()], [None]])]
    out += [batch(_SHARED, [[bucket], [None], [x]]) for x in table["known"].drop_null()]
    h = joined(table["hashes"], np.uint64)
    if len(h):
        sig = np.repeat(joined(table["sigs"], np.uint64), joined(table["counts"], np.uint32))
        order = np.argsort(h)
        h, sig = h[order], sig[order]
        names, hot = np.unique(joined(table["hot"], np.uint64)), np.zeros(len(h), bool)
        lo, hi = np.searchsorted(h, names, side="left"), np.searchsorted(h, names, side="right")
        hot[K.ragged(lo, hi - lo)] = True
        del order
        twin = hot.copy()
        same = h[1:] == h[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        h, sig, hot = h[twin], sig[twin], hot[twin]
        order = np.lexsort((sig, h))
        h, sig, hot = h[order], sig[order], hot[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
        h, sig, hot = h[new], sig[new], hot[new]
        if len(h):
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            df = np.repeat(np.diff(np.append(head, len(h))), np.diff(np.append(head, len(h))))
            cells = np.zeros(len(h), _CELL)
            cells["sig"], cells["h"], cells["df"] = sig, h, np.where(hot, _MOST, np.minimum(df, _MOST - 1))
            cells = cells[(df > 1) | hot]
            for to, (part,) in split_rows((cells["sig"] % np.uint64(nb)).astype(np.int64), nb, cells):
                out.append(batch(_SHARED, [[to], [None], [part]]))
    return pa.Table.from_batches(out)


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with any set that a set of n elements links at."""
    return -(-n * percent // 100)


def _classes(key, table, percent: int):
    docs = joined(table["docs"], _DOC)
    docs = docs[np.lexsort((docs["doc"], docs["sig"]))]
    out = []
    if len(docs):
        head = np.flatnonzero(np.concatenate([[True], docs["sig"][1:] != docs["sig"][:-1]]))
        size = np.diff(np.append(head, len(docs)))
        empty = docs["n"] == 0  # such a set links with nothing, each row is alone
        rep = pa.array(docs["sig"].view(np.int64), mask=empty)
        least = np.where(empty, docs["doc"], np.repeat(docs["doc"][head], size))
        none = pa.nulls(len(docs), pa.binary())
        out.append(batch(_CLASSES, [np.zeros(len(docs), np.int32), docs["doc"], docs["key"], docs["n"], rep, least, none]))
        cells = joined(table["shared"], _CELL)
        at = np.searchsorted(docs["sig"][head], cells["sig"])
        order = np.lexsort((cells["h"], cells["df"], at))
        cells, at = cells[order], at[order]
        new = np.ones(len(cells), bool)  # copies in two batches can both bring a hot shingle
        new[1:] = (at[1:] != at[:-1]) | (cells["h"][1:] != cells["h"][:-1])
        cells, at = cells[new], at[new]
        count = np.bincount(at, minlength=len(head))
        begin, n = np.cumsum(count) - count, docs["n"][head]
        good = np.flatnonzero((count >= _need(n, percent)) & (n > 0) & (count > 0))
        blobs = [cells["h"][begin[i] : begin[i] + count[i]].tobytes() for i in good]
        no = pa.nulls(len(good), pa.int64())
        out.append(batch(_CLASSES, [np.ones(len(good), np.int32), no, no, n[good], docs["sig"][head][good].view(np.int64), docs["doc"][head][good], blobs]))
    return pa.Table.from_batches(out, schema=_CLASSES)


def _prefixes(batches, percent: int):
    schema = pa.schema([("h", pa.int64()), ("rep", pa.int64())])
    for b in batches:
        h, rep = [], []
        for r, n, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            cells = np.frombuffer(row.as_buffer(), np.int64)
            part = cells[: max(0, n - int(_need(np.int64(n), percent)) + 1 - (n - len(cells)))]
            h.append(part)
            rep.append(np.full(len(part), r))
        if h:
            yield batch(schema, [np.concatenate(h), np.concatenate(rep)])


def _multiply(rep: np.ndarray, n: np.ndarray, rows: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """The smallest rep of each row's component within the block.

    Rows with equal ``known`` lie in one component already.
    """
    m = len(rep)
    order = np.argsort(rep)
    rep, n, rows = rep[order], n[order], [rows[i] for i in order]
    size = np.array([len(r) for r in rows])
    _, feature = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    posting = owner[np.argsort(feature, kind="stable")]
    df = np.bincount(feature)
    at, begin = np.cumsum(df) - df, np.cumsum(size) - size
    weight = np.bincount(owner, df[feature], minlength=m) / n  # the most typical rows first
    queue = np.argsort(-weight, kind="stable")
    label, left, place = np.arange(m), np.ones(m, bool), 0
    if known is not None:
        _, head, group = np.unique(known[order], return_index=True, return_inverse=True)
        label = head[group]
    open_ = np.bincount(label, minlength=m)  # rows left, by label
    while True:
        most = int(np.argmax(open_))
        if open_[most] == left.sum():
            break  # all rows left are in one component
        if place == 0:
            q = int(queue[0])
        else:
            rest = queue[left[queue] & (label[queue] != most)]
            q = int(rest[0])
        place += 1
        f = feature[begin[q] : begin[q] + size[q]]
        overlap = np.bincount(posting[K.ragged(at[f], df[f])], minlength=m)
        hit = np.flatnonzero(100 * overlap >= percent * (n[q] + n - overlap))
        left[q] = False
        open_[label[q]] -= 1
        roots = np.unique(label[np.append(hit, q)])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
            open_[roots[0]] = open_[roots].sum()
            open_[roots[1:]] = 0
    out = np.empty(m, np.int64)
    out[order] = rep[label]
    return out


def _blocks(key, table, percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    group = np.stack([table[c].to_numpy() for c in ("cluster", "i", "j")])
    rep, n, known = (table[c].to_numpy() for c in ("rep", "n", "known"))
    rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["row"]]
    order = np.lexsort((rep, *group))
    cut = np.flatnonzero(np.any(np.diff(group[:, order], axis=1) != 0, axis=0)) + 1
    u, v = [], []
    for part in np.split(order, cut):
        part = part[np.append(True, rep[part[1:]] != rep[part[:-1]])] if len(part) else part  # a row can be dealt twice
        if len(part) > 1:
            u.append(rep[part])
            v.append(_multiply(rep[part], n[part], [rows[i] for i in part], percent, known[part]))
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
    return pa.Table.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], schema=schema)


_ROW = ("rep", "n", "row", "known", "cluster")


def _multiplied(parts: DataFrame, nb: int, percent: int) -> DataFrame:
    """Links (u, v) within each (cluster, i, j) of ``parts``."""
    parts = parts.select(*_ROW, "i", "j").withColumn("task", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(4 * nb)).cast("int"))
    return parts.groupBy("task").applyInArrow(grouped(_blocks, percent=percent), "u long, v long")


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.drop("known").join(roots, rows.rep == roots.node, "left").withColumn("known", F.coalesce("root", "rep")).drop("node", "root")


def _own(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with their cluster's number of blocks (parts) and their own one."""
    size = rows.groupBy("cluster").agg(F.ceil(F.sum(F.length("row") / 8) / block).cast("int").alias("parts"))
    return rows.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))


def _across(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` dealt so that any two of a cluster meet in some (i, j)."""
    rows = _own(rows, block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


def _large(rows: DataFrame, nb: int, percent: int, block: int, held: list) -> DataFrame:
    """Links within clusters of several blocks; ``rows`` are staged and have parts and own; stages are added to ``held``."""
    first = components(_multiplied(rows.withColumns({"i": F.col("own"), "j": F.col("own")}), nb, percent))
    one = _labelled(rows, first)
    heads = _multiplied(_across(one.where("rep = known").select(*_ROW), block), nb, percent)
    stars = first.select(F.col("node").alias("u"), F.col("root").alias("v"))
    second = components(stars.unionByName(heads))
    labelled = stage(_labelled(rows, second), "labelled")
    held.append(labelled)
    each = labelled.groupBy("cluster", "known").agg(F.sum(F.length("row")).alias("c"))
    main = each.groupBy("cluster").agg(F.max_by("known", F.struct("c", "known")).alias("main"))
    outer = labelled.join(main, "cluster").where("known != main").drop("main", "own", "parts")
    outer = _own(outer, block)
    reach = outer.groupBy("cluster").agg(F.max("parts").alias("outer_parts"))
    all_ = labelled.join(reach, "cluster").withColumns({"i": F.col("own"), "j": F.explode(F.sequence(F.lit(0), F.col("outer_parts") - 1))})
    wide = outer.withColumnRenamed("own", "j").drop("parts").join(labelled.groupBy("cluster").agg(F.max("parts").alias("parts")), "cluster")
    wide = wide.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    third = _multiplied(all_.select(*_ROW, "i", "j").unionByName(wide.select(*_ROW, "i", "j")), nb, percent)
    return second.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(third)


def jaccard_groups(docs: DataFrame, percent: int = 75, k: int = 5, block: int = 2_000_000, hot: int = HOT) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, component) for every row of ``docs``.

    As :func:`jaccard_components`, with ``key``, the xxhash64 of the text, and
    ``component``, a number that the rows of a component share and no others
    (null for an empty set).  Rows that share a doc_id are in different
    components unless links join them.
    """
    spark = docs.sparkSession
    nb = buckets(spark)
    texts = keyed(docs, "text").withColumn("key", F.xxhash64("text"))
    dealt = texts.mapInArrow(partial(_deal, nb=nb, k=k, most=hot), _DEALT_SQL)
    shared = dealt.groupBy("bucket").applyInArrow(grouped(_share, nb=nb), _SHARED_SQL)
    classes = stage(shared.groupBy("bucket").applyInArrow(grouped(_classes, percent=percent), _CLASSES_SQL), "classes")
    rows = classes.where("kind = 1").select("rep", "n", "row")
    heads = stage(rows.mapInArrow(partial(_prefixes, percent=percent), "h long, rep long"), "prefixes")
    hubs = heads.groupBy("h").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    clusters = components(heads.join(hubs, "h").select(F.col("rep").alias("u"), F.col("hub").alias("v")))
    unstage(heads)
    cells = rows.select("rep", (F.length("row") / 8).alias("cells"))  # sizes alone, before the rows are dealt
    size = cells.join(clusters, cells.rep == clusters.node, "left").groupBy(F.coalesce("root", "rep").alias("cluster"))
    size = size.agg(F.ceil(F.sum("cells") / block).cast("int").alias("parts"), F.count("*").alias("c")).where("c > 1").drop("c")
    size = stage(size, "sizes")
    clustered = rows.join(clusters, rows.rep == clusters.node, "left").select("rep", "n", "row", F.col("rep").alias("known"), F.coalesce("root", "rep").alias("cluster"))
    parts = clustered.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    links = _multiplied(parts.where("parts = 1").withColumns({"i": F.lit(0), "j": F.lit(0)}), nb, percent)
    held = []
    if not size.where("parts > 1").isEmpty():
        held = [stage(parts.where("parts > 1"), "clustered")]
        links = links.unionByName(_large(held[0], nb, percent, block, held))
    roots = components(links)
    unstage(size, *held)
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = linked.join(classes.where("kind = 1").select("rep", F.col("least").alias("smallest")), linked.node == F.col("rep")).select("node", "root", "smallest")
    smallest = linked.groupBy("root").agg(F.min("smallest").alias("component_id"))
    known = linked.select("node", "root").join(smallest, "root")
    members = classes.where("kind = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), "rep", "least")
    found = members.join(known, members.rep == known.node, "left")
    found = found.select(unkeyed(), "key", "n_shingles", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "rep").alias("component"))
    return found.select("doc_id", "key", "n_shingles", unkeyed("component_id"), "component")


def jaccard_components(docs: DataFrame, percent: int = 75, k: int = 5, block: int = 2_000_000, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A document's set is its distinct shingles of ``k`` words, A-Z lower-cased;
    with 1 to k-1 words the whole sequence is one shingle; null, empty and blank
    texts have none and link with nothing.  Two documents link when
    ``100 * intersection >= percent * union``; component_id is the smallest
    doc_id that links reach.  Rows are documents: rows with equal doc_id each
    have a row and their own links; a null doc_id is below all others and stays
    null.  Other columns are not read.  An empty table gives an empty result.
    """
    return jaccard_groups(docs, percent, k, block, hot).select("doc_id", "n_shingles", "component_id")
