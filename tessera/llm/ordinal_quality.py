"""Ordinal quality classifier: cumulative-link regression on hashed text.

Grades 0 < 1 < 2 come from ratings: toxic is 0, poor quality 1, good quality 2.
One weight vector is shared by all grades; ordered thresholds cut its score:
P(grade <= j) = sigmoid(t_j - w.x).  So a text has an expected grade and tail
probabilities, and selection asks for the tail of the best grade.

Features: presence of letter runs, A-Z lower-cased and hashed to ``dims``
places, and a few shares of bytes and repeats.  The model is fitted on at most
``sample`` labelled documents, those with the smallest hashed id, which bounds
what reaches the driver; scoring covers all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import batch, keyed, unkeyed

N_SHARES = 7
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class OrdinalModel:
    words: np.ndarray  # a weight for each hashed place
    shares: np.ndarray
    middle: np.ndarray  # of the shares, and their spread
    spread: np.ndarray
    thresholds: np.ndarray  # rising, one less than the grades

    def score(self, rows: np.ndarray, places: np.ndarray, shares: np.ndarray) -> np.ndarray:
        sparse = np.bincount(rows, self.words[places], minlength=len(shares))
        return sparse + ((shares - self.middle) / self.spread) @ self.shares

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j."""
        return _sigmoid(score[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(raw: np.ndarray, starts: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place) of present words, and the shares of each row."""
    n = len(starts) - 1
    low = K.LOWER[raw]
    a, z, row = K.words(low, starts, K.LETTER)
    h = K.spans_hash(low, a, z)
    order = np.lexsort((h, row))
    own, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    own, h = own[new], h[new]
    size = np.maximum(1, np.diff(starts))

    def held(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[starts[1:]] - total[starts[:-1]]

    count, distinct = np.bincount(row, minlength=n), np.bincount(own, minlength=n)
    upper = held((raw >= 65) & (raw < 91))
    shares = np.stack(
        [
            np.log1p(count),
            held(_SYMBOL[raw]) / size,
            upper / np.maximum(1, held(K.LETTER[raw])),
            held(raw == 33) / size,
            held((raw >= 48) & (raw < 58)) / size,
            1 - distinct / np.maximum(1, count),
            held(raw == 10) / size,
        ],
        axis=1,
    )
    return own, (h % np.uint64(dims)).astype(np.int64), shares


def _collected(batches, dims: int):
    schema = pa.schema([("grade", pa.int32()), ("places", pa.binary()), ("shares", pa.binary())])
    for b in batches:
        places, shares = [], []
        for _, raw, starts in K.slices(b.column(1)):
            own, place, share = features(raw, starts, dims)
            cut = np.searchsorted(own, np.arange(len(starts)))
            place = place.astype(np.int32)
            places += [place[cut[i] : cut[i + 1]].tobytes() for i in range(len(starts) - 1)]
            shares += [x.tobytes() for x in share]
        yield batch(schema, [b.column(0).cast(pa.int32()), places, shares])


def fit(grade: np.ndarray, places: list[np.ndarray], shares: np.ndarray, dims: int, grades: int = 3, rounds: int = 250, ridge: float = 0.5, screen: float = 25.0) -> OrdinalModel:
    """Full-batch Adam on the mean log-likelihood; the same data give the same model.

    Only places whose presence depends on the grade (chi-square of ``screen`` or
    more) get a weight.
    """
    n = len(grade)
    rows, cols = np.repeat(np.arange(n), [len(p) for p in places]), np.concatenate(places) if n else np.zeros(0, np.int64)
    seen = np.stack([np.bincount(cols[grade[rows] == j], minlength=dims) for j in range(grades)]).astype(float)
    each = np.bincount(grade, minlength=grades)[:, None] if n else np.ones((grades, 1))
    hope = each * seen.sum(0) / max(1, n)
    chi = ((seen - hope) ** 2 / np.maximum(hope, 1e-9) + (seen - hope) ** 2 / np.maximum(each - hope, 1e-9)).sum(0)
    use = chi[cols] >= screen
    rows, cols = rows[use], cols[use]
    middle, spread = (shares.mean(0), shares.std(0) + 1e-9) if n else (np.zeros(N_SHARES), np.ones(N_SHARES))
    dense = (shares - middle) / spread
    below = np.array([(grade <= j).mean() if n else 0.5 for j in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    t0 = np.maximum.accumulate(np.log(below / (1 - below)))
    # thresholds as a first value and positive steps keep their order
    theta = np.concatenate([np.zeros(dims + N_SHARES), t0[:1], np.log(np.maximum(np.diff(t0), 0.1))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1 if n else 1):
        w, s, first, steps = theta[:dims], theta[dims : dims + N_SHARES], theta[dims + N_SHARES], theta[dims + N_SHARES + 1 :]
        t = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
        score = np.bincount(rows, w[cols], minlength=n) + dense @ s
        upper = np.where(grade[:, None] < grades - 1, _sigmoid(np.append(t, 0)[grade] - score)[:, None], 1.0)[:, 0]
        lower = np.where(grade > 0, _sigmoid(np.append(0, t)[grade] - score), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        back = (du - dl) / n  # of the loss by the score
        gt = np.zeros(grades - 1)
        for j in range(grades - 1):
            gt[j] = (-du[grade == j].sum() + dl[grade == j + 1].sum()) / n
        grad = np.concatenate([np.bincount(cols, back[rows], minlength=dims) + ridge * w / n, dense.T @ back + ridge * s / n, [gt.sum()], [gt[j + 1 :].sum() * np.exp(steps[j]) for j in range(grades - 2)]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.05 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    steps = np.exp(theta[dims + N_SHARES + 1 :])
    t = theta[dims + N_SHARES] + np.concatenate([[0], np.cumsum(steps)])
    return OrdinalModel(theta[:dims].astype(np.float32), theta[dims : dims + N_SHARES], middle, spread, t)


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, dims: int = 1 << 18) -> OrdinalModel:
    """Fits on at most ``sample`` documents that have a label, all of them if there are no more.

    ``labels`` has doc_id, quality and toxic (0/1).  Of rows with one doc_id the
    worst rating counts, so repeated labels agree; a rating without quality is
    left out, a null toxic is 0.  Without labels every text gets the same grade
    probabilities.
    """
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality") > 0, 2).when(F.col("quality") == 0, 1)
    rated = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("grade")).where("grade is not null")
    rated = rated.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")  # labels of other documents take no places
    few = rated.withColumn("_at", F.xxhash64("doc_id")).orderBy("_at", "doc_id").limit(sample).select("doc_id", "grade")
    one = F.min_by("text", F.xxhash64("text"))  # rows of one doc_id count once, so ``sample`` rows stay
    rows = keyed(docs, "text").join(few, "doc_id").groupBy("doc_id").agg(F.first("grade").alias("grade"), one.alias("text"))
    rows = rows.select("grade", "text").mapInArrow(lambda it: _collected(it, dims), "grade int, places binary, shares binary")
    rows = sorted(tuple(r) for r in rows.collect())  # ``sample`` rows, each of ``dims`` places at most
    grades = np.array([r[0] for r in rows], np.int64)
    shares = np.array([np.frombuffer(r[2]) for r in rows]).reshape(-1, N_SHARES)
    return fit(grades, [np.frombuffer(r[1], np.int32) for r in rows], shares, dims)


_OUT = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("p_poor", pa.float64()), ("p_good", pa.float64()), ("selected", pa.bool_())])


def _scores(ids, column, model: OrdinalModel, least: float):
    out = []
    for _, raw, starts in K.slices(column):
        tails = model.tails(model.score(*features(raw, starts, len(model.words))))
        out.append(tails)
    tails = np.concatenate(out) if out else np.zeros((0, 2))
    empty = np.array([not (x.is_valid and len(x.as_buffer())) for x in column.cast(pa.binary())], bool)
    return tails.sum(1), tails[:, 0], tails[:, -1], (tails[:, -1] >= least) & ~empty


def _graded(batches, model: OrdinalModel, least: float):
    for b in batches:
        yield batch(_OUT, [b.column(0), *_scores(b.column(0), b.column(1), model, least)])


def grade(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_poor, p_good, selected) of every row.

    p_poor is P(grade >= 1), p_good is P(grade = 2); a text is selected if
    p_good reaches ``least``.  Null and empty texts get the score of no words
    and are never selected.  Equal texts get equal grades; a null doc_id stays
    null; other columns are not read.
    """
    out = keyed(docs, "text").mapInArrow(
        lambda it: _graded(it, model, least), "doc_id long, expected_grade double, p_poor double, p_good double, selected boolean"
    )
    return out.select(unkeyed(), *out.columns[1:])


def select(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are selected, with their columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, at = to_arrow_schema(docs.schema), docs.columns.index("text")

    def kept(batches):
        for b in batches:
            ok = _scores(None, b.column(at), model, least)[3]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.filter(pa.array(ok)).columns, arrow)], schema=arrow)

    return docs.mapInArrow(kept, docs.schema)
