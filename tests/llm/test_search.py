"""Ranked lexical search, spelling variants and the multi-index against brute force, and their odd tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import multi_index, spelling_variants, tiered_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, k):
    terms = [TERM.findall(lower(t)) for _, t in docs]
    N, L = sum(map(bool, terms)), sum(map(len, terms))
    df, out = Counter(w for t in terms for w in set(t)), []
    for item, text in items:
        found = []
        for (doc, _), t in zip(docs, terms):
            tf, score = Counter(t), 0
            for w in TERM.findall(lower(text)):
                if tf[w]:
                    weight = math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1)))
                    score += weight * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * (25 + 75 * len(t) * N // L)))
            if score > 0:
                found.append((-score, -(10**9) if doc is None else doc, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(found, key=lambda f: f[:2])[:k])]
    return out


def corpus(seed, n=300):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé9") for _ in range(r.randint(1, 6))) for _ in range(150)]
    made = lambda most: r.choice([" ", ".", "-", "\n"]).join(r.choices(words, weights=[1 / (i + 1) for i in range(150)], k=r.randint(0, most))).title()
    docs = [(i * 3 % 1000, made(r.choice([3, 30, 300]))) for i in range(n)]
    docs += [(5000, docs[0][1])] * 3 + [(None, docs[1][1]), (7, None), (8, ""), (9, " .. "), (5001, " ".join(words * 400)), (5002, docs[0][1])]
    items = [(i, made(12)) for i in range(30)] + [(40, docs[0][1]), (41, docs[0][1] * 2), (42, None), (43, ""), (44, "zzzz"), (45, "a a a a"), (46, " ".join(words * 3))]
    return docs, items


@pytest.mark.parametrize("seed, block, tiers, group_terms", [(0, 2000, tiered_search.TIERS, 1 << 18), (1, 1 << 20, (900_000, 600_000, 300_000), 60), (2, 500, (400_000,), 1 << 18)])
def test_ranked_search(spark, seed, block, tiers, group_terms):
    docs, items = corpus(seed)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ids": F.lit(1), "score": F.lit("x"), "N": F.lit(None)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("slot", F.lit(1))
    index = tiered_search.Index(table, tiers, block)
    got = sorted(map(tuple, tiered_search.search(index, asked, 10, group_terms).collect()), key=lambda r: r[:2])
    assert got == ranked(docs, items, 10)
    read = dict(tiered_search.search(index, asked, 10, tally=True).collect())
    assert read[0] >= read[len(tiers)] > 0


def test_ranked_search_stops_early(spark):
    """Blocks that cannot hold one of the best are not read to the last tier."""
    fill = [(i, f"common{i % 7} word{i} " + " ".join(f"long{j}" for j in range(300))) for i in range(400)]
    docs = fill + [(1000 + i, "rare thing here") for i in range(12)]
    index = tiered_search.Index(spark.createDataFrame(docs, "doc_id long, text string"), block=20_000)
    items = spark.createDataFrame([(1, "rare thing here long5")], "item_id long, text string")
    read = dict(tiered_search.search(index, items, tally=True).collect())
    assert read[2] <= read[0] / 2
    assert [r.doc_id for r in tiered_search.search(index, items).orderBy("rank").collect()] == list(range(1000, 1010))


def test_ranked_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([(1, t)], "doc_id long, text string") for t in (None, "word"))
    items = items.withColumnRenamed("doc_id", "item_id")
    assert tiered_search.ranked_search(docs, items).count() == 0
    assert tiered_search.ranked_search(docs.limit(0), items).count() == 0
    assert tiered_search.ranked_search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def variants(docs, every):
    n = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    n = {w: c for w, c in n.items() if c >= 5}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, near = {}, {w: [v for v in n if one(w, v)] for w in n}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


@pytest.mark.parametrize("seed, every", [(0, 199), (1, 3), (2, 17)])
def test_spelling_variants(spark, seed, every):
    r = random.Random(seed)
    bases, docs = ["abcabc", "aabbaab", "naïveté", "ÀÿÀÿÀÿ", "letters", "x" * 90, "öÖöÖöÖö"], []
    for level, base in enumerate(bases):
        forms, times = [base], 6000
        for _ in range(5):
            docs += [(r.randint(0, 400), " ".join(random.Random(i).sample(forms, len(forms)) * 20) + "\n") for i in range(times // (20 * len(forms)) + 1)]
            last = forms[:]
            forms = []
            for w in last * 3:
                i = r.randrange(len(w))
                forms.append(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcé") + w[i:], w[:i] + r.choice("abÀ") + w[i + 1 :]]))
            times //= 6
    docs += [(None, "nullid nullid nullid Nullid NULLID×÷"), (1, None), (2, ""), (3, "short 12345 ñandúes3ñandúes " * 6), (4, "y" * 3000 + " " + "y" * 2999 + " "), (4, "ŁabcdefgŁ")] + [(5, "y" * 3000 + "\n" + "y" * 2999)] * 6
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "id": F.lit(2)}).repartition(3)
    got = sorted(map(tuple, spelling_variants.spelling_variants(table, every=every).collect()))
    assert got == variants(docs, every)
    assert any(g[1] and g[2] != g[1] for g in got) or every != 199


def test_spelling_variants_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "few words")], "doc_id long, text string")
    assert spelling_variants.spelling_variants(docs).count() == spelling_variants.spelling_variants(docs.limit(0)).count() == 0


def test_crc_of_spans():
    r = random.Random(5)
    raw = bytes(r.randrange(256) for _ in range(5000))
    first = np.array([r.randrange(4000) for _ in range(300)])
    last = first + np.array([r.choice([0, 1, 7, 63, 64, 65, 900]) for _ in range(300)])
    begun = np.array([zlib.crc32(b"%d:" % i) for i in range(300)], np.uint32)
    got = spelling_variants.crc32(np.frombuffer(raw, np.uint8), first, last, begun)
    assert got.tolist() == [zlib.crc32(raw[a:z], int(b)) for a, z, b in zip(first, last, begun)]


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, v array<double>").withColumns({"row": F.lit(1), "cell": F.lit("x"), "dim": F.lit(3)}).repartition(3)


def exact(rows, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q % 20 == 0:
            score = [(-sum(float(p) * float(r) for p, r in zip(x, y)), i) for b, (i, y) in enumerate(good) if b != a and len(y) == len(x)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(score)[:k])]
    return sorted(out)


def test_multi_index_with_all_cells(spark):
    """With every cell visited results are exact: hot cells, copies, other dimensions and rows that take no part."""
    r = np.random.default_rng(3)
    rows = [(i, (r.integers(-9, 9, 8) / 4).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(200)] + [(i, [0.5, 2.0, -1.0]) for i in (2000, 2001, 2020)] + [(2040, [3.0])]
    rows += [(3000, None), (3020, [0.0] * 8), (3040, [math.nan] * 8), (3060, [math.inf, *[1.0] * 7]), (3080, [None, *[1.0] * 7]), (None, [1.0] * 8), (3100, []), (20, [1.0] * 8)]
    index = multi_index.MultiIndex(vectors_table(spark, rows), k=5, recall=1.0, a_cell=4)
    index.visits = {d: 10**9 for d in index.visits}
    for block, query_block in ((8192, 8192), (7, 2)):
        got = sorted(map(tuple, index.search(F.col("vec_id") % 20 == 0, block, query_block).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in exact(rows, 5)]
        assert all(a[3] == b[3] for a, b in zip(got, exact(rows, 5)))


@pytest.mark.parametrize("spread", [0.3, 2.0])
def test_multi_index_recall(spark, spread):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 16))
    x = centres[r.integers(0, 12, 2000)] + spread * r.normal(size=(2000, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[500:1200] = x[500]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = vectors_table(spark, rows)
    index = multi_index.MultiIndex(table)
    assert index.visits[16] < (x.shape[0] - 700) * 0.9
    got = index.search(F.col("vec_id") % 20 == 0).collect()
    want = {(q, i) for q, _, i, _ in exact(rows, 20)}
    assert len(got) == 2000 and len(want & {(g.query_id, g.vec_id) for g in got}) >= 0.9 * len(want)
    by = defaultdict(list)
    for g in sorted(got, key=lambda g: g["rank"]):
        by[g.query_id].append((-g.score, g.vec_id))
    assert all(v == sorted(v) and len(v) == 20 for v in by.values())


def test_multi_index_of_nothing(spark):
    table = vectors_table(spark, [(1, [1.0, 2.0]), (2, None)])
    assert multi_index.near_vectors(table, F.col("vec_id") % 20 == 0).count() == 0
    assert multi_index.near_vectors(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert multi_index.near_vectors(table, F.col("vec_id") == 1).count() == 0
    two = multi_index.near_vectors(vectors_table(spark, [(20, [1.0]), (3, [2.0])]), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, two.collect())) == [(20, 1, 3, 2.0)]


def test_heap_goes_by_summed_distance():
    r = np.random.default_rng(2)
    book = multi_index.Codebook(r.normal(size=(200, 6)), 8)
    count = r.integers(0, 3, book.cells)
    q = r.normal(size=6)
    d = (((q[:3] - book.first) ** 2).sum(1)[:, None] + ((q[3:] - book.second) ** 2).sum(1)).ravel()
    want = [int(c) for c in np.argsort(d, kind="stable") if count[c]]
    assert book.visited(q, count, float("inf")) == want
    few = book.visited(q, count, 10)
    assert few == want[: len(few)] and count[few].sum() >= 10 > count[few[:-1]].sum()
