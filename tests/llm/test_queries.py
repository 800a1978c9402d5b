"""The registered queries: those with SQL against it, the others against what their tables must give; and the pipeline."""

import hashlib
import os
import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessera.llm import ordinal_quality, queries, suffix_dedup
from tessera.llm.shared import stage, staged

HERE = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not HERE.is_dir(), reason="no tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(frame):
    def one(v):
        return None if v is None or v is pd.NA or v != v else float(f"{v:.9g}") if isinstance(v, float) else v

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in HERE.glob("*.parquet"):
        duck.sql(f"create view {t.stem} as select * from '{t}'")
    got, want = queries.QUERIES[name](spark, str(HERE)).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert plain(got) == plain(want)


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert [n for n in found if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in found
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 14)]


def test_repeats_of_the_table(spark):
    """Every byte of every document, by a table of all strings of 200 bytes."""
    docs = pq.read_table(HERE / "documents.parquet").to_pandas()
    raws, seen = [(t or "").encode() for t in docs.text], {}
    for n, b in enumerate(raws):
        for j in range(len(b) - 199):
            seen.setdefault(hashlib.blake2b(b[j : j + 200], digest_size=16).digest(), []).append((n, j))
    marks = [np.zeros(len(b) + 1, int) for b in raws]
    for at in seen.values():
        for n, j in at if len(at) > 1 else ():
            marks[n][j] += 1
            marks[n][j + 200] -= 1
    want = []
    for i, b, m in zip(docs.doc_id, raws, marks):
        gone = np.cumsum(m)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(spark.read.parquet(str(HERE / "documents.parquet")), keep=False).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r[2] for r in want)


def test_labels_held_out(spark):
    """Fitted on four fifths of the labels, the classifier knows the good ones of the rest."""
    here = HERE.parent / "sf0.1" if (HERE.parent / "sf0.1").is_dir() else HERE
    docs, labels = (spark.read.parquet(str(here / f"{t}.parquet")) for t in ("documents", "labels"))
    model = ordinal_quality.train(docs, labels.where("doc_id % 5 <> 0"))
    rest = ordinal_quality.grade(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").toPandas()
    good = (rest.quality == 1) & (rest.toxic == 0)
    hit = rest.selected == good
    rank = rest.expected_grade.rank()
    auc = (rank[good].mean() - (good.sum() + 1) / 2) / max(1, (~good).sum())
    assert hit.mean() >= 0.9 and auc >= 0.95 and len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    assert rest[good].selected.mean() >= 0.95 and rest[rest.toxic == 1].selected.mean() <= 0.2


def test_pipeline(spark):
    """Each stage works on all of the one before; nothing of a kept document is lost but repeats; all that is mixed is packed."""
    docs, kept = spark.read.parquet(str(HERE / "documents.parquet")), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources", "best-fit packing"]
    for name, work in corpus_pipeline.STAGES:
        after = stage(work(spark, docs, str(HERE)), "test")
        kept[name] = (docs, after)
        if name != "best-fit packing":
            assert after.columns == docs.columns
        docs = after
    before, after = kept["quality classifier"]
    assert 0 < after.count() < before.count() and after.exceptAll(before).isEmpty()
    before, after = kept["n-gram Jaccard join"]
    assert after.exceptAll(before).isEmpty() and after.count() == after.select("doc_id").distinct().count() < before.count()
    sets = {}
    for r in before.collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    stay = {r.doc_id for r in after.select("doc_id").collect()}
    for i, a in sets.items():
        near = [j for j, b in sets.items() if j != i and 100 * len(a & b) >= 75 * len(a | b)]
        assert near or i in stay  # a document without a near copy stays
        assert not (i in stay and any(j in stay for j in near))
    before, after = kept["substring dedup"]
    assert after.count() == before.count() and after.where(F.col("n_chars") != F.length("text")).isEmpty()
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(len(r.text) <= len(texts[r.doc_id]) for r in after.collect())
    before, after = kept["mixing sources"]
    assert after.distinct().exceptAll(before.distinct()).isEmpty()
    before, after = kept["best-fit packing"]
    assert after.where("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    there = staged()
    assert corpus_pipeline.run(spark, str(HERE)).count() == after.count()
    assert len(staged()) == len(there) + 1  # the result alone


def test_pipeline_without_documents(spark, tmp_path):
    """An empty table goes through all stages."""
    for t in ("documents", "labels"):
        spark.read.parquet(str(HERE / f"{t}.parquet")).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
