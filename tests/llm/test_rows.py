"""Rows that share a doc_id, equal rows, clashing columns, and words made to collide."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard_join, kernel, mixing, passage_chains, shared

CLASHES = ("size", "copies", "copy", "target", "source_size", "source_key", "_source", "_doc", "_kept", "_spans", "doc", "Key", "spans", "place", "bucket", "rep", "h")


def own(name, n):
    return [f"{name}w{i}" for i in range(n)]


def clashing(docs):
    return docs.withColumns({c: F.lit(7) for c in CLASHES})


def thue_morse(n, letters="ab"):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(letters[b] for b in bits)


@pytest.mark.parametrize("size", [64, 1024, 4096])
def test_words_made_to_collide(spark, size):
    docs = spark.createDataFrame([(1, thue_morse(size)), (2, thue_morse(size, "ba"))], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == [(1, 1, 1), (2, 1, 2)]


def test_span_hashes():
    """Equal spans have equal hashes wherever they lie; others differ."""
    import numpy as np

    r = random.Random(4)
    spans = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 1, 7, 8, 9, 16, 17, 100, 511, 512, 513, 900]))) for _ in range(400)] + [b"\0" * n for n in range(20)]
    raw, at = b"", []
    for s in spans + spans:
        raw += b"xyz"[: r.randint(0, 3)]
        at.append((len(raw), len(raw) + len(s)))
        raw += s
    h = kernel.spans_hash(np.frombuffer(raw, np.uint8), *np.array(at).T)
    assert len(set(h.tolist())) == len(set(spans)) and (h[: len(spans)] == h[len(spans) :]).all()


def test_hashes_of_every_place():
    import numpy as np

    raw = np.frombuffer(bytes(random.Random(1).choice(b"ab") for _ in range(3000)), np.uint8)
    for size in (8, 72, 200):
        h = kernel.every_hash(raw, size)
        of = [raw[i : i + size].tobytes() for i in range(len(raw) - size + 1)]
        assert len(h) == len(of) and len(set(zip(of, h.tolist()))) == len(set(of)) == len(set(h.tolist()))
    assert len(kernel.every_hash(raw[:199], 200)) == 0


def test_jaccard_rows_of_one_id(spark):
    """Rows of one doc_id are documents of their own, each with its links."""
    a, b = own("a", 60), own("b", 60)
    rows = [(5, a), (5, b), (7, [*a, "x"]), (9, [*b, "y"]), (3, [*b, "z"])]
    docs = clashing(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (9, 3)]


def test_one_of_each_component_stays(spark):
    a, b = " ".join(own("a", 60)), " ".join(own("b", 60))
    rows = [(5, a), (5, a), (5, b), (7, a + " x"), (9, b + " y"), (6, None), (6, ""), (6, ""), (4, " "), (None, "null id"), (None, "null id"), (None, "another one")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(5, a), (5, b), (6, None), (6, ""), (4, " "), (None, "null id"), (None, "another one")], key=repr)
    assert corpus_pipeline.ngram_jaccard(spark, docs.limit(0), "").count() == 0


def test_passages_of_rows_of_one_id(spark):
    """Only the text that holds a passage loses it, and equal rows lose it alike."""
    p = own("p", 70)
    rows = [(2, [*own("a", 20), *p, *own("b", 20)]), (2, own("z", 110)), (1, [*own("c", 5), *p]), (3, own("d", 9)), (3, own("d", 9)), (None, [*p[:60], *own("e", 9)])]
    docs = clashing(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
    found = passage_chains.fuzzy_passages(docs)
    assert {(r.doc_id, r.start, r.end, r.ref_id) for r in found.collect()} >= {(2, 20, 90, 1), (1, 5, 65, None)}
    cut = passage_chains.remove_passages(docs, found)
    assert cut.columns == docs.columns
    left = sorted(len(r.text.split()) for r in cut.collect())
    assert left == sorted([40, 110, 15, 9, 9, 69])  # the passage's last ten words are in the null id's text no more


def test_passages_between_documents_that_hold_the_seeds(spark):
    """Documents before and between, each with a part of the passage, do not hide the pair that shares it."""
    p = own("p", 70)
    for copies in (1, 3, 12):
        halves = [[*own(f"{n}x{i}", 9), *part] for n in range(copies) for i, part in enumerate((p[:40], p[30:]))]
        made = [(n, w) for n, w in enumerate(halves)] + [(200 + n, [*w, "end"]) for n, w in enumerate(halves)] + [(100, [*own("y", 9), *p]), (300, [*p, *own("z", 9)])]
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in made], "doc_id long, text string")
        for hot in (2, 64):
            rows = passage_chains.fuzzy_passages(docs, hot=hot).where("doc_id = 300 and ref_id = 100").collect()
            assert any(r.n_matched == 70 for r in rows)


@pytest.mark.parametrize("hot", [1, 3, 64])
@pytest.mark.parametrize("seed", range(3))
def test_exact_passages_are_all_found(spark, seed, hot):
    """Each run of 50 words that an earlier document holds as well lies in reported passages."""
    r = random.Random(seed)
    pool = [own(f"q{i}", r.randint(20, 90)) for i in range(12)]
    docs = []
    for i in range(60):
        parts = [r.choice(pool) for _ in range(r.randint(1, 4))]
        words = []
        for n, part in enumerate(parts):
            lo = r.randint(0, len(part) // 2)
            words += [*part[lo : r.randint(lo, len(part))], *own(f"d{i}p{n}", r.choice([0, 1, 30]))]
        docs.append((i, words))
    found = passage_chains.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in r.sample(docs, len(docs))], "doc_id long, text string"), hot=hot)
    covered = {}
    for row in found.collect():
        covered.setdefault(row.doc_id, set()).update(range(row.start, row.end))
    seen = {}
    for i, w in docs:
        for j in range(len(w) - 49):
            gram = tuple(w[j : j + 50])
            if seen.setdefault(gram, i) < i:
                assert covered.get(i, set()) >= set(range(j, j + 50)), (i, j)


def test_mix_keeps_columns(spark):
    docs = clashing(spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string"))
    rows = mixing.emitted(docs)
    assert rows.columns == docs.columns and {tuple(x[3:]) for x in rows.collect()} == {(7,) * len(CLASHES)}
    assert mixing.emitted(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(3000)], "u long, v long").orderBy(F.rand(3))
    from tessera.llm.graph import components

    assert components(links).agg(F.count("*"), F.max("root")).first()[:] == (3000, 0)


def test_stages_need_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Elsewhere)


def test_pipeline_stages_with_columns_of_any_type(spark):
    """Maps and variants are no keys, and yet equal rows are told from others."""
    words = " ".join(own("w", 30))
    docs = spark.createDataFrame([(1, words, {"a": 1}, [{"b": 2}]), (1, words, {"a": 1}, None), (2, words, None, None), (3, "other text", {}, None)], "doc_id long, text string, m map<string, int>, n array<map<string, int>>")
    docs = docs.withColumn("v", F.parse_json(F.lit('{"x": 1}')))
    kept = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3]


def test_mix_of_rows_without_ids(spark):
    """Rows that share an id, or have none, draw each for itself."""
    for key in (F.lit(None).cast("long"), F.lit(5).cast("long"), F.col("id") % 3):
        docs = spark.range(3000).select(key.alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2000, "x").otherwise("y").alias("source"))
        rows = mixing.mixed(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
        assert len(rows) == 2 and all(abs(r.taken - r.target) <= 0.06 * r.target for r in rows)
        assert mixing.mixed(docs).exceptAll(mixing.mixed(docs)).isEmpty()


def test_stages_are_told_by_thread(spark):
    """What another thread stages is not released."""
    import threading

    there, made = shared.staged(), []
    t = threading.Thread(target=lambda: made.append(shared.stage(spark.range(3), "other")))
    t.start(), t.join()
    mine = shared.stage(spark.range(2), "mine")
    shared.release(spark, there)
    assert made[0].count() == 3 and mine._stage_path not in shared.staged()
    shared.unstage(made[0])


def covered(spark, docs, batch, order):
    """The words of passages by document, and the rows, whatever batches the texts come in."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = passage_chains.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in order], "doc_id long, text string").coalesce(2)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = {}
    for r in rows:
        words.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return words, rows


def replaced(words, percent, seed):
    r, out = random.Random(seed), list(words)
    for i in r.sample(range(1, len(out) - 1), len(out) * (100 - percent) // 100):
        out[i] = f"r{seed}x{i}"
    return out


@pytest.mark.parametrize("copies", [80, 79])
def test_passages_beside_many_copies(spark, copies):
    """A fuzzy passage all of whose seeds stand in many copies of another text as well, in any batches."""
    p = own("p", 70)
    long = [w for i in range(0, 70, 7) for w in (*p[i : i + 12], *own(f"l{i}", 100))] + own("m", 55)
    docs = [(i, long) for i in range(copies)] + [(1000, [*own("a", 60), *p, *own("b", 60)]), (5000, [*own("c", 60), *replaced(p, 90, 3), *own("d", 60)])]
    first = None
    for batch in (7, 30, 10_000):
        words, _ = covered(spark, docs, batch, random.Random(batch).sample(docs, len(docs)))
        assert set(range(63, 127)) <= words[5000] and max(words[5000]) < 130
        assert all(words[i] == set(range(len(long))) for i in range(1, copies))
        assert first in (None, words)
        first = words


def test_passages_of_common_pieces(spark):
    """Passages of which 16 documents before hold each piece of 8 words, but none the whole."""
    hits = 0
    for percent in (75, 80, 90):
        docs = []
        for n in range(12):
            p = own(f"p{n}x", 64)
            for k in range(16):
                docs.append((n * 100 + k, [w for i in range(0, 64, 8) for w in (*p[i : i + 8], *own(f"f{n}x{k}x{i}", 9))]))
            docs += [(n * 100 + 50, [*own(f"a{n}x", 30), *p, *own(f"b{n}x", 30)]), (n * 100 + 60, [*own(f"c{n}x", 30), *replaced(p, percent, n), *own(f"d{n}x", 30)])]
        words, rows = covered(spark, docs, 10_000, docs)
        found = {r.doc_id for r in rows if r.doc_id % 100 == 60 and r.ref_id == r.doc_id - 10}
        hits = len(found)
        print(percent, hits)
        assert hits >= (10 if percent > 75 else 8)
        assert all(len(w) >= 50 for d, w in words.items() if d in found)


@pytest.mark.parametrize("seed", range(2))
def test_passages_do_not_depend_on_batches(spark, seed):
    """Common phrases, copies, near copies and mixed passages: the same words whatever the batches and the order of rows."""
    r = random.Random(seed)
    phrases, pool = [own(f"h{i}", 9) for i in range(4)], [own(f"q{i}", r.randint(40, 120)) for i in range(6)]
    docs = []
    for i in range(150):
        words = own(f"d{i}", r.randint(0, 40))
        for n in range(r.randint(1, 3)):
            part = r.choice(pool)
            words += r.choice([part, replaced(part, r.choice([80, 90, 97]), 1000 * i + n), r.choice(phrases), [w for p in r.sample(phrases, 3) for w in p]]) + own(f"d{i}n{n}", r.choice([0, 2, 30]))
        docs.append((i, words))
    want = None
    for batch in (7, 100, 10_000):
        words, rows = covered(spark, docs, batch, r.sample(docs, len(docs)))
        assert words and (want is None or words == want), batch
        want = words


def test_stages_leave_no_shuffle_files(spark):
    """A stage's shuffle files go once it is written, and the session's setting stays as it was."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(setting, "false")
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    made = shared.stage(spark.range(5000).repartition(3, "id"), "shuffled")
    until = time.time() + 20
    while files() - before and time.time() < until:  # Spark deletes them behind
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(setting) == "false"
    assert made.count() == 5000


def test_asked_documents_come_in_bounded_parts(monkeypatch):
    """A document that many chains ask for is split among rows, and its words among batches, with nothing lost."""
    monkeypatch.setattr(passage_chains, "ASKED", 40)
    monkeypatch.setattr(passage_chains, "SLICED", 300)
    asks = np.array([(d, 3 * i, 3 * i + 60, 7 * i + d) for d, n in ((1, 250), (2, 3)) for i in range(n)], passage_chains._ASK)
    blobs = pa.table({"asks": pa.array([shared.planes(asks[::2]), shared.planes(asks[1::2])])})
    rows = passage_chains._by_doc((), blobs)
    assert [len(x) // asks.itemsize for x in rows["asks"].to_pylist()] == [40] * 6 + [10, 3]
    text = " ".join(f"w{i}" for i in range(500))
    parts = list(passage_chains._slices([pa.record_batch({"text": [text] * len(rows), "asks": rows["asks"].combine_chunks()})], 1))
    got = np.concatenate([np.frombuffer(b, passage_chains._ASK) for p in parts for b in p.column(1).to_pylist()])
    sizes = [sum(map(len, p.column(2).to_pylist())) // 4 for p in parts]
    assert max(sizes) < 300 + 60 and sum(sizes) == int((np.minimum(asks["hi"], 500) - np.minimum(asks["lo"], 500)).sum())
    assert sorted(got["chain"].tolist()) == sorted(asks["chain"].tolist())


def test_planes():
    rows = np.zeros(7, passage_chains._SEED)
    rows["h"], rows["doc"] = np.arange(7) << 40, -np.arange(7)
    column = pa.chunked_array([[shared.planes(rows[:3]), None], [shared.planes(rows[3:]), b""]], pa.binary())
    assert (shared.unplaned(column, rows.dtype) == rows).all() and len(shared.unplaned(pa.chunked_array([], pa.binary()), rows.dtype)) == 0


def test_whole_windows_are_dealt_in_bounded_parts(monkeypatch):
    """Windows of common seeds are dealt text by text once they are many, not a batch at once, and none is lost."""
    sizes = []
    monkeypatch.setattr(passage_chains, "HELD", 1000)
    monkeypatch.setattr(passage_chains, "_settled", lambda made, *rest: sizes.append(sum(map(len, made))) or [])
    words = 150_000
    text = " ".join(f"w{i:06}" for i in range(words))
    common = np.arange(words, dtype="<i4").tobytes()
    batch = pa.record_batch({"doc_id": [1, 2, 3], "text": [text] * 3, "common": pa.array([common] * 3, pa.binary())})
    assert not list(passage_chains._whole_windows([batch], 4, 5, 3, 50, 16))
    assert sizes == [words - 49] * 3


def test_chains_of_a_line_that_repeats():
    """A line that two documents repeat has as many chains as cover it and reach beyond it, not one for each place."""
    links = np.zeros(300, passage_chains._LINK)
    links["doc"], links["ref"], links["x"], links["y"], links["lo"], links["hi"] = 5, 3, 145 + 2 * np.arange(300), 150, 45, 50
    rows = pa.table({"rows": [shared.planes(links)]})
    got = passage_chains._chains((), rows, 1, 5, 50, 6, True).to_pylist()
    spans = sorted(tuple(np.frombuffer(r["segments"], "<i4")[:2].tolist()) for r in got if r["segments"])
    assert len(spans) < 80 and {x for s, e in spans for x in range(s, e)} == set(range(100, 793))
    assert {(x, x + 95) for x in range(100, 150, 2)} <= set(spans)  # their ends may reach words before the line
    assert len(passage_chains._chains((), rows, 1, 5, 50, 6).drop_null()) == 0 and passage_chains._chains((), rows, 1, 5, 50, 6)["segments"].null_count == 1


def test_passages_of_a_line_that_repeats(spark):
    """Words that a document repeats within itself, all of common seeds, are found at each of their places."""
    line = ["is", "onhe"] * 150
    made = [(i, " ".join(own(f"a{i}", 40) + line[: 300 - 20 * i] + own(f"b{i}", 40))) for i in range(4)]
    found = passage_chains.fuzzy_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()
    for i in range(1, 4):
        assert {x for r in found if r.doc_id == i for x in range(r.start, r.end)} == set(range(40, 340 - 20 * i))


def test_buckets_follow_the_texts(spark, monkeypatch):
    """Few partitions and many texts: a bucket stands for a bounded share of the texts, and the same words are found."""
    r, pool = random.Random(3), [own(f"q{i}", 70) for i in range(5)]
    docs = spark.createDataFrame([(i, " ".join(own(f"d{i}", 30) + r.choice(pool) + own(f"e{i}", 9))) for i in range(80)], "doc_id long, text string")
    used = []

    def kept(df, name, *rest, _stage=shared.stage, **options):
        out = _stage(df, name, *rest, **options)
        if name == "chains":
            used.append(out.where("segments is not null").select("bucket").distinct().count())
        return out

    monkeypatch.setattr(passage_chains, "stage", kept)
    found = [sorted(map(tuple, passage_chains.fuzzy_passages(docs).collect()))]
    assert used[0] <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(passage_chains, "SHARE", 1 << 10)
    found.append(sorted(map(tuple, passage_chains.fuzzy_passages(docs).collect())))
    assert found[0] == found[1] and len(found[0]) == 75
    assert used[2] > 20


def test_batches_that_python_gets_are_bounded(spark):
    """A stage bounds the bytes of its batches on request, and the session's setting stays as it was."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, texts = spark.conf.get(setting), spark.range(400).repartition(1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = lambda it: (pa.record_batch({"n": [b.nbytes]}) for b in it)
    most = shared.stage(texts.mapInArrow(sizes, "n long"), "sizes", 1 << 17).agg(F.max("n"), F.sum("n")).first()
    assert most[0] <= 1 << 18 and most[1] >= 4_000_000 and spark.conf.get(setting) == before


def test_rows_that_the_reader_holds_are_bounded(spark):
    """Where batches are bounded, Spark's reader holds few rows at once, and the session's setting stays as it was."""
    setting = "spark.sql.parquet.columnarReaderBatchSize"
    before, rows = spark.conf.get(setting), shared.stage(spark.range(4000).coalesce(1), "rows")
    read = lambda t: t._jdf.queryExecution().executedPlan().toString() and spark.conf.get(setting)
    seen = []

    class Kept:
        """A table that tells the setting with which it is written."""

        sparkSession = spark
        schema = rows.schema

        @property
        def write(self):
            seen.append(read(rows))
            return rows.write

    assert shared.stage(Kept(), "few", 1 << 17).count() == shared.stage(Kept(), "many").count() == 4000
    assert int(seen[0]) <= 128 and seen[1] == before == spark.conf.get(setting)


def test_buckets_are_dealt_evenly(spark, monkeypatch):
    """Tasks of the large exchanges get as many buckets each, whatever the hashes and the session's partitions are."""
    docs = spark.createDataFrame([(i, " ".join(own(f"d{i}", 30) + own("same", 70) + own(f"e{i}", 9))) for i in range(60)], "doc_id long, text string")
    met = []

    def kept(df, name, *rest, _stage=shared.stage, **options):
        part = name == "passages" and not met
        out = _stage(df.withColumn("part", F.spark_partition_id()) if part else df, name, *rest, **options)
        if part:
            met.extend(r.n for r in out.withColumn("bucket", named("doc_id", "ref_id")).groupBy("part").agg(F.countDistinct("bucket").alias("n")).collect())
            path, out = out._stage_path, out.drop("part")
            out._stage_path = path
        return out

    named = F.udf(lambda doc, ref: passage_chains._named(doc, ref) % 16, "long")
    monkeypatch.setattr(passage_chains, "stage", kept)
    monkeypatch.setattr(passage_chains, "buckets", lambda _, size, share: 16 if share == passage_chains.SHARE else 8)
    assert passage_chains.fuzzy_passages(docs).count() == 59
    assert len(met) == 8 and set(met) <= {1, 2} and sum(met) > 12


def test_seeds_are_settled_across_batches():
    """What is dealt depends on the number of seeds held, not on how texts come in batches."""
    texts = [" ".join(own("same", 60)) for _ in range(9)]
    whole = pa.record_batch({"doc_id": list(range(9)), "text": texts})
    sizes = [sum(b.num_rows for b in passage_chains._seeds(bs, 4, 5, 3, 50, 16)) for bs in ([whole], [whole.slice(i, 1) for i in range(9)])]
    assert sizes[0] == sizes[1]
