"""The registered queries of this subpackage and, where SQL can say the same, their SQL.

Each query reads whole tables through its operator with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digest, format_conversations
from .jaccard_join import jaccard_components
from .line_quality import clean_lines
from .mixing import mixed
from .multi_index import near_vectors
from .ordinal_quality import grade, train
from .packing import pack
from .passage_chains import fuzzy_passages
from .spelling_variants import spelling_variants
from .suffix_dedup import remove_repeats
from .tiered_search import ranked_search
from .token_counts import section_tokens
from .topk_search import exact_top_k


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(_read(spark, sf_dir, "documents"))


def op2_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(_read(spark, sf_dir, "documents"), keep_text=False).drop("clean_text")


def op3_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages(_read(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.explode(F.array(*more)).alias("r")).select("r.*")
    return digest(format_conversations(turns.unionByName(extra)))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), keep=False).drop("kept")


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return grade(docs, train(docs, _read(spark, sf_dir, "labels")))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    vectors = rows.select("vec_id", F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.floor(64 * x.cast("double"))).cast("double")).alias("v"))
    return exact_top_k(vectors, F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return near_vectors(vectors, F.col("vec_id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_section_tokens, op2_clean_lines, op3_passage_chains, op4_chat_format, op5_suffix_dedup)
    + (op6_ordinal_quality, op7_topk_search, op8_packing, op9_jaccard_join, op10_mixing)
    + (op11_ranked_search, op12_spelling_variants, op13_multi_index)
}

_SMALL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"unnest(regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))".format(_SMALL.format("text"))
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ESC = r"regexp_replace(regexp_replace({0}, '</turn(\\*)>', '</turn\1\\>', 'g'), '(\\*)### ', '\\\1### ', 'g')"
_ROLE = _ESC.format(r"regexp_replace({0}, ':(\\*) ', ':\1\\ ', 'g')")

ORACLES = {
    "op4_chat_format": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(14 + length({_ROLE.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars,
            true AS round_trip
        FROM t GROUP BY conv_id""",
    "op7_topk_search": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.row AS asked, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_jaccard_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 75 * (x.n + y.n - o)),
        c AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT l.v, c.root FROM c JOIN l ON l.u = c.node WHERE c.root < l.v)
        SELECT n.doc_id, n.n AS n_shingles, min(c.root) AS component_id FROM n JOIN c ON c.node = n.doc_id GROUP BY n.doc_id, n.n""",
    "op10_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
        t AS (
            SELECT *, 2.0::DOUBLE * source_size AS bound, (sum(source_size) OVER ()) * 1.5::DOUBLE
                - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
        g AS (
            SELECT source, source_size, least(bound, weight * coalesce(max(CASE WHEN bound > weight * (rest / weights) THEN rest / weights END) OVER (), 'inf'::DOUBLE)) AS target FROM t),
        r AS (
            SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size = 0 THEN 0::DOUBLE ELSE g.target / g.source_size END AS rate
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target,
            size * (CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE
                < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
        FROM r""",
    "op11_ranked_search": f"""
        WITH i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
        r AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
        p AS (SELECT row, doc_id, term, count(*) AS tf FROM (SELECT row, doc_id, {_TERMS} AS term FROM r) GROUP BY ALL),
        d AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY row),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
        m AS (SELECT row, 100 - 75 + ((75 * n * docs) // terms) AS m FROM d, c),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term),
        s AS (
            SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE t AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
        r AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all({_SMALL.format('text')}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
        b AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS b FROM r WHERE length(run) >= 6),
        h AS (
            SELECT run, n, xor(4294967295, list_reduce(list_transform(range(CAST(length(b) // 2 AS BIGINT)), lambda i: CAST('0x' || b[2 * i + 1:2 * i + 2] AS BIGINT)),
                lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295)) AS h FROM b, t),
        a AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM a WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM w),
        k AS (SELECT word, n, place, left(word, place - 1) || substr(word, place + 1) AS key FROM e),
        x AS (SELECT DISTINCT word, n, key FROM k),
        p AS (
            SELECT a.word, o.word AS near, o.n AS near_n FROM k a JOIN k o ON a.key = o.key AND a.place = o.place AND a.word <> o.word
            UNION ALL SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.key
            UNION ALL SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.key),
        q AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
        f AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
            FROM w LEFT JOIN q USING (word)),
        o AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT o.word, f.form, steps + 1 FROM o JOIN f ON f.word = o.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM o GROUP BY word) l USING (word)""",
}
