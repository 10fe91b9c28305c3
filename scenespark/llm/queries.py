"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bsi, cotrain, html_blocks, lines, mixing, packing, partenum, tokens, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bsi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return bsi.top_inner(e, e.where("vec_id % 100 = 0"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return ann.nearest(e, e.where("vec_id % 100 = 0"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(_read(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_bsi_topk, op2_warc, op3_ann, op4_ngram_jaccard, op5_token_counts, op6_html_text, op7_quality, op8_line_dedup, op9_mixing, op10_packing)}

ORACLE_SQL = {
    "op1_bsi_topk": """
        WITH ok AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS hex FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, b) AS first_id FROM p)
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS x FROM w),
        n AS (SELECT w.doc_id, count(s.x) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
        k AS (SELECT doc_id, hash(string_agg(x, chr(10) ORDER BY x)) AS k, max(doc_id) AS one FROM s GROUP BY doc_id),
        r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM k),
        u AS (SELECT s.doc_id, x FROM s JOIN r ON r.doc_id = s.doc_id AND r.rep = s.doc_id),
        l AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT l.a, l.b FROM l JOIN n p ON p.doc_id = l.a JOIN n q ON q.doc_id = l.b WHERE 100 * same >= 80 * (p.n + q.n - same)),
        d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        c(node, comp) AS (SELECT a, a FROM d UNION SELECT d.b, c.comp FROM c JOIN d ON d.a = c.node),
        m AS (SELECT node, min(comp) AS comp FROM c GROUP BY node)
        SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(m.comp, r.rep, n.doc_id) AS component_id
        FROM n LEFT JOIN r USING (doc_id) LEFT JOIN m ON m.node = r.rep""",
    "op8_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS gone FROM k LEFT JOIN hot USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
