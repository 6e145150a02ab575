"""Registered queries of the training-data operators, each over its whole table, and their DuckDB twins where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import ann, archives, decontam, mixing, negatives, orderminhash, pages, pii, substrings, templates, tokens, toxicity, vectorcodes
from sessionloom.session import checkpoint_dir, cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"), window=50, with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    classes = orderminhash.near_duplicates(table(spark, folder, "documents"), similarity=0.8)
    return classes.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


@query
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = templates.drop_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query
def op7_inverted_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages_table = table(spark, folder, "pages")
    return pages.extract(pages_table, pages.train(pages_table))


_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES["op11_hard_negatives"] = f"""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
),
scores AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_dot_product(a.q, x.q) AS BIGINT) AS score
  FROM kept a JOIN kept x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label)


def _codes_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """All rounds written out; sums of squares stay exact in doubles at these scales."""
    near = "arg_min(e, (list_dot_product(c, c) - 2 * list_dot_product(v, c)) * {n} + e)".format(n=entries)
    steps = []
    for r in range(rounds + 1):
        steps.append(f"near{r} AS (SELECT vec_id, p, any_value(v) AS v, {near} AS e FROM pieces JOIN book{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            steps.append(
                f"mean{r} AS (SELECT p, e, list(m ORDER BY j) AS m FROM (SELECT p, e, j, floor(sum(x) / count(*)) AS m"
                f" FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{r}) GROUP BY p, e, j) GROUP BY p, e),"
                f" book{r + 1} AS (SELECT b.p, b.e, coalesce(m.m, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)"
            )
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE {_FINITE}
),
pieces AS (SELECT vec_id, label, p, q[p * len(q) // {parts} + 1 : (p + 1) * len(q) // {parts}] AS v FROM kept, range({parts}) t(p)),
book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM pieces
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}
),
{", ".join(steps)},
coded AS (
  SELECT n.vec_id, string_agg(printf('%02x', CAST(n.e AS INTEGER)), '' ORDER BY n.p) AS code,
    CAST(sum(list_dot_product(n.v, n.v) - 2 * list_dot_product(n.v, b.c) + list_dot_product(b.c, b.c)) AS BIGINT) AS error
  FROM near{rounds} n JOIN book{rounds} b ON b.p = n.p AND b.e = n.e GROUP BY n.vec_id
),
books AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM book{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN books
"""


ORACLES["op13_vector_codes"] = _codes_sql()


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    found = vectorcodes.compress(table(spark, folder, "embeddings"))
    rows = vectorcodes.with_label_error(found.rows)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


ORACLES["op12_warc"] = """
WITH bodies AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM bodies)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM firsts
"""


@query
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    base = f"{checkpoint_dir(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"
    archives.write_arc(archives.page_captures(table(spark, folder, "pages")), f"{base}/arc")
    archives.convert(spark, f"{base}/arc", f"{base}/warc", key=archives.page_id_of(F.col("head")))
    records = archives.read_warc(spark, f"{base}/warc", payloads=False).where(F.col("record_type").isin("response", "revisit"))
    records = cut_lineage(records.withColumn("page_id", archives.page_id_of(F.col("head"))))
    return archives.resolve(records, "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
