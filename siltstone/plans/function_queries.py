"""Scalar functions and file events over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..streaming import debounce

DELAY = 300


def f1_entropy(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.round(S.entropy(F.col("text")), 6).alias("bits"))


def f7_confidence(spark, sf_dir):
    score = F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 101) / 100)
    rank = F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 20 + 1)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", S.confidence(score, rank, rank).alias("confidence"), S.confidence(score, rank, rank, 384).alias("uncalibrated"))


def f11_tokens(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.tokens(F.col("text")).alias("tokens"))


def f26_formats(spark, sf_dir):
    digits = lambda n: F.lpad((F.col("c_custkey") * 7919).cast("string"), n, "0")
    product = F.concat(F.lit("1"), digits(12))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", S.format_cpf(digits(11)).alias("person"), S.format_cnpj(digits(14)).alias("company"), S.format_registration(product).alias("product"))


def f30_digests(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def f31_scrub(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.scrub(F.col("text")).alias("scrubbed"))


def f34_overlap(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return docs.join(after, "doc_id").select("doc_id", F.round(S.overlap(F.col("text"), F.col("next_text")), 6).alias("overlap"))


def _file_events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("modify")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("path"), kind.alias("event_type"), "ts", F.col("event_id").alias("seq"))


def t1_debounce(spark, sf_dir):
    return debounce.bursts(_file_events(spark, sf_dir), DELAY).select(F.unix_micros(F.col("burst").cast("timestamp")).alias("burst"), "path", "outcome", "n_events")


def t3_moves(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "move").otherwise("modify")
    named = events.select(F.concat(F.lit("a"), "event_id").alias("src"), F.concat(F.lit("b"), "event_id").alias("dst"), kind.alias("event_type"), "ts", F.col("event_id").alias("seq"))
    return debounce.moves(named).select("path", "event_type", "seq")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> ''))"
_SCORE = "CASE WHEN vec_id % 7 <> 0 THEN vec_id % 101 / 1e2 END"
_WHITE = "'" + S.WHITE + "'"

QUERIES = {f.__name__: f for f in (f1_entropy, f7_confidence, f11_tokens, f26_formats, f30_digests, f31_scrub, f34_overlap, t1_debounce, t3_moves)}
#: f31 has no entry, as DuckDB's expressions lack look-behind; a test holds it against Python's.
ORACLES = {
    "f1_entropy": f"""WITH c AS (SELECT doc_id, unnest(string_split(trim(coalesce(text, ''), {_WHITE}), '')) AS ch FROM documents),
      n AS (SELECT doc_id, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY 1, 2), t AS (SELECT doc_id, k, sum(k) OVER (PARTITION BY doc_id) AS total FROM n),
      e AS (SELECT doc_id, -sum(CAST(k AS DOUBLE) / total * log2(CAST(k AS DOUBLE) / total)) AS bits FROM t GROUP BY doc_id)
      SELECT doc_id, round(coalesce(bits, 0), 6) AS bits FROM documents LEFT JOIN e USING (doc_id)""",
    "f7_confidence": f"""WITH h AS (SELECT vec_id, {_SCORE} AS s, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 20 + 1 END AS r FROM embeddings),
      k AS (SELECT *, CASE WHEN s <= 0.6 THEN 0 WHEN s <= 0.7 THEN (s - 0.6) * 3.5 WHEN s <= 0.78 THEN 0.35 + (s - 0.7) * 5 WHEN s <= 0.86 THEN 0.75 + (s - 0.78) * 2.5 ELSE 0.95 END AS c,
        CASE WHEN r <= 10 THEN 0.6 ELSE 0.4 END AS u FROM h)
      SELECT vec_id, round(CAST(CASE WHEN s IS NULL THEN CASE WHEN r IS NULL THEN 0 ELSE 0.3 END WHEN r IS NULL THEN least(c, 0.74) ELSE c END AS DOUBLE), 4) AS confidence,
        round(CAST(CASE WHEN s IS NULL THEN CASE WHEN r IS NULL THEN 0 ELSE 0.3 END WHEN r IS NULL THEN least(u, 0.74) ELSE u END AS DOUBLE), 4) AS uncalibrated FROM k""",
    "f11_tokens": f"SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, (length(trim(text, {_WHITE})) + 3) // 4) END AS BIGINT) AS tokens FROM documents",
    "f26_formats": r"""WITH d AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '0') AS p, lpad(CAST(c_custkey * 7919 AS VARCHAR), 14, '0') AS c, '1' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') AS r FROM customer)
      SELECT c_custkey, p[1:3] || '.' || p[4:6] || '.' || p[7:9] || '-' || p[10:11] AS person, c[1:2] || '.' || c[3:5] || '.' || c[6:8] || '/' || c[9:12] || '-' || c[13:14] AS company,
        r[1:1] || '.' || r[2:5] || '.' || r[6:9] || '.' || r[10:12] || '-' || r[13:13] AS product FROM d""",
    "f30_digests": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "f34_overlap": f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents)
      SELECT a.doc_id, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0e0 ELSE len(list_intersect(a.t, b.t)) / CAST(greatest(len(a.t), len(b.t)) AS DOUBLE) END, 6) AS overlap FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""",
    "t1_debounce": f"""WITH e AS (SELECT 'u' || user_id % 50 AS path, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'modify' END AS kind, epoch_us(ts) AS t, event_id AS seq FROM events WHERE ts IS NOT NULL),
      g AS (SELECT *, t - lag(t) OVER (ORDER BY t, seq) AS gap FROM e), b AS (SELECT *, max(CASE WHEN gap IS NULL OR gap >= {DELAY * 1_000_000} THEN t END) OVER (ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS burst FROM g)
      SELECT burst, path, CASE WHEN bool_or(kind = 'delete') THEN 'delete' ELSE arg_max(kind, (t, seq)) END AS outcome, count(*) AS n_events FROM b GROUP BY burst, path""",
    "t3_moves": "SELECT 'a' || event_id AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'modify' END AS event_type, event_id AS seq FROM events UNION ALL SELECT 'b' || event_id, 'create', event_id FROM events WHERE event_type = 'error'",
}
