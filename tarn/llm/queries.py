"""The registered query of each operator, with production parameters over whole tables, and SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontamination, html_extraction, lm_scoring, packing, quality_rules, sharding, simhash, suffix_dedup, token_counts, toxicity
from tarn.registry import Query, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    crc = {"ids_crc32": F.crc32("ids")}
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), carry=crc)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lm_scoring.lm_scores(docs).withColumn("held_out", lm_scoring.held_out())
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(generate_series(0, CAST(length(h) // 2 - 50 AS BIGINT))) AS p FROM d WHERE length(h) >= 100),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM p),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
r AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE m < doc_id),
g AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM r),
k AS (SELECT doc_id, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g),
spans AS (SELECT doc_id, n, min(p) AS a, max(p) + 50 AS z FROM k GROUP BY doc_id, n),
edges AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_a FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, min(a) AS first_a,
               string_agg(substr(h, 2 * z + 1, 2 * (coalesce(next_a, length(h) // 2) - z)), '' ORDER BY a) AS rest
        FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE substr(h, 1, 2 * first_a) || rest END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), {sharding.BITS}, '0') AS bits
  FROM documents),
b AS (
  SELECT d, substr(bits, 1, d) AS shard, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows
  FROM r, generate_series(0, {sharding.BITS}) g(d) GROUP BY ALL),
f AS (SELECT * FROM b WHERE shard_bytes <= {sharding.LIMIT} OR shard_rows = 1)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, f.shard, CAST(f.d AS INTEGER) AS depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_rows AS BIGINT) AS shard_rows
FROM r JOIN f ON f.shard = substr(r.bits, 1, f.d)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY f.d) = 1
"""


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule").cast("int").alias("rule"))


def queries() -> dict[str, Query]:
    every = (
        op1_token_counts,
        op2_decontamination,
        op3_packing,
        op4_lm_scoring,
        op5_toxicity,
        op6_suffix_dedup,
        op7_simhash,
        op8_sharding,
        op9_html_extraction,
        op10_quality_rules,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_dedup": OP6_SQL, "op8_sharding": OP8_SQL}
