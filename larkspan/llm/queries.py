"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, mixing, ngrams, quality, sharding, simhash, suffixes, superkmer, templates, tokens


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"), words=3, radius=3)


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngrams.score(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "backed_off", "seen_once", F.round("log_score", 6).alias("log_score"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("text_hash")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(read(spark, sf_dir, "documents"), window=400)


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.deduplicate(read(spark, sf_dir, "documents"), window=20)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_kd_tree_sharding, op2_simhash_covering, op3_stupid_backoff, op4_source_mixing, op5_suffix_dedup, op6_template_decontamination, op7_rotation_codes, op8_rans_tokens, op9_superkmer_dedup, op10_ordinal_quality)}

#: Target: capped sources leave their excess to the others by weight, so target = least(limit, weight * level).
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, (ARRAY[5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
r AS (
  SELECT *, 3.0::DOUBLE * s / w AS ratio, (sum(s) OVER ())::DOUBLE AS total,
         coalesce(sum(3.0::DOUBLE * s) OVER (ORDER BY 3.0::DOUBLE * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 3.0::DOUBLE * s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s),
l AS (SELECT arg_min((total - capped) / open_w, ratio) FILTER ((total - capped) / open_w <= ratio) AS level FROM r),
t AS (SELECT source, s AS source_size, least(3.0::DOUBLE * s, w * level) AS target FROM r, l),
o AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM o
"""

#: All n-grams up to three words are in the model, so its own corpus never backs off.
OP3_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS c, unnest(list_concat([NULL], ws[:-2])) AS b, unnest(list_concat([NULL, NULL], ws[:-3])[:len(ws)]) AS a FROM w WHERE len(ws) > 0),
c1 AS (SELECT c, count(*)::DOUBLE AS n FROM t GROUP BY c),
c2 AS (SELECT b, c, count(*)::DOUBLE AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
c3 AS (SELECT a, b, c, count(*)::DOUBLE AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
total AS (SELECT sum(n) AS n FROM c1),
s AS (
  SELECT r, ln(CASE WHEN t.a IS NOT NULL THEN tri.n / ab.n WHEN t.b IS NOT NULL THEN bc.n / wb.n ELSE wc.n / total.n END) AS s,
         (CASE WHEN t.a IS NOT NULL THEN tri.n WHEN t.b IS NOT NULL THEN bc.n ELSE wc.n END = 1)::BIGINT AS once
  FROM t JOIN c1 wc ON t.c = wc.c LEFT JOIN c1 wb ON t.b = wb.c LEFT JOIN c2 bc ON t.b = bc.b AND t.c = bc.c
       LEFT JOIN c2 ab ON t.a = ab.b AND t.b = ab.c LEFT JOIN c3 tri ON t.a = tri.a AND t.b = tri.b AND t.c = tri.c, total)
SELECT w.doc_id, len(any_value(w.ws))::BIGINT AS n_words, 0::BIGINT AS backed_off, coalesce(sum(once), 0)::BIGINT AS seen_once, round(sum(s), 6) AS log_score
FROM w LEFT JOIN s ON w.r = s.r GROUP BY w.r, w.doc_id
"""

SQL = {"op3_stupid_backoff": OP3_SQL, "op4_source_mixing": OP4_SQL}
