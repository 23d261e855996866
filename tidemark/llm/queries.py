"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, conversations, decontaminate, language_id, license_scan, line_dedup, main_text, masked_lm, media, mixing, ngram_join, quality, token_files

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_blocks(documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(documents(spark, sf_dir), ngram_join.SetSpec(words=4, percent=85))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.texts_as_images(documents(spark, sf_dir)))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(token_files.write_tokens(documents(spark, sf_dir), tokenizer_path()))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_scores(docs, model).select("doc_id", "quality_score", (F.col("quality_score") >= 0.5).alias("keep"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scores(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict_languages(docs, language_id.fit(docs.where(~language_id.held_out())))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("scanned")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_ngram_jaccard_join, op3_media_columns, op4_benchmark_decontamination, op5_token_files, op6_quality_classifier, op7_source_mixing, op8_lm_scoring, op9_language_id, op10_line_dedup, op10_passage_dedup, op11_conversation_repair, op12_main_text, op13_centroid_clustering, pipeline]
    return {f.__name__: f for f in own}


#: The same targets and thresholds from full running sums: for each source, the hash up to which documents are taken. Ids are unique.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3)]::DOUBLE AS w,
             row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS k FROM s),
c AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM c WINDOW b AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM l WHERE level <= ratio)) AS target FROM l),
g AS (SELECT *, target > source_size AS twice, CASE WHEN target > source_size THEN target - source_size ELSE target END AS goal FROM t),
hs AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
u AS (SELECT hs.source, h, words, sum(words) OVER (PARTITION BY hs.source ORDER BY h) AS upto FROM hs),
x AS (SELECT u.source, min(struct_pack(h := u.h, upto := u.upto, below := u.upto - u.words)) AS c
      FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source WHERE u.upto > g.goal GROUP BY u.source),
cut AS (SELECT g.*, CASE WHEN x.c IS NULL THEN 68719476736
                         WHEN x.c.upto - g.goal <= g.goal - x.c.below THEN x.c.h + 1 ELSE x.c.h END AS cut
        FROM g LEFT JOIN x ON g.source IS NOT DISTINCT FROM x.source)
SELECT d.doc_id, d.size, cut.source_size, cut.target,
       (CASE WHEN d.size = 0 THEN 0 ELSE d.size * (cut.twice::INT + (d.h < cut.cut)::INT) END)::BIGINT AS taken
FROM d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""

OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, hash(text) AS tk, g.i - 1 AS line, g.s AS s
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(parts) AS s, generate_subscripts(parts, 1) AS i) g
  WHERE g.s <> ''
), w AS (
  SELECT doc_id, tk, line, s || chr(10) || lead(s, 1) OVER o || chr(10) || lead(s, 2) OVER o AS win,
         [line, lead(line, 1) OVER o, lead(line, 2) OVER o] AS places
  FROM l WINDOW o AS (PARTITION BY doc_id, tk ORDER BY line)
), f AS (SELECT win, min(struct_pack(a := doc_id, b := line)) AS first FROM w WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT w.doc_id, unnest(w.places) AS line FROM w JOIN f USING (win) WHERE struct_pack(a := w.doc_id, b := w.line) > f.first),
k AS (SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(k.gone), 0)::BIGINT AS n_removed,
       CASE WHEN k.gone IS NULL THEN d.text ELSE
         array_to_string([string_split(d.text, chr(10))[i] FOR i IN range(1, len(string_split(d.text, chr(10))) + 1) IF NOT list_contains(k.gone, i - 1)], chr(10)) END AS text
FROM documents d LEFT JOIN k USING (doc_id)
"""


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    """Every round as a full comparison of all vectors with all centroids."""
    tables = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v FROM v ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds + 1):
        tables.append(
            f"a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, cluster := cluster)) AS m FROM (SELECT v.r, c.cluster, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{n} c) GROUP BY r)"
        )
        if n < rounds:
            tables.append(
                f"""s{n} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT a.m.cluster AS cluster, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM a{n} a JOIN v USING (r)) GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(f.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{n} GROUP BY cluster) f USING (cluster))"""
            )
    return "WITH " + ", ".join(tables) + f""" SELECT v.vec_id, a.m.cluster::INTEGER AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.cluster))::BIGINT AS cluster_inertia,
 (sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.cluster = a.m.cluster"""


def oracle_sql() -> dict[str, str]:
    return {"op7_source_mixing": OP7_SQL, "op10_line_dedup": OP10_SQL, "op13_centroid_clustering": _op13_sql()}
