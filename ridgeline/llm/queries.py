"""One thin query for each text operator, with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import decontaminate, licences, media, ngram_join, packing, pages, quality, substring_dedup, tokens, toxicity
from ridgeline.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.media_table(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(read(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read(spark, sf_dir, "documents"), percent=75, k=5)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(read(spark, sf_dir, "documents")).drop("version")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (
        op1_media_columns,
        op2_quality_classifier,
        op3_benchmark_decontamination,
        op4_token_counts,
        op5_html_extraction,
        op6_ngram_jaccard_join,
        op7_licence_scan,
        op8_toxicity,
        op9_substring_dedup,
        op10_best_fit_packing,
    )
    return {f.__name__: f for f in every}


#: The join by counting shared shingles of all pairs: right, and quick enough for small tables.
_JACCARD_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
comp(u, r) USING KEY (u) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT l.b, min(comp.r) FROM comp JOIN l ON l.a = comp.u JOIN recurring.comp cur ON cur.u = l.b WHERE comp.r < cur.r GROUP BY l.b
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, comp.r AS component_id FROM n JOIN comp ON comp.u = n.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_jaccard_join": _JACCARD_SQL}
