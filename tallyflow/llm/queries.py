"""The queries opN_<name> over the documents table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import byte_bpe, decontaminate, exact_dedup, licenses, line_dedup, pii, pitman_yor, quality, simhash, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == pii.KINDS.index(kind))).cast("long")

    digest = F.sha2(pii.listed(F.col("base")).cast("binary"), 256)
    both = pii.listed(F.sort_array(F.concat("base", "added")))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE_KINDS], digest.alias("base_sha256"), both.alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir)).drop("lines")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_documents(spark, sf_dir), digest=True)
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pitman_yor.score_documents(_documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op8_line_dedup": f"""
        WITH l AS (SELECT doc_id, i, ls[i] AS line, {_LOWER.format("trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
                   FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
                         FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
             f AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
             d AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.top AS gone FROM l LEFT JOIN f USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
