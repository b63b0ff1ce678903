"""Queries that apply the operators to the stock tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.llm import chat, decontaminate, html_extract, licenses, line_dedup, lm_score, ngram_join, oracle, packing, quality, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# A dated block list for the stock query: (domain, list, action, day).
LIST_ENTRIES = [
    ("cheap-pills.example.com", "pharma", "add", "2024-02-01"),
    ("cheap-pills.example.com", "pharma", "remove", "2024-05-15"),
    ("cheap-pills.example.com", "pharma", "add", "2024-08-01"),
    ("free-bets.example.com", "gambling", "add", "2023-11-20"),
    ("m.free-bets.example.com", "mobile", "add", "2024-03-10"),
    ("m.free-bets.example.com", "mobile", "remove", "2024-09-30"),
    ("spam-farm.example.org", "spam", "add", "2024-06-01"),
    ("spam-farm.example.org", "spam", "remove", "2024-06-01"),
    ("tionsh.example.net", "review", "add", "2024-04-01"),
    ("tionsh.example.net", "review", "remove", "2024-04-21"),
    ("tionsh.example.net", "review", "add", "2024-10-01"),
    ("example.org", "outage", "add", "2024-12-01"),
    ("example.org", "outage", "remove", "2024-12-11"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as if fetched on a day of 2024 that its id gives."""
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(pmod(page_id * 37, 366) as int))").alias("fetched"))
    values = ", ".join(f"('{d}', '{n}', '{a}', DATE'{day}')" for d, n, a, day in LIST_ENTRIES)
    entries = spark.sql(f"SELECT * FROM VALUES {values} AS t(domain, list_name, action, dated)")
    return url_filter.judge_captures(captures, entries).withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


OP10_SQL = f"""
WITH entry(domain, list_name, action, dated) AS (VALUES {", ".join(f"('{d}', '{n}', '{a}', DATE '{day}')" for d, n, a, day in LIST_ENTRIES)}),
daily AS (SELECT domain, list_name, dated, bool_or(action = 'add') AS adds FROM entry GROUP BY domain, list_name, dated),
spans AS (SELECT *, lead(dated) OVER (PARTITION BY domain, list_name ORDER BY dated) AS until FROM daily),
capture AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched,
    nullif(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') AS host
  FROM pages),
met AS (
  SELECT c.page_id, s.domain, s.list_name, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC, s.list_name) AS place
  FROM capture c JOIN spans s ON s.adds AND (c.host = s.domain OR c.host LIKE '%.' || s.domain)
    AND c.fetched >= s.dated AND (s.until IS NULL OR c.fetched < s.until))
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, c.host, m.domain IS NOT NULL AS blocked, m.domain AS matched_domain, m.list_name AS matched_list
FROM capture c LEFT JOIN met m ON c.page_id = m.page_id AND m.place = 1
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op4_quality_rules": op4_quality_rules,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op5_license_scans": op5_license_scans,
    "op6_html_extraction": op6_html_extraction,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_url_filters": op10_url_filters,
}

SQL: dict[str, str] = {
    "op1_line_dedup": oracle.OP1,
    "op3_ngram_jaccard_join": oracle.OP3,
    "op9_benchmark_decontamination": oracle.OP9,
    "op10_url_filters": OP10_SQL,
}
