"""Queries p1, p7, p8 and p9 over the tables, and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import bounded_broadcast, table
from graphloom.llm.leak import leaks
from graphloom.llm.mixing import Mixture
from graphloom.llm.spam import page_scores, spam_pages
from graphloom.llm.spans import shared_spans
from graphloom.operators.snapshots import newest_runs


def _formulas(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "files").select("file_id", "run_id").join(newest_runs(table(s, d, "ddr_run")), "run_id").select("file_id").distinct()
    rows = table(s, d, "entities").where("calc_text is not null").select("file_id", F.col("entity_id").alias("id"), F.col("calc_text").alias("text"))
    return rows.join(bounded_broadcast(files), "file_id").select("id", "text")


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return shared_spans(_formulas(s, d)).select(F.col("id").alias("entity_id"), "shared_chars")


def p1_shares(s: SparkSession, d: str) -> DataFrame:
    return shared_spans(_formulas(s, d)).select(F.col("id").alias("entity_id"), "shared_chars", "n_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("share"))


def _leaks(s: SparkSession, d: str) -> DataFrame:
    docs, items = table(s, d, "documents"), table(s, d, "eval_items")
    return leaks(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("id"), "text"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return _leaks(s, d).select("item_id", "doc_id")


def p7_items(s: SparkSession, d: str) -> DataFrame:
    return _leaks(s, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_windows").alias("most_windows"))


def _mixture(s: SparkSession, d: str) -> Mixture:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return Mixture(docs, table(s, d, "mix_targets"))


def p8_mixture(s: SparkSession, d: str) -> DataFrame:
    return _mixture(s, d).drawn


def p8_shares(s: SparkSession, d: str) -> DataFrame:
    return _mixture(s, d).shares


def p8_kept(s: SparkSession, d: str) -> DataFrame:
    return _mixture(s, d).kept


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_labels").withColumnRenamed("doc_id", "id")


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return spam_pages(_pages(s, d), _labels(s, d)).withColumnRenamed("id", "doc_id")


def p9_scores(s: SparkSession, d: str) -> DataFrame:
    return page_scores(_pages(s, d), _labels(s, d)).select(F.col("id").alias("doc_id"), "n_chars", "stuffed_chars", F.round("bits", 6).alias("bits"))


QUERIES = {f.__name__: f for f in (p1_found, p1_shares, p7_found, p7_items, p8_mixture, p8_shares, p8_kept, p9_found, p9_scores)}

_P1 = """
with runs as (select distinct run_id, source_path, parsed_at from ddr_run),
newest as (select run_id from runs qualify row_number() over (partition by source_path order by parsed_at desc, run_id desc) = 1),
t as (select distinct entity_id, calc_text from entities join files using (file_id) join newest using (run_id) where length(calc_text) >= 80),
g as (select entity_id, i, substring(calc_text, i, 80) s from (select entity_id, calc_text, unnest(range(1, length(calc_text) - 78)) i from t)),
shared as (select s from g group by s having min(entity_id) <> max(entity_id)),
hit as (select entity_id, i, lead(i) over (partition by entity_id order by i) nxt from g join shared using (s)),
found as (select entity_id, cast(sum(least(80, coalesce(nxt - i, 80))) as bigint) shared_chars from hit group by 1)
"""
_P7 = r"""
with d as (select distinct doc_id id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
e as (select distinct item_id id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_items where text is not null),
dg as (select distinct id, array_to_string(w[i:i + 12], ' ') s from (select id, w, unnest(range(1, len(w) - 11)) i from d)),
eg as (select distinct id, array_to_string(w[i:i + 12], ' ') s from (select id, w, unnest(range(1, len(w) - 11)) i from e)),
found as (select eg.id item_id, dg.id doc_id, count(*) n_windows from eg join dg using (s) group by 1, 2)
"""
SQL = {
    "p8_kept": "select lower(trim(source)) source, max(max_repeats) max_repeats, 1 within_largest, 1 repeats_kept from mix_targets where source is not null group by 1",
    "p1_found": _P1 + "select entity_id, shared_chars from found",
    "p1_shares": _P1 + "select entity_id, shared_chars, length(calc_text) n_chars, round(shared_chars / length(calc_text), 6) share from found join t using (entity_id)",
    "p7_found": _P7 + "select item_id, doc_id from found",
    "p7_items": _P7 + "select item_id, count(*) n_docs, max(n_windows) most_windows from found group by 1",
}
