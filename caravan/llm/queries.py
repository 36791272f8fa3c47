"""Registered queries: each dealt operator over its whole table, reduced to the
digest columns of its result. ``QUERIES[name] = (function, oracle text or None)``;
None where SQL cannot express the operator (``tests/llm`` then holds it against
a brute-force version)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.llm import (exact_dedup, hard_negatives, html_extract, jaccard_join, language_id, line_dedup, mixing,
                         packing, periodic_runs, secret_scan, sharding, sql, token_output, topk)
from caravan.llm.common import read, scratch_path, text_or_empty


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines (host: source)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate_lines(docs, F.col("source"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 contiguous shards of near-equal bytes (law ``bytes``)."""
    out = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.main_texts(read(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    out = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.withColumnRenamed("digest", "text_sha256")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a Jaccard similarity of 0.9 or more on
    three-word shingles."""
    out = jaccard_join.similar_components(read(spark, sf_dir, "documents"), width=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    return language_id.identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources to weights 1, 2, 3."""
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written bit-packed and read back."""
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(read(spark, sf_dir, "documents"), path)
    return token_output.read_tokens(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector's first 5 positives; every 7th
    vector has its label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"), every=100, label=moved)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document: base patterns and inferred formats."""
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some made periodic by their id."""
    docs = read(spark, sf_dir, "documents")
    listed = periodic_runs.with_periods(text_or_empty("text"), F.col("doc_id"))
    found = periodic_runs.periodic_runs(docs, word_list=listed).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in (
        "start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_line_dedup": (op1_line_dedup, sql.LINE_DEDUP),
    "op2_sharding": (op2_sharding, None),
    "op3_topk": (op3_topk, sql.TOP_K),
    "op4_html_extract": (op4_html_extract, None),
    "op5_exact_dedup": (op5_exact_dedup, sql.EXACT_DEDUP),
    "op6_jaccard_join": (op6_jaccard_join, sql.JACCARD_JOIN),
    "op7_language_id": (op7_language_id, None),
    "op8_mixing": (op8_mixing, sql.MIXING),
    "op9_packing": (op9_packing, None),
    "op10_token_output": (op10_token_output, None),
    "op11_hard_negatives": (op11_hard_negatives, sql.HARD_NEGATIVES),
    "op12_secret_scan": (op12_secret_scan, None),
    "op13_periodic_runs": (op13_periodic_runs, sql.PERIODIC_RUNS),
}


def queries() -> dict:
    return {k: fn for k, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for k, (_, text) in QUERIES.items() if text is not None}
