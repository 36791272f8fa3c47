"""Operator 8, mixing sources to target weights (DataFrame functions only).

Tokens (words) are summed per source; the sum of all is shared out by weight,
no source above ``max_rate`` times its own tokens; each source's repetition
rate is target / tokens; each document is emitted floor(rate) times plus one
copy more with probability equal to the fraction, drawn from a hash of the seed
and its id, so reruns agree and lost tasks recompute the same copies.

Defined results: a null text has size 0; null sources form one source, last in
order; a source without tokens has target 0 and rate 0 (its documents have
size 0); rows that repeat an id share its draw; a null id draws as the text
``null``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravan.llm.common import WORD, numbered, scratch_table, starts, text_or_empty

SEED = "mix-1"


def n_words(col: str) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def draw(id_col: str, seed: str = SEED) -> Column:
    """Uniform in [0, 1): the first 52 bits of md5(seed:id)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, max_rate: int, weights: int) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh 1 .. ``weights`` in turn. The
    target is min(max_rate * source_size, level * weight); the level rises as
    the excess of capped sources is shared again, until no source is above."""
    spark = sizes.sparkSession
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(by.select(F.col("source").isNull().alias("last"), "source", "source_size"),
                      ["last", "source"], "mix-sources")
    counts = ranked.groupBy("_part").agg(F.count("*").alias("n"))
    place = F.col("before") + F.col("_row")
    src = scratch_table(
        ranked.join(F.broadcast(starts(counts, "_part", {"before": "n"})), "_part").select(
            "source", "source_size", (place % weights + 1).cast("int").alias("weight")), "mix-weights")

    # each round is one aggregate over the sources; only its totals reach the driver
    level, cap = None, F.col("source_size") * max_rate
    while True:
        free = F.lit(True) if level is None else cap > F.lit(level) * F.col("weight")
        r = src.agg(F.sum("source_size").alias("all"), F.sum(F.when(~free, cap)).alias("capped"),
                    F.sum(F.when(free, F.col("weight"))).alias("w")).first()
        new = ((r["all"] or 0) - (r["capped"] or 0)) / r["w"] if r["w"] else (level or 0.0)
        if level is not None and new <= level:
            break
        level = new
    return src.select("source", "source_size",
                      F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def copies(rate: Column, id_col: str, seed: str) -> Column:
    """floor(rate), and one more if the document's draw is below the fraction."""
    return (F.floor(rate) + (draw(id_col, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def source_rates(rows: DataFrame, max_rate: int, weights: int) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return source_targets(rows, max_rate, weights).withColumn("rate", rate)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_rate: int = 3, weights: int = 3, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and
    ``copies``, the number of times the mix takes it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       n_words(text_col).alias("size"))
    # read again for every document below: kept as a narrow table, texts are counted once
    rows = scratch_table(rows, "mix-sizes")
    rates = source_rates(rows, max_rate, weights)
    joined = rows.alias("d").join(rates.alias("t"), F.expr("d.source <=> t.source")).select(
        "d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "t.rate")
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         copies(F.col("rate"), "doc_id", seed).alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    max_rate: int = 3, weights: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as ``mix`` takes it,
    with the columns of ``docs``. Texts meet only the table of sources."""
    sizes = docs.select(F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    rates = source_rates(sizes, max_rate, weights).select("source", "rate")
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("key"), F.col(source_col).alias("of"))
    taken = d.join(rates, F.expr("of <=> source")).select("row", copies(F.col("rate"), "key", seed).alias("n"))
    out = taken.where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("row.*")
