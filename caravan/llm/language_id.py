"""Operator 7, language ID by multilingual mixture inference.

A document's character trigrams are taken as draws from a mixture of the learned
languages' trigram distributions. Its languages are chosen by penalised
likelihood: starting from the best single language, the language whose addition
raises the log likelihood most is added while the gain is above
``penalty`` * ln(trigrams + 1); proportions come from expectation maximisation
over the chosen set. The prediction is the language with the largest
proportion, the score that proportion.

The log likelihood is concave in the proportions, so the slope from a single
language towards another bounds what adding it can gain: languages whose slope
is below the penalty are left out without running EM, with the same result.

Learning counts the trigrams of every labelled training text in Spark, for the
``LANGUAGES`` labels with most texts (equal numbers: by name); rarer labels are not
learned, so dirty labels cannot make the model grow. It has ``LANGUAGES`` x ``BUCKETS``
numbers at most (67 MB), is the only thing the driver holds, and its size does
not depend on the corpus. A task keeps as much while it counts.

Texts are lower-cased; letters stay, runs of other characters become one space.

Defined results: a null or empty text, or one without a letter, is ``und`` with
score 0; so is every text if no training row has both a text with letters and a
language; a row with a null id is neither held out nor learned from; repeated
rows count as often as they occur; equal likelihoods go to the language that
sorts first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 15
LANGUAGES = 256     # labels that are learned at most
SMOOTHING = 0.5     # added to each bucket's count
PENALTY = 3.0       # times ln(trigrams + 1), for each language beyond the first
EM_ROUNDS = 60
EM_CLOSE = 1e-4     # EM ends when no proportion moves more
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Which code points are letters; kept for the worker's life."""
    kept = sys.__dict__.get("_caravan_letters")
    if kept is None:
        kept = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        sys.__dict__["_caravan_letters"] = kept
    return kept


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of a text in order; empty if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, 32)
    codes = codes[letter | np.concatenate([[True], letter[:-1]])]  # one space for a run
    codes = codes[int(codes[0] == 32):len(codes) - int(codes[-1] == 32)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64)


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(grams) > 4096:
        n = np.bincount(grams, minlength=BUCKETS)
        at = np.flatnonzero(n)
        return at, n[at].astype(np.float64)
    at, n = np.unique(grams, return_counts=True)
    return at, n.astype(np.float64)


# ---------------------------------------------------------------- learning
def _count(batches):
    """Trigram counts of this task's rows, a row per language and bucket met."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            grams = trigrams(text)
            if len(grams):
                at, n = counted(grams)
                sums.setdefault(lang, np.zeros(BUCKETS))[at] += n
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, BUCKETS x languages probabilities) from rows (lang, text)."""
    labelled = labelled.select("lang", "text").where("lang is not null and text is not null")
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(most) > LANGUAGES:
        labelled = labelled.where(F.col("lang").isin([r["lang"] for r in most[:LANGUAGES]]))
    counts = (labelled.mapInArrow(_count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).orderBy("lang").collect()
    table = np.full((BUCKETS, len(rows)), SMOOTHING)
    for k, r in enumerate(rows):
        for x in r["x"]:
            table[x["bucket"], k] += x["n"]
    return [r["lang"] for r in rows], table / table.sum(axis=0) if rows else table


# ---------------------------------------------------------------- inference
def proportions(p: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """EM for the mixture proportions; p: trigrams x chosen languages."""
    pi, total = start, n.sum()
    for _ in range(EM_ROUNDS):
        mix = p @ pi
        new = pi * ((n / mix) @ p) / total
        if np.abs(new - pi).max() < EM_CLOSE:
            return new
        pi = new
    return pi


def infer(p: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> dict[int, float]:
    """language -> proportion; p: distinct trigrams x all languages, n: counts."""
    total = n.sum()
    cost = penalty * np.log(total + 1)
    single = n @ np.log(p)
    best = int(np.argmax(single))
    chosen, pi, value = [best], np.ones(1), single[best]
    while len(chosen) < p.shape[1]:
        slope = (n / (p[:, chosen] @ pi)) @ p - total
        grown = None
        for k in np.flatnonzero(slope > cost):
            if int(k) in chosen:
                continue
            s = [*chosen, int(k)]
            q = proportions(p[:, s], n, np.append(pi * 0.9, 0.1))
            v = n @ np.log(p[:, s] @ q)
            if v > value + cost and (grown is None or v > grown[2]):
                grown = (s, q, v)
        if grown is None:
            break
        chosen, pi, value = grown
    return dict(zip(chosen, pi.tolist(), strict=True))


_NEW = ("lang_pred", "score", "langs")


def _predict(langs: list[str], table: np.ndarray, penalty: float, text_col: str = "text", keep_text: bool = False):
    def run(batches):
        for b in batches:
            pred, score, sets = [], [], []
            for text in b.column(text_col).to_pylist():
                grams = trigrams(text) if langs else ()
                if not len(grams):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    sets.append([])
                    continue
                at, n = counted(grams)
                mix = infer(table[at], n, penalty)
                k = max(mix, key=lambda i: (mix[i], -i))
                pred.append(langs[k])
                score.append(min(1.0, mix[k]))
                sets.append([langs[i] for i in sorted(mix)])
            keep = [i for i, c in enumerate(b.schema.names) if keep_text or c != text_col]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(sets, pa.list_(pa.string()))], names=[*(b.schema.names[i] for i in keep), *_NEW])
    return run


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out, null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def _learn_from(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    return learn(docs.where(fold(id_col) != 1).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             penalty: float = PENALTY) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, langs (the
    chosen set). Learns from the rows that are not held out."""
    langs, table = _learn_from(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(langs, table, penalty), "doc_id long, held_out boolean, lang_pred string, "
                                                            "score double, langs array<string>")


def in_one_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    penalty: float = PENALTY) -> DataFrame:
    """``docs`` without those that have no letter. ``lang_col`` becomes the
    predicted language, also of a text in several languages; the other columns
    stay. If nothing can be learned, ``docs`` as they are."""
    langs, table = _learn_from(docs, id_col, text_col, lang_col)
    if not langs:
        return docs
    # names of its own, so that no column of docs clashes with the new ones
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    at = docs.columns.index(text_col)
    out = rows.mapInArrow(_predict(langs, table, penalty, f"c{at}", keep_text=True),
                          f"{kind}, lang_pred string, score double, langs array<string>")
    out = out.where(F.size("langs") > 0)
    return out.select(*[F.col("lang_pred" if c == lang_col else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
