"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (orders 3 to 5) of the lower-cased whole text, hashed to `2**BITS` buckets. For each bucket the log
ratio of its smoothed document shares in toxic and clean training texts scales the feature; a logistic regression is fitted on the
scaled features, then shifted to the label's share. Training reads a bounded sample of labelled rows: `per_class` of each label, those of
smallest id hash, never a held-out row. Only a document's text enters its score.

Defined results: null text counts as empty and gets the score of a text without n-grams; a null id is held out by the empty string's
checksum; several labels of one id count as toxic if one is; null labels are ignored; with fewer than two kinds of labels every score is the share of
toxic labels (0 without labels); every input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.words import mix
from sessionloom.session import cut_lineage

BITS = 20
ORDERS = (3, 4, 5)
_STEP = 500_000
_ODD = np.uint64(0xD6E8FEB86659FD93)


def buckets(text: str) -> np.ndarray:
    """Sorted distinct buckets of a text's character n-grams."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = np.zeros(1 << BITS, bool) if len(points) > 60_000 else None
    found = []
    for a in range(0, max(1, len(points)), _STEP):
        part = points[a : a + _STEP + max(ORDERS) - 1].astype(np.uint64)
        key = mix(part + np.uint64(1))
        for order in range(2, max(ORDERS) + 1):
            n = len(part) - order + 1
            if n <= 0:
                break
            key = (key[:n] + part[order - 1 :]) * _ODD
            if order in ORDERS:
                # The upper bits of a product depend on all characters.
                code = (key ^ (key >> np.uint64(29))) * _ODD >> np.uint64(64 - BITS)
                if mark is not None:
                    mark[code] = True
                else:
                    found.append(code.astype(np.int32))
    if mark is not None:
        return np.flatnonzero(mark).astype(np.int32)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    shift: float

    def score(self, text: str | None) -> float:
        x = float(self.weights[buckets(text or "")].sum(dtype=np.float64)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def held_out(doc_id: Column | str) -> Column:
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """toxic and text of at most `per_class` documents of each label, none held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id"))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class ids.
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.join(ids, "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))


def _features(keep: np.ndarray | None):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [buckets(t) for t in batch["text"]]
            if keep is not None:
                found = [x[keep[x]] for x in found]
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "features": found})

    return rows


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            seen[toxic][buckets(text)] += 1
    at = np.flatnonzero(seen.sum(axis=0))
    yield pd.DataFrame({"bucket": at, "clean": seen[0][at], "toxic": seen[1][at]})


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3_000, least_ratio: float = 2.0, least_docs: int = 8, rounds: int = 60, ridge: float = 2e-3,
          doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a sample of at most `2 * per_class` labelled rows; `least_ratio` and `least_docs` leave out features that tell nothing."""
    sample = cut_lineage(training_rows(docs, labels, per_class, doc_id, text))
    counts = sample.mapInPandas(_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.where(F.col("clean") + F.col("toxic") >= least_docs).toPandas()
    sizes = {int(r["toxic"]): int(r["n"]) for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(1 << BITS)
    if len(sizes) < 2:
        share = 1.0 if sizes.get(1) else 0.0
        return Model(weights, 500.0 if share else -500.0)
    ratio = np.log((counts["toxic"].to_numpy() + 1.0) / (sizes[1] + 2.0)) - np.log((counts["clean"].to_numpy() + 1.0) / (sizes[0] + 2.0))
    scale = np.zeros(1 << BITS)
    scale[counts["bucket"].to_numpy()] = np.where(np.abs(ratio) >= least_ratio, ratio, 0.0)
    rows = sample.mapInPandas(_features(scale != 0), "id long, toxic int, features array<int>").toArrow().sort_by("id")
    label = rows["toxic"].to_numpy().astype(float)
    lengths = rows["features"].combine_chunks().value_lengths().to_numpy()
    used = rows["features"].combine_chunks().flatten().to_numpy()
    columns, used = np.unique(used, return_inverse=True)
    scale_used = scale[columns]
    row = np.repeat(np.arange(len(label)), lengths)
    beta, shift = np.zeros(len(columns)), 0.0
    memory, memory_shift = np.full(len(columns), 1e-8), 1e-8
    balance = np.where(label == 1, 0.5 / sizes[1], 0.5 / sizes[0])
    for _ in range(rounds):
        margin = np.bincount(row, (beta * scale_used)[used], len(label)) + shift
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label) * balance
        slope = np.bincount(used, error[row], len(columns)) * scale_used + ridge * beta / max(1, len(columns))
        memory += slope**2
        memory_shift += error.sum() ** 2
        beta -= 0.1 * slope / np.sqrt(memory)
        shift -= 0.1 * error.sum() / np.sqrt(memory_shift)
    weights[columns] = beta * scale_used
    # The sample holds both labels alike; the documents don't.
    learned = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = learned.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"]
    return Model(weights.astype(np.float32), shift + float(np.log(known / (1 - known))) if 0 < known < 1 else shift)


def scorer(spark: SparkSession, model: Model):
    """Column function text -> score. The model has 2**BITS weights, whatever the data."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([held.value.score(t) for t in texts], dtype=float)

    return lambda text: scored(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    own = docs.select("doc_id", "text")
    score = scorer(docs.sparkSession, train(own, labels, per_class))
    scored = own.select("doc_id", held_out("doc_id").alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
