"""Leaves of large threads that fit a small thread of their session clearly better."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import text
from sessionloom.operators.online import WEIGHTS
from sessionloom.operators.segments import top_ranked
from sessionloom.operators.threads import ROOT, SESSION

SMALL_THREAD = 12
MARGIN = 0.35
MIN_SIMILARITY = 0.33
BLOCK = 64
SCORED = T.ArrayType(T.StructType([T.StructField("root", T.StringType()), T.StructField("score", T.DoubleType())]))


def root_profiles(threads: DataFrame) -> DataFrame:
    """Comparison text and item sets of finished threads."""
    names = ["label", "objective", "deliverable", "success_criteria", "summary", "last_update"]
    lists = [("anchor", ", "), ("apps_used", ", "), ("entities", ", "), ("sample_leaf_objectives", " | ")]
    value = lambda n: text.or_empty(F.col(n)) if n in threads.columns else F.lit("")
    items = lambda n: F.col(n) if n in threads.columns else F.array().cast("array<string>")
    lines = [F.concat(F.lit(f"{n}: "), value(n)) for n in names] + [F.concat(F.lit(f"{n}: "), F.array_join(items(n), sep)) for n, sep in lists]
    norms = lambda n: F.array_distinct(F.filter(F.transform(items(n), text.normalize), lambda x: x != ""))
    return threads.select(
        SESSION, ROOT, "leaf_count", text.normalize(F.concat_ws("\n", *lines)).alias("text"),
        norms("apps_used").alias("apps"), norms("entities").alias("items"), norms("anchor").alias("anchors"),
    )


def _histogram(value: str) -> np.ndarray:
    """Character counts in 128 bins; comparing bins can only overstate how much two texts share."""
    return np.bincount(np.frombuffer(value.encode("utf-32-le"), dtype=np.uint32) % 128, minlength=128)


@F.pandas_udf(SCORED)
def _best_two(leaf: pd.DataFrame, threads: pd.Series) -> pd.Series:
    """Two best threads of a block for each leaf that pass the margin; an upper bound spares most comparisons."""
    from difflib import SequenceMatcher

    out, known = [], {}
    for row, block in zip(leaf.itertuples(index=False), threads):
        for t in block:
            if t["root"] not in known or known[t["root"]][0] != t["text"]:
                known[t["root"]] = (t["text"], _histogram(t["text"]), set(t["apps"]), set(t["items"]), set(t["anchors"]))
        packed = [known[t["root"]] for t in block]
        shared = np.array([[len(s & set(mine)) for s, mine in zip(p[2:], (row.apps, row.items, row.anchors))] for p in packed])
        base = shared @ np.array([WEIGHTS["apps"], WEIGHTS["entities"], WEIGHTS["anchors"]])
        common = np.minimum(np.stack([p[1] for p in packed]), _histogram(row.profile)).sum(axis=1)
        lengths = np.array([len(p[0]) for p in packed]) + len(row.profile)
        floor, found = row.current_score + MARGIN, []
        for i in np.flatnonzero(WEIGHTS["similarity"] * 2 * common / np.maximum(lengths, 1) + base >= floor - 1e-9):
            root = block[i]["root"]
            if root == row.current_root:
                continue
            alike = 1.0 if row.profile == packed[i][0] else SequenceMatcher(None, row.profile, packed[i][0]).ratio()
            score = WEIGHTS["similarity"] * alike + base[i]
            if score >= floor and (alike >= MIN_SIMILARITY or shared[i].any()):
                found.append((root, float(score)))
        out.append([{"root": r, "score": s} for r, s in sorted(found, key=lambda f: (-f[1], f[0]))[:2]])
        if len(known) > 4096:
            known.clear()
    return pd.Series(out)


def _score(similarity: Column, shared: list[Column]) -> Column:
    weights = [WEIGHTS["apps"], WEIGHTS["entities"], WEIGHTS["anchors"]]
    total = F.lit(WEIGHTS["similarity"]) * similarity
    for weight, count in zip(weights, shared):
        total = total + F.lit(weight) * count
    return total


def candidates(
    prepared: DataFrame, assigned: DataFrame, profiles: DataFrame, per_session: int = 20, small_thread: int = SMALL_THREAD
) -> DataFrame:
    """Up to two better threads for a leaf, first ``per_session`` such leaves of a session (the report's size).

    prepared: leaf columns of ``online.prepare``.  Small threads travel in blocks of 64, so a leaf meets
    blocks and not single threads, and at most two results leave each meeting.
    """
    names = {"app_norms": "apps", "entity_norms": "items", "anchor_norms": "anchors"}
    leaves = prepared.select(SESSION, "leaf_idx", "profile", *[F.col(a).alias(b) for a, b in names.items()])
    owner = profiles.select(SESSION, ROOT, "leaf_count", "text", *[F.col(c).alias(f"_{c}") for c in ("apps", "items", "anchors")])
    large = leaves.join(assigned.select(SESSION, "leaf_idx", ROOT), [SESSION, "leaf_idx"]).join(owner.where(F.col("leaf_count") > small_thread), [SESSION, ROOT])
    shared = [F.size(F.array_intersect(c, f"_{c}")) for c in ("apps", "items", "anchors")]
    large = large.withColumn("current_score", _score(text.text_similarity(F.col("profile"), F.col("text")), shared))
    small = profiles.where(F.col("leaf_count") <= small_thread)
    block = F.pmod(F.xxhash64(ROOT), F.ceil(F.col("_n") / BLOCK))
    sized = small.join(small.groupBy(SESSION).agg(F.count(F.lit(1)).alias("_n")), SESSION).withColumn("_block", block)
    blocks = sized.groupBy(SESSION, "_block").agg(F.collect_list(F.struct(F.col(ROOT).alias("root"), "text", "apps", "items", "anchors")).alias("_threads"))
    met = large.join(blocks, SESSION)
    leaf = F.struct("profile", "apps", "items", "anchors", "current_score", F.col(ROOT).alias("current_root"))
    scored = met.select(SESSION, "leaf_idx", F.col(ROOT).alias("current_root_id"), F.explode(_best_two(leaf, F.col("_threads"))).alias("_s"))
    best = top_ranked(scored.select(SESSION, "leaf_idx", "current_root_id", "_s.*"), [SESSION, "leaf_idx"], [F.col("score").desc(), F.col("root")], 2)
    packed = best.groupBy(SESSION, "leaf_idx", "current_root_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "root"))), lambda p: p["root"]).alias("alternatives")
    )
    return top_ranked(packed, [SESSION], [F.col("leaf_idx")], per_session)
