"""Nearest neighbours by largest inner product with an inverted multi-index.

The two halves of a vector are quantised separately with `centroids` centroids each, so `centroids`**2 cells come from two small codebooks.
A query's score for a cell is the sum of its inner products with both centroids; pairs are visited from the best sum down with a heap
over the two sorted lists (the multi-sequence walk) until the visited cells hold `share` of all vectors, `least` at least. The vectors of those cells are
then ranked by the exact inner product in double precision.

Equal vectors collapse first: only the `k` + 1 smallest ids of a vector can be in an answer, and equal queries are searched once. Codebooks are
fitted on a bounded sample (`sample` distinct vectors of smallest hash); every vector is indexed. The cell directory has
`centroids`**2 numbers. Ranking runs in groups of (first centroid, block of vectors, block of queries) whose size `block` bounds, so a crowded
centroid is many groups. Per group and query at most k + 1 rows leave.

`share` trades work for recall; vectors without neighbourhoods (random directions) need a large one. See the README for
the measured recall.

Defined results: vectors that are null, empty, zero, or hold a null, NaN or infinite component take no part, nor do those of another
dimension than the most frequent one (the smaller of equals), nor rows with a null id; rows with the same id and vector are one; rows
of one id with different vectors are several candidates under that id; ties go to the smaller id; fewer than k candidates are all returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.session import cut_lineage


def codebook(points: np.ndarray, centroids: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from evenly spread rows of the sample."""
    order = np.lexsort(points.T[::-1])
    centers = points[order[np.linspace(0, len(points) - 1, min(centroids, len(points))).astype(int)]].copy()
    for _ in range(rounds):
        near = nearest(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        count = np.bincount(near, minlength=len(centers))
        held = count > 0
        centers[held] = sums[held] / count[held, None]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centers.T - 0.5 * (centers**2).sum(axis=1), axis=1)


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells from the largest summed score down until they hold `wanted` vectors; empty cells are passed over."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    x, y = left[a].tolist(), right[b].tolist()
    size = counts[a][:, b].tolist()
    heap, seen, found, out = [(-(x[0] + y[0]), 0, 0)], [0] * len(a), 0, []
    pop, push = heapq.heappop, heapq.heappush
    seen[0] = 1
    while heap and found < wanted:
        _, i, j = pop(heap)
        if size[i][j]:
            out.append((int(a[i]), int(b[j])))
            found += size[i][j]
        # seen[i]: how many columns of row i have been pushed; a cell follows its left and upper neighbours.
        if j + 1 < len(b) and seen[i] == j + 1 and (i == 0 or seen[i - 1] > j + 1):
            push(heap, (-(x[i] + y[j + 1]), i, j + 1))
            seen[i] = j + 2
        if i + 1 < len(a) and seen[i + 1] == j and seen[i] > j:
            push(heap, (-(x[i + 1] + y[j]), i + 1, j))
            seen[i + 1] = j + 1
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """key (hash pair of the vector), id and vector of the rows that take part."""
    vector = F.col(embedding).cast("array<double>")
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), vector.alias("vector")).where("id is not null and size(vector) > 0")
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    own = own.where(F.coalesce(fine, F.lit(False)))
    sizes = own.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).first()
    if sizes is None:
        return own.select(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("key"), "id", "vector")
    # Adding zero turns -0.0 into 0.0, so equal vectors have equal keys.
    own = own.where(F.size("vector") == sizes["n"]).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    return own.select(F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")).alias("key"), "id", "vector")


def search(
    vectors: DataFrame, queries: Column, k: int = 20, centroids: int = 64, share: float = 0.45, least: int = 2_000, sample: int = 10_000, block: int = 4_096,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row for which `queries` (over the column id) holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    own = cut_lineage(usable(vectors, vec_id, embedding).dropDuplicates(["key", "id"]))
    few = cut_lineage(
        own.select("key", "id").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    )
    distinct = cut_lineage(own.join(few.where("n = 1").select("key", "id"), ["key", "id"]).select(F.col("id").alias("rep"), "key", "vector"))
    asked = own.where(queries).select("key", F.col("id").alias("query_id"))
    asking = distinct.join(asked.select("key").distinct(), "key", "left_semi")
    # Only ids are ordered; at most `sample` of them are sent back to the vectors.
    chosen = F.broadcast(distinct.select("rep", F.xxhash64("key").alias("order")).orderBy("order", "rep").limit(sample).select("rep"))
    drawn = distinct.join(chosen, "rep").toPandas()
    if not len(drawn):
        return spark.createDataFrame([], schema)
    points = np.array(drawn["vector"].tolist(), float)
    half = points.shape[1] // 2
    halves = (slice(0, half), slice(half, None))
    books = spark.sparkContext.broadcast([codebook(points[:, h], centroids) for h in halves])

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array(batch["vector"].tolist(), float)
                first, second = (nearest(x[:, h], c) for h, c in zip(halves, books.value, strict=True))
                yield batch.assign(first=first, second=second)

    index = cut_lineage(distinct.select("rep", "vector").mapInPandas(coded, "rep long, vector array<double>, first int, second int"))
    directory = index.groupBy("first", "second").agg(F.count("*").alias("n")).collect()  # at most centroids ** 2
    counts = np.zeros([len(b) for b in books.value], np.int64)
    for r in directory:
        counts[r["first"], r["second"]] = r["n"]
    total = int(counts.sum())
    n_queries = asking.count()
    parts, turns = np.maximum(1, -(-counts.sum(axis=1) // block)), max(1, -(-n_queries // block))
    plan = spark.sparkContext.broadcast((counts, max(least, k + 1, int(share * total)), parts))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, wanted, parts = plan.value
        for batch in batches:
            out = []
            for rep, vector in zip(batch["rep"], batch["vector"], strict=True):
                x = np.asarray(vector, float)
                cells: dict[int, list[int]] = {}
                for i, j in walk(*(c @ x[h] for h, c in zip(halves, books.value, strict=True)), counts, wanted):
                    cells.setdefault(i, []).append(j)
                out += [(rep, vector, i, part, js) for i, js in cells.items() for part in range(parts[i])]
            yield pd.DataFrame(out, columns=["rep", "vector", "first", "part", "seconds"])

    visits = asking.select("rep", "vector").repartition(F.col("rep")).mapInPandas(walked, "rep long, vector array<double>, first int, part int, seconds array<int>")
    visits = visits.withColumn("turn", F.pmod(F.xxhash64("rep"), F.lit(turns)).cast("int"))
    cuts = F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("first") + 1)
    held = index.withColumn("part", F.pmod(F.xxhash64("rep"), cuts).cast("int")).withColumn("turn", F.explode(F.array(*(F.lit(i) for i in range(turns)))))

    def ranked(candidates: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "rep", "score"]
        if not len(candidates) or not len(visits):
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        candidates = candidates.sort_values("rep")
        x, ids, second = np.array(candidates["vector"].tolist(), float), candidates["rep"].to_numpy(), candidates["second"].to_numpy()
        out = []
        for a in range(0, len(visits), 256):
            part = visits.iloc[a : a + 256]
            scores = np.array(part["vector"].tolist(), float) @ x.T
            for query, own, seconds in zip(part["rep"], scores, part["seconds"], strict=True):
                at = np.flatnonzero(np.isin(second, seconds))
                # Candidates are in id order, and a stable sort keeps it among ties.
                best = at[np.argsort(-own[at], kind="stable")[: k + 1]]
                out.append(pd.DataFrame({"query": query, "rep": ids[best], "score": own[best]}))
        return pd.concat(out, ignore_index=True)

    keys = ["first", "part", "turn"]
    near = held.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(ranked, "query long, rep long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    # From distinct vectors back to rows: first their few ids, then every row that asked.
    named = few.join(distinct.select("key", "rep"), "key")
    rows = near.join(named.select("rep", F.col("id").alias("vec_id")), "rep")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    asked = asked.join(distinct.select("key", F.col("rep").alias("query")), "key").select("query", "query_id")
    # One list of at most k + 1 answers for each distinct query, so a vector asked by many rows meets them in one row.
    lists = rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("answers"))
    met = asked.join(lists, "query")
    others = F.slice(F.filter("answers", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return met.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"
    )
