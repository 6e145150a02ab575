"""Vector codes by exact integer product quantisation (limb-split GEMM).

Every component x becomes floor(`scale` * x); a vector is cut into `parts` equal consecutive parts, and each part is replaced by the index of
the nearest of `entries` codebook entries of its position. Squared distances come from |x|^2 - 2 x.c + |c|^2, whose products are taken by
`integers.products`: limbs narrow enough for exact float64 BLAS, put together as integers. So the first of equally near entries is chosen by
equality of integers, in every task and run alike, and the codebooks don't depend on how rows are dealt.

One pass a round: each task adds up its rows by (part, entry), the sums meet in a grouped sum, and parts * entries * width numbers come
back, whatever the table holds. Rows are read from a written table. Errors by label are one grouped sum, joined back by broadcast while there are
at most `few_labels` labels, else by (label, salt), so that a frequent label is many tasks.

Defined results: vectors that are null, empty or hold a null or non-finite component are dropped, and so are those of another length than
the most frequent one (the smaller of equals); a length that isn't a multiple of `parts` is filled with zeros at the end. Every other row stays,
repeated rows and null ids too; the first codebook takes rows by id, nulls last, then vector, and has fewer entries if there are fewer rows. Components
beyond a long are moved to its border, and errors that don't fit a long become the largest one. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import integers
from sessionloom.session import cut_lineage

_MOST = 2**63 - 1


@dataclass(frozen=True)
class Compressed:
    """rows: vec_id, label, code, error; codebooks: for each part a matrix of entries."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and place."""
        return sha256(",".join(str(int(v)) for book in self.codebooks for v in book.flat).encode()).hexdigest()


def _whole(rows: list[list[int]]) -> np.ndarray:
    """Integers as longs if sums of their squares fit, else as Python integers."""
    wide = any(abs(v) >= 1 << 62 for row in rows for v in row)
    return np.array(rows, object if wide else np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower of equals, and the squared distance to it."""
    dots = integers.products(x, book)
    if dots.dtype == object or max(integers.largest(x), integers.largest(book)) ** 2 * x.shape[1] >= 1 << 60:
        x, book, dots = x.astype(object), book.astype(object), dots.astype(object)
    cost = (book * book).sum(axis=1)[None, :] - 2 * dots
    code = np.argmin(cost, axis=1)
    return code, (x * x).sum(axis=1) + cost[np.arange(len(x)), code]


def totals(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """Sum of the rows of each code: a product with the 0/1 matrix of the codes."""
    return integers.products((code[None, :] == np.arange(entries)[:, None]).astype(np.int64), np.ascontiguousarray(x.T))


def _cut(batch: pa.RecordBatch, parts: int, width: int) -> list[np.ndarray]:
    x = integers.matrix(batch.column("q"))
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1])))
    return [np.ascontiguousarray(x[:, p * width : (p + 1) * width]) for p in range(parts)]


def _moved(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks after one round: floored means, entries without parts as they were."""
    parts = len(books)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            if batch.num_rows:
                for p, x in enumerate(_cut(batch, parts, width)):
                    code, _ = nearest(x, books[p])
                    sums[p] += totals(x, code, len(books[p]))
                    counts[p] += np.bincount(code, minlength=len(books[p]))
        found = [(p, e, j, int(counts[p][e]), Decimal(int(sums[p][e, j]))) for p in range(parts) for e in np.flatnonzero(counts[p]) for j in range(width)]
        kinds = [("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])

    sums = rows.select("q").mapInArrow(added, "part int, entry int, place int, n long, total decimal(38,0)")
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [b.tolist() for b in books]
    for r in sums.collect():  # at most parts * entries * width numbers
        out[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return [_whole(b) for b in out]


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> Compressed:
    """Codes and squared errors of every usable vector, and the codebooks they refer to; at most 256 entries."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("x")).where(integers.finite(F.col("x")))
    length = integers.common_length(own, "x")
    kept = cut_lineage(own.where(F.size("x") == length).select("vec_id", "label", integers.floors(F.col("x"), scale).alias("q")))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    width = -(-length // parts)
    first = [r["q"] + [0] * (parts * width - length) for r in kept.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(entries).collect()]
    if not first:
        return Compressed(spark.createDataFrame([], schema), [])
    books = [_whole([q[p * width : (p + 1) * width] for q in first]) for p in range(parts)]
    for _ in range(rounds):
        books = _moved(kept, books, width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [nearest(x, b) for x, b in zip(_cut(batch, parts, width), books, strict=True)]
                text = np.stack([code for code, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
                error = sum(e.astype(object) for _, e in found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), codes, pa.array([min(e, _MOST) for e in error], pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return Compressed(kept.mapInArrow(coded, schema), books)


def with_label_error(rows: DataFrame, few_labels: int = 10_000, salts: int = 16) -> DataFrame:
    """Rows with the summed error of all rows of their label; nulls are one label."""
    rows = cut_lineage(rows)
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("_sum"))
    sums = cut_lineage(sums.select("_label", F.least("_sum", F.lit(Decimal(_MOST))).cast("long").alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= few_labels:
        return rows.join(F.broadcast(sums), same).drop("_label")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    sums = sums.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(sums, same & (F.col("_salt") == F.col("_of"))).drop("_label", "_salt", "_of")
