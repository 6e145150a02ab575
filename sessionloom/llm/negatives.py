"""Hard negatives by angular triangle filtering.

Rows are integer vectors. Of each row its norm and its angles to `directions` reference directions are stored. On the sphere the triangle
inequality holds, so for an anchor with angles A and a row with angles B

    max |A - B|  <=  angle(anchor, row)  <=  min(A + B, 2 pi - A - B)

with the maximum and minimum over all directions. The cosines of both ends, times both norms, bound the score; the bounds are widened by more than the
rounding of angles, norms and products can amount to (`_slack`, `_pad`), then rounded outwards to integers. Only rows whose bounds overlap what an anchor
still looks for are scored, exactly, in integers (`integers.products`).

1. *Index.* A row belongs to the cell of its nearest direction and, in it, to a band of angles. The directory of at most `directions` * `bands` cells
   holds counts and the least and largest norm. A cell's rows are dealt over blocks of about `block` rows, so equal vectors are many blocks.
2. *Positives.* Scores with a bounded sample of rows give each anchor a floor: k rows score at least that much. It visits the cells whose upper bound
   reaches the floor; in a block, sorted by angle to the cell's direction, a binary search gives the window of angles that can reach it; rows in the window whose
   own bounds reach it are scored. The k best of a block leave it, and the k best of those stay.
3. *Negatives.* As before, with the score windows [low * p, p] of the anchor's positives: a row is scored if its bounds overlap one of them and
   aren't below the floor that the sample gives that window.

The sample and the directions change the work only, never the result. Anchors against all rows is a stated query set: where no bound excludes a cell (random
directions in many dimensions), each block of anchors meets each block of rows. Both sides are bounded, and k rows an anchor and window leave a block.

Defined results: rows with a null id or label, a null or empty vector or a null or non-finite component take no part, nor do vectors of another
length than the most frequent one (the smaller of equals); equal rows (id, label, vector) are one; rows of one id that differ are rows of their own, but no answers to
each other; ties go to the smaller id. Components beyond a long are moved to its border, and scores that don't fit a long become the nearest that does.
Zero vectors score 0. An empty table, or one without anchors, gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm import integers
from sessionloom.session import cut_lineage

_LEAST = -(2**63)
_MOST = 2**63 - 1
_ANSWER = "key long, place int, id long, score long"
#: Visits sent on at a time.
_VISITS = 8_192


def _slack(dimensions: int) -> float:
    """More than a computed angle can be off: the cosine's rounding is under e, and an arc cosine turns e into at most 2 * sqrt(e) near its ends."""
    return 4.0 * np.sqrt((dimensions + 8) * 2.0**-52)


def _pad(scale: np.ndarray | float) -> np.ndarray | float:
    """More than a bound of that size can be off."""
    return 1e-6 + 1e-9 * scale


def spread(unit: np.ndarray, wanted: int) -> np.ndarray:
    """Unit vectors far from each other: each is the one of largest angle to those before it."""
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(wanted, len(unit)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def angles(q: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles to all directions; those of a zero vector are zero, its norm settles every bound."""
    x = q.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / np.where(norm > 0, norm, 1.0)[:, None]
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(unit @ directions.T, -1.0, 1.0)), 0.0)


def bounds(norm: float, angle: np.ndarray, norms: np.ndarray, others: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Integers that the score with each of the rows can't be under or over."""
    apart = np.abs(others - angle).max(axis=1)
    total = others + angle
    far = np.minimum(total, 2 * np.pi - total).min(axis=1)
    size = norm * norms
    low = size * np.cos(np.minimum(np.pi, far + 2 * slack)) - _pad(size)
    high = size * np.cos(np.maximum(0.0, apart - 2 * slack)) + _pad(size)
    return np.ceil(low), np.floor(high)


def window(sorted_angles: np.ndarray, angle: float, norm: float, most: float, floor: float, slack: float) -> slice:
    """Rows of a block, sorted by angle to its direction, that can score `floor` or more; `most` is the block's largest norm."""
    size = norm * most
    if floor > size + _pad(size):
        return slice(0, 0)
    if floor <= 0 or size == 0:  # a smaller norm may reach a negative floor at a larger angle
        return slice(0, len(sorted_angles))
    reach = np.arccos(np.clip((floor - _pad(size)) / size, -1.0, 1.0)) + 3 * slack
    return slice(int(np.searchsorted(sorted_angles, angle - reach, "left")), int(np.searchsorted(sorted_angles, angle + reach, "right")))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def least_of(positive: int, low: tuple[int, int]) -> int:
    """The smallest integer n with low[1] * n >= low[0] * positive."""
    return -((-low[0] * positive) // low[1])


class _Block:
    """The rows of one block, sorted by angle to its direction."""

    def __init__(self, rows: pa.Table, slack: float):
        angle, cell = integers.matrix(rows["angle"], np.float64), rows["cell"][0].as_py()
        order = np.argsort(angle[:, cell], kind="stable")
        self.cell, self.angle, self.slack = cell, angle[order], slack
        self.own = np.ascontiguousarray(self.angle[:, cell])
        self.norm = rows["norm"].to_numpy()[order]
        self.id, self.label = rows["id"].to_numpy()[order], rows["label"].to_numpy()[order]
        self.q = integers.matrix(rows["q"])[order]
        self.most = float(self.norm.max())

    def scored(self, norm: float, angle: np.ndarray, q: np.ndarray, fits: np.ndarray, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the rows that fit and whose bounds meet [floor, top]."""
        near = window(self.own, angle[self.cell], norm, self.most, float(floor), self.slack)
        at = near.start + np.flatnonzero(fits[near])
        low, high = bounds(norm, angle, self.norm[at], self.angle[at], self.slack)
        at = at[(high >= float(floor)) & (low <= float(top))]
        return at, integers.to_long(integers.products(q[None, :], self.q[at])[0] if len(at) else np.zeros(0, np.int64))


def _answers(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of key, place, ids and scores."""
    n = [len(ids) for _, _, ids, _ in found]
    join = lambda i: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)
    return pa.table({
        "key": pa.array(np.repeat([f[0] for f in found], n).astype(np.int64)), "place": pa.array(np.repeat([f[1] for f in found], n).astype(np.int32)),
        "id": pa.array(join(2), pa.int64()), "score": pa.array(join(3), pa.int64()),
    })


def _anchors(rows: pa.Table) -> Iterator[tuple]:
    """key, id, label, norm, angles, vector and windows (floor and top, flat) of each anchor."""
    q, angle = integers.matrix(rows["q"]), integers.matrix(rows["angle"], np.float64)
    plain = [rows[c].to_pylist() for c in ("key", "id", "label", "norm", "windows")]
    yield from zip(*plain[:4], angle, q, plain[4], strict=True)


def _positives_in(slack: float, k: int):
    def ranked(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and anchors.num_rows:
            block = _Block(rows, slack)
            for key, own, label, norm, angle, q, (floor, top) in _anchors(anchors):
                at, score = block.scored(norm, angle, q, (block.label == label) & (block.id != own), floor, top)
                keep = best(block.id[at], score, k)
                found.append((key, 0, block.id[at][keep], score[keep]))
        return _answers(found)

    return ranked


def _negatives_in(slack: float, k: int, low: tuple[int, int]):
    def ranked(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and anchors.num_rows:
            block = _Block(rows, slack)
            for (key, own, label, norm, angle, q, flat), positives in zip(_anchors(anchors), anchors["positives"].to_pylist(), strict=True):
                at, score = block.scored(norm, angle, q, (block.label != label) & (block.id != own), min(flat[::2]), max(flat[1::2]))
                ids = block.id[at]
                for place, p in enumerate(positives):
                    fits = np.flatnonzero((score >= max(least_of(p, low), flat[2 * place])) & (score <= p))
                    keep = fits[best(ids[fits], score[fits], k)]
                    found.append((key, place, ids[keep], score[keep]))
        return _answers(found)

    return ranked


def _best_of(near: DataFrame, k: int) -> DataFrame:
    """The k best answers of each anchor and place, ranked from 1."""
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), scale: int = 256,
    directions: int = 8, bands: int = 16, sample: int = 4_096, block: int = 4_096, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `anchors` (over the columns id and label) holds. A positive is one of the `positives` best other rows of the anchor's
    label; a negative is one of the `negatives` best rows of another label whose score lies between low[0] / low[1] of the positive's and the positive's.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    given = F.col("label") if label is None else label
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), given.cast("long").alias("label"), F.col(embedding).alias("x"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & integers.finite(F.col("x")))
    length = integers.common_length(own, "x")
    own = own.where(F.size("x") == length).select("id", "label", integers.floors(F.col("x"), scale).alias("q"))
    own = cut_lineage(own.withColumn("key", F.xxhash64("id", "label", "q")).dropDuplicates(["key", "id"]))

    # A bounded sample gives directions and floors; only ids are ordered, and at most `sample` rows come back.
    few = F.broadcast(own.select(F.col("key").alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(sample))
    drawn = own.join(few, F.col("key") == F.col("_key"), "left_semi").orderBy("key", "id").limit(sample).toPandas()
    if not len(drawn):
        return spark.createDataFrame([], schema)
    known = np.array(drawn["q"].tolist(), np.int64)
    units = known / np.maximum(np.sqrt((known.astype(float) ** 2).sum(axis=1)), 1e-300)[:, None]
    units = units[(known != 0).any(axis=1)]
    refs = spread(units, directions) if len(units) else np.eye(1, length)
    slack, width = _slack(length), np.pi / bands
    shared = spark.sparkContext.broadcast((refs, known, drawn["id"].to_numpy(), drawn["label"].to_numpy()))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value[0]
        for batch in batches:
            if batch.num_rows:
                norm, angle = angles(integers.matrix(batch.column("q")), refs)
                cell = np.argmin(angle, axis=1)
                band = np.minimum((angle[np.arange(len(cell)), cell] / width).astype(np.int32), bands - 1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, angle.size + 1, angle.shape[1], dtype=np.int32)), pa.array(angle.ravel()))
                columns = [pa.array(norm), flat, pa.array(cell.astype(np.int32)), pa.array(band)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "norm", "angle", "cell", "band"])

    kinds = "id long, label long, q array<long>, key long, norm double, angle array<double>, cell int, band int"
    index = cut_lineage(own.select("id", "label", "q", "key").mapInArrow(coded, kinds))
    asked = cut_lineage(index.where(anchors).drop("cell", "band"))
    cells = index.groupBy("cell", "band").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"))
    cells = sorted(tuple(r) for r in cells.collect())  # at most directions * bands
    turns = max(1, -(-asked.count() // block))
    directory = spark.sparkContext.broadcast(np.array([(c, b, -(-n // block), least, most) for c, b, n, least, most in cells], float))
    cuts = F.create_map(*(F.lit(v) for c, b, n, _, _ in cells for v in (c * bands + b, -(-n // block))))
    held = index.withColumn("part", F.pmod(F.xxhash64("key", "id"), F.element_at(cuts, F.col("cell") * bands + F.col("band"))).cast("int"))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def visiting(floors: Callable[..., list[int]], columns: list[str]):
        """Each anchor with its windows, once for each part of each cell that its windows reach."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, known, known_ids, known_labels = shared.value
            cell, band, parts, least, most = directory.value.T
            cell, parts = cell.astype(int), parts.astype(np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    scores = integers.to_long(integers.products(integers.matrix(part.column("q")), known))
                    angle, plain = integers.matrix(part.column("angle"), np.float64), part.to_pydict()
                    held_back: list[tuple] = []
                    for i, (own, label, norm) in enumerate(zip(plain["id"], plain["label"], plain["norm"], strict=True)):
                        flat = floors(scores[i], known_ids != own, known_labels == label, *(plain[c][i] for c in columns))
                        if not flat:
                            continue
                        floor, top = float(min(flat[::2])), float(max(flat[1::2]))
                        # The nearest and the farthest that an angle of the band can be, and the norm that makes most of it.
                        a = angle[i, cell]
                        near = np.maximum(0.0, np.maximum(band * width - a, a - (band + 1) * width) - 3 * slack)
                        far = np.minimum(np.pi, np.minimum(a + (band + 1) * width, 2 * np.pi - a - band * width) + 3 * slack)
                        high = norm * np.cos(near) * np.where(np.cos(near) > 0, most, least) + _pad(norm * most)
                        below = norm * np.cos(far) * np.where(np.cos(far) > 0, least, most) - _pad(norm * most)
                        seen = np.flatnonzero((np.floor(high) >= floor) & (np.ceil(below) <= top))
                        spots = np.repeat(seen, parts[seen])
                        numbers = np.arange(len(spots)) - np.repeat(np.cumsum(parts[seen]) - parts[seen], parts[seen])
                        for j in range(0, len(spots), _VISITS):
                            held_back.append((i, spots[j : j + _VISITS], numbers[j : j + _VISITS], flat))
                            if sum(len(h[1]) for h in held_back) >= _VISITS:
                                yield sent(part, held_back)
                                held_back = []
                    if held_back:
                        yield sent(part, held_back)

        def sent(part: pa.RecordBatch, visits: list[tuple]) -> pa.RecordBatch:
            cell, band = directory.value[:, 0].astype(np.int32), directory.value[:, 1].astype(np.int32)
            n = [len(v[1]) for v in visits]
            to, number = np.concatenate([v[1] for v in visits]), np.concatenate([v[2] for v in visits])
            taken = part.take(pa.array(np.repeat([v[0] for v in visits], n)))
            wins = [w for v in visits for w in [v[3]] * len(v[1])]
            columns = [pa.array(wins, pa.list_(pa.int64())), pa.array(cell[to]), pa.array(band[to]), pa.array(number.astype(np.int32))]
            return pa.RecordBatch.from_arrays([*taken.columns, *columns], [*part.schema.names, "windows", "cell", "band", "part"])

        return rows

    def visit(rows: DataFrame, floors: Callable[..., list[int]], columns: list[str], extra: str, ranked) -> DataFrame:
        fields = f"id long, label long, q array<long>, key long, norm double, angle array<double>{extra}, windows array<long>, cell int, band int, part int"
        visits = rows.repartition(F.col("key")).mapInArrow(visiting(floors, columns), fields).withColumn("turn", F.pmod(F.xxhash64("key"), F.lit(turns)).cast("int"))
        keys = ["cell", "band", "part", "turn"]
        return held.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(ranked, _ANSWER)

    def kth(scores: np.ndarray, k: int) -> int:
        """The k-th best of some scores, which no better answer can be under; without k of them, nothing is known."""
        return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else _LEAST

    def for_positives(scores, others, same):
        return [kth(scores[others & same], positives), _MOST]

    near = cut_lineage(_best_of(visit(asked, for_positives, [], "", _positives_in(slack, positives)), positives))
    lists = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("_p"))  # `positives` an anchor
    lists = lists.select("key", F.transform("_p", lambda x: x["score"]).alias("positives"))

    def for_negatives(scores, others, same, found):
        flat = []
        fit = scores[others & ~same]
        for p in found:
            floor = least_of(p, low)
            flat += [max(floor, kth(fit[(fit >= floor) & (fit <= p)], negatives)), p] if floor <= p else [_MOST, _LEAST]
        return flat if any(f <= t for f, t in zip(flat[::2], flat[1::2], strict=True)) else []

    wanted = asked.join(lists, "key")
    wanted = wanted.select("id", "label", "q", "key", "norm", "angle", "positives")
    answers = _best_of(visit(wanted, for_negatives, ["positives"], ", positives array<long>", _negatives_in(slack, negatives, low)), negatives)
    named = asked.select("key", F.col("id").alias("anchor_id")).join(
        near.select("key", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "key"
    )
    out = answers.select("key", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["key", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
