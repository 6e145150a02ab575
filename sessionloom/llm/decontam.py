"""Benchmark decontamination: rare word n-grams as seeds, Smith-Waterman alignment as score.

The test items are a stated query set: they are taken in blocks of at most `block_words` words, and each block is matched against all
documents. For a block, one pass counts its words in the whole corpus; an n-gram's rarity is its expected number under those counts, so a
leaked item does not make its own n-grams common. Each item's rarest `seed_share` of n-grams are its seeds. A second pass looks every n-gram of every document
up in the block's seeds; around hits, item and passage are aligned locally (match 2, mismatch and gap -1). The score is the
alignment's share of a perfect one, so copies with exchanged, inserted or missing words still score.

Both passes are projections over whole texts; nothing of the documents is shuffled or collected, and what is sent to the tasks is
bounded by `block_words`.

Defined results: null text counts as empty; items that are null, or of fewer than `size` words, match nothing; equal items each
match; rows with equal ids give their best score per item; words are compared in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import words

SIZE = 3
MATCH, MISS, GAP = 2, 1, 1


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words, and the index of each text's first word."""
    data, offsets = words.text_buffer(pc.utf8_lower(texts))
    starts, ends, first = words.word_bounds(data, offsets)
    return words.word_hashes(data, starts, ends), first


@dataclass(frozen=True)
class Seeds:
    """One block of items: words per item, and sorted seed hashes with their item and place."""

    items: tuple[int, ...]
    bodies: tuple[np.ndarray, ...]
    keys: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and where it ends in the passage."""
    last = np.zeros(len(passage) + 1, np.int32)
    slope = np.arange(len(passage) + 1, dtype=np.int32) * GAP
    best, end = 0, 0
    for word in item:
        row = np.maximum(last - GAP, 0)
        np.maximum(row[1:], last[:-1] + np.where(passage == word, MATCH, -MISS), out=row[1:])
        last = np.maximum.accumulate(row + slope) - slope
        at = int(last.argmax())
        if last[at] > best:
            best, end = int(last[at]), at
    return best, end


def leaks(body: np.ndarray, seeds: Seeds, least: float) -> list[tuple[int, float, int, int]]:
    """item, score, first word and end of the best alignment of each item that scores `least` or more in a text's words."""
    grams = words.grams(body, SIZE)
    if not len(grams) or not len(seeds.keys):
        return []
    low = np.searchsorted(seeds.keys, grams, side="left")
    some = np.flatnonzero((low < len(seeds.keys)) & (seeds.keys[np.minimum(low, len(seeds.keys) - 1)] == grams))
    if not len(some):
        return []
    low = low[some]
    many = np.searchsorted(seeds.keys, grams[some], side="right") - low
    at = np.repeat(some, many)
    slot = np.repeat(low, many) + (np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many))
    owner, begin = seeds.owner[slot], at - seeds.place[slot]
    best: dict[int, tuple[float, int, int]] = {}
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (begin[1:] - begin[:-1] > np.array([len(b) for b in seeds.bodies])[owner[1:]])) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(owner)), strict=True):
        k = int(owner[a])
        item = seeds.bodies[k]
        n = len(item)
        lo, hi = max(0, int(begin[a]) - n), min(len(body), int(begin[b - 1]) + 2 * n)
        passage = body[lo:hi]
        # No alignment has more matches than the item has words in the passage.
        if np.isin(item, passage).sum() < least * n:
            continue
        score, end = align(item, passage)
        share = score / (MATCH * n)
        if share >= least - 1e-9 and share > best.get(k, (0.0,))[0]:
            _, back = align(item[::-1], passage[:end][::-1])
            best[k] = (share, lo + end - back, lo + end)
    return [(seeds.items[k], round(s, 6), a, b) for k, (s, a, b) in sorted(best.items())]


def blocks(benchmark: DataFrame, block_words: int, item_id: str = "item_id", text: str = "text") -> list[DataFrame]:
    """The items with text in parts of about `block_words` words, by a hash of the item."""
    own = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    total = own.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+", -1)))).first()[0] or 0
    n = max(1, -(-total // block_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [own.where(part == i) for i in range(n)] if total else []


def prepare(docs: DataFrame, items: DataFrame, text: str = "text", seed_share: float = 0.75) -> Seeds:
    """Seeds of one block of items, by the words' counts in all documents."""
    rows = sorted((r["item_id"], r["text"]) for r in items.collect())  # bounded by the block
    hashes, first = hashed(pa.array([t for _, t in rows], pa.string()))
    vocabulary = np.unique(hashes)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(len(held.value), np.int64), 0
        for batch in batches:
            for part in words.slices(batch, "text"):
                own, _ = hashed(part.column(0))
                total += len(own)
                at = np.minimum(np.searchsorted(held.value, own), len(held.value) - 1)
                seen += np.bincount(at[held.value[at] == own], minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(seen)), -1)), pa.array(np.append(seen, total))], names=["word", "n"])

    counts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}  # bounded by the block's words
    total = max(1, found.pop(-1, 1))
    often = np.log(np.array([found.get(i, 0) for i in range(len(vocabulary))], float) + 1.0) - np.log(total)
    ids, bodies, keys, owner, place = [], [], [], [], []
    for k, (item, _) in enumerate(rows):
        body = hashes[first[k] : first[k + 1]]
        if len(body) < SIZE:
            continue
        rare = often[np.searchsorted(vocabulary, body)]
        rare = np.convolve(rare, np.ones(SIZE), "valid")
        take = np.argsort(rare, kind="stable")[: max(4, int(np.ceil(seed_share * len(rare))))]
        keys.append(words.grams(body, SIZE)[take])
        owner.append(np.full(len(take), len(bodies)))
        place.append(take)
        ids.append(item)
        bodies.append(body)
    if not bodies:
        return Seeds((), (), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return Seeds(tuple(ids), tuple(bodies), key[order], np.concatenate(owner)[order], np.concatenate(place)[order])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, seed_share: float = 0.75, block_words: int = 1_000_000,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: documents and the items they hold a copy of."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    result = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, block_words):
        held = docs.sparkSession.sparkContext.broadcast(prepare(own, items, "text", seed_share))

        def matched(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in words.slices(batch, "text"):
                    hashes, first = hashed(part.column(1))
                    out = []
                    for i in range(len(part)):
                        out += [(part.column(0)[i].as_py(), *x) for x in leaks(hashes[first[i] : first[i + 1]], held.value, least)]
                    columns = list(zip(*out, strict=True)) if out else [[]] * 5
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    names = ["doc_id", "item_id", "score", "first_word", "end_word"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        result = result.unionByName(own.mapInArrow(matched, schema))
    best = F.struct("score", (-F.col("first_word")).alias("first"), "end_word")
    best = result.groupBy("doc_id", "item_id").agg(F.max(best).alias("best"))
    return best.select("doc_id", "item_id", "best.score", (-F.col("best.first")).alias("first_word"), "best.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, seed_share: float = 0.75, block_words: int = 1_000_000, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text holds no copy of any item; a filter without a shuffle."""
    for items in blocks(benchmark, block_words):
        held = docs.sparkSession.sparkContext.broadcast(prepare(docs, items, text, seed_share))
        docs = docs.where(_clean(held, least)(F.coalesce(docs[text], F.lit(""))))
    return docs


def _clean(held, least: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for part in words.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), "text"):
                hashes, first = hashed(part.column(0))
                out += [not leaks(hashes[first[i] : first[i + 1]], held.value, least) for i in range(len(part))]
            yield pd.Series(out, dtype=bool)

    return clean
