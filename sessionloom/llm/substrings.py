"""Exact substring removal with fixed-block anchors.

Every text is a sequence of words (`words.py`). A *window* is `window` consecutive words; a word goes if some window covering it also
starts in a document with a smaller id. Steps, all distributed:

1. *Blocks and probes.* Each document's non-overlapping blocks of `window // 2` words are the index; every rolling window of that
   length probes it. Any repeated window holds one whole block of the earlier document, so no repeat is missed. Both sides are
   looked up by the smallest 5-word hash inside (a function of the content, so equal runs meet); neighbouring probes with the same
   key travel as one row, about one row per eleven words.
2. *Hits.* Per key, the smallest and the largest document and the smallest with a block (map-side combined). Runs of probes whose key
   no other document has are gone; a run is a hit if a smaller document has a block there, or if it holds a block that a larger
   document probes.
3. *Extension.* Whole windows that hold a hit, and all of whose probes some other document shares, are hashed, the smallest document of each hash is found, and windows that start in
   a larger document are removed. Neighbouring windows join into maximal repeats. Whole copies of an earlier text need no extension:
   all their windows start there, so they are told by the digest of the text.

No pairs are made: a passage held by a third of all documents costs one row per occurrence, and both joins have one row per key on
one side, so Spark can split a hot key. Only texts with a hit are carried on; they travel compressed.

Defined results: null or empty text has no words; a null id neither removes nor loses words; rows with equal ids never remove each
other's words, and each is judged by its own text; texts shorter than a window stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import words
from sessionloom.session import cut_lineage

GRAM = 5
_RUN = 64


def _anchor_rows(window: int):
    block = window // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                data, offsets = words.text_buffer(part.column(1))
                starts, ends, first = words.word_bounds(data, offsets)
                low = words.grams(words.word_hashes(data, starts, ends), GRAM)
                if len(low) < block - GRAM + 1:
                    continue
                key = words.rolling_min(low, block - GRAM + 1)
                at = np.flatnonzero(words.inside(first, block, len(key)))
                if not len(at):
                    continue
                text = np.searchsorted(first, at, side="right") - 1
                place = at - first[text]
                new = np.ones(len(at), bool)
                new[1:] = (key[at[1:]] != key[at[:-1]]) | (text[1:] != text[:-1]) | (place[1:] % _RUN == 0)
                head = np.flatnonzero(new)
                long = np.diff(np.append(head, len(at)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[at[head]].view(np.int64)),
                        part.column(0).take(pa.array(text[head])),
                        pa.array(place[head] * _RUN + long - 1),
                    ],
                    names=["key", "doc_id", "run"],
                )

    return rows


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([pack(x.as_buffer()) for x in texts], pa.binary())], names=["doc_id", "check", "packed"]
        )


def _unpacked(batches: Iterator[pa.RecordBatch], limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches with the column `packed` opened as `text`, of about `limit` bytes each."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        at = batch.schema.get_field_index("packed")
        begin, held, texts = 0, 0, []
        for i, value in enumerate(batch.column(at)):
            texts.append(unpack(value.as_buffer()))
            held += len(texts[-1])
            if held >= limit or i + 1 == len(batch):
                yield batch.slice(begin, len(texts)).set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string()))
                begin, held, texts = i + 1, 0, []


def _covered(begin: np.ndarray, end: np.ndarray, wanted: np.ndarray, n: int, width: int) -> np.ndarray:
    """How many of the `width` places from each place on lie in a wanted interval."""
    edge = np.zeros(n + width + 1, np.int64)
    np.add.at(edge, begin[wanted], 1)
    np.add.at(edge, end[wanted], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
    return inside[width : width + n] - inside[:n]


def _window_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            for part in words.slices(batch, "text"):
                data, offsets = words.text_buffer(part.column(2))
                starts, ends, first = words.word_bounds(data, offsets)
                whole = words.grams(words.word_hashes(data, starts, ends), window)
                if not len(whole):
                    continue
                runs = part.column(3)
                text = np.repeat(np.arange(len(part)), runs.value_lengths().to_numpy(zero_copy_only=False))
                run = runs.flatten().to_numpy(zero_copy_only=False)
                flags, run = run % 8, run // 8
                begin = np.minimum(run // _RUN + first[text], first[text + 1])
                end = np.minimum(begin + run % _RUN + 1, first[text + 1])
                probes = window - window // 2 + 1
                below, above, hit = (_covered(begin, end, flags & bit > 0, len(starts), probes)[: len(whole)] for bit in (1, 2, 4))
                near = ((below == probes) | (above == probes)) & (hit > 0)
                at = np.flatnonzero(near & words.inside(first, window, len(whole)))
                if not len(at):
                    continue
                text = np.searchsorted(first, at, side="right") - 1
                check = part.column(1).to_numpy(zero_copy_only=False)[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(whole[at].view(np.int64)),
                        part.column(0).take(pa.array(text)),
                        pa.array(((at - first[text]) << 32) | check),
                    ],
                    names=["hash", "doc_id", "place"],
                )

    return rows


def _cut_rows(window: int):
    """Texts with their removed window starts -> spans removed and the words kept."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            spans, texts, digests, gone = [], [], [], []
            for text, places in zip(batch.column(2), batch.column(3), strict=True):
                own = text.as_py().encode().split()
                mark = np.zeros(len(own) + 1, np.int64)
                begin = places.values.to_numpy(zero_copy_only=False)
                np.add.at(mark, begin, 1)
                np.add.at(mark, begin + window, -1)
                out = np.cumsum(mark)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                kept = b" ".join(compress(own, ~out))
                gone.append(int(out.sum()))
                texts.append(kept.decode())
                digests.append(sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(spans, _SPANS), pa.array(digests), pa.array(texts)],
                names=["doc_id", "check", "gone", "spans", "sha", "kept"],
            )

    return rows


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, with_text: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, repeats (maximal spans of removed words), kept_sha256 and, if asked for, kept_text."""
    if window < 4 * GRAM:
        raise ValueError("the window must hold at least twenty words")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("check", F.crc32(F.col("text").cast("binary")))
    named = own.where("doc_id is not null")
    contents = named.select("doc_id", "check", F.unhex(F.md5(F.col("text").cast("binary"))).alias("content"))
    firsts = contents.groupBy("content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = cut_lineage(contents.join(firsts, "content").where("doc_id > first").select("doc_id", "check").distinct())
    anchors = named.select("doc_id", "text").mapInArrow(_anchor_rows(window), "key long, doc_id long, run long")
    block = window // 2
    # A run of probes starting at `place` holds a block if a multiple of the block length lies in it.
    place = F.expr(f"run div {_RUN}")
    holds = (F.expr(f"((run div {_RUN} + run % {_RUN}) div {block}) * {block}")) >= place
    keys = (
        anchors.groupBy("key")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.when(holds, F.col("doc_id"))).alias("block"))
        .where("low < high")
    )
    found = anchors.join(keys, "key")
    below, above = F.col("doc_id") > F.col("low"), F.col("doc_id") < F.col("high")
    hit = F.coalesce(F.col("doc_id") > F.col("block"), F.lit(False)) | (holds & above)
    flags = below.cast("long") + 2 * above.cast("long") + 4 * hit.cast("long")
    # The lowest three bits of a run now say: shared with a smaller, with a larger document, hit.
    runs = found.groupBy("doc_id").agg(F.collect_list(F.col("run") * 8 + flags).alias("runs"), F.max(hit).alias("hit")).where("hit").drop("hit")
    packed = named.select("doc_id", "check", "text").mapInArrow(_packed, "doc_id long, check long, packed binary")
    candidates = cut_lineage(packed.join(runs, "doc_id").join(copies, ["doc_id", "check"], "left_anti").select("doc_id", "check", "packed", "runs"))
    windows = cut_lineage(candidates.mapInArrow(_window_rows(window), "hash long, doc_id long, place long"))
    lowest = windows.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    gone = (
        windows.join(lowest, "hash")
        .where("doc_id > low")
        .groupBy("doc_id", F.expr("place & 4294967295L").alias("check"))
        .agg(F.collect_list(F.expr("shiftright(place, 32)")).alias("places"))
    )
    cut = candidates.select("doc_id", "check", "packed").join(gone, ["doc_id", "check"]).mapInArrow(
        _cut_rows(window), "doc_id long, check long, gone long, spans array<struct<first: long, end: long>>, sha string, kept string"
    )
    cut = cut.dropDuplicates(["doc_id", "check"])
    tidy = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    plain = own.select("doc_id", "check", tidy.alias("tidy"))
    plain = plain.select(
        "doc_id", "check", F.sha2("tidy", 256).alias("own_sha"),
        F.when(F.col("tidy") == "", F.lit(0)).otherwise(F.length("tidy") - F.length(F.replace("tidy", F.lit(" "))) + 1).cast("long").alias("n_words"),
        *(["tidy"] if with_text else []),
    )
    found = plain.join(copies.withColumn("copied", F.lit(True)), ["doc_id", "check"], "left").join(cut, ["doc_id", "check"], "left")
    whole = F.col("copied") & (F.col("n_words") >= window)
    empty = F.sha2(F.lit(""), 256)
    columns = [
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", F.array())).alias("repeats"),
        F.when(whole, empty).otherwise(F.coalesce("sha", "own_sha")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(whole, F.lit("")).otherwise(F.coalesce("kept", "tidy")).alias("kept_text"))
    return found.select(*columns)
