"""Near-duplicate documents by Order MinHash.

A text's k-mers are its runs of five words, each labelled with its occurrence number. For each of `sketches` hash functions the
`depth` smallest labelled k-mers are taken and kept *in text order*; their combined hash is a bucket key, so texts meet when they
share k-mers in the same order (small edit distance), not merely the same words. Moved passages and lines
repeated a different number of times change order and labels but hardly the set: `bands` further keys are the `rows` smallest of the
unlabelled set, without order. Texts of fewer than `SHORT` distinct k-mers meet their
partners for certain instead: their keys are the first k-mers in one order for all texts, rare ones first, so many that two texts of
`similarity` or more share one of them (texts that could be partners of a short one have these keys too).

1. Equal texts collapse first; one representative (smallest id) stands for them.
2. Each representative is compared with the smallest one of its buckets. Links make classes. Then every bucket that
   spans several classes draws a leader, with which the members of other classes are compared; a text in the middle of a
   group leads some of its buckets, so groups close fast. Buckets where that brought a link take another turn, as long as more than one
   pair in a hundred is a link. A turn over a bucket of n costs n comparisons, never n * n; a bucket of texts that share a passage only has one.
3. The texts of buckets that then still span several classes meet once more by an exact prefix filter: under their first k-mers, rare
   ones first, in groups of at most two blocks of members. The places of the k-mer that two texts share bound their similarity, so a
   passage that many texts have makes no pairs of them, and no pair of `similarity` is left out. Pairs inside a class need no look.
4. A pair that its signatures don't rule out (they do with a chance of one in 30,000 at the bound) is verified by banded alignment of words: the number of edits, found along the diagonals of a band, bounds how many
   k-mers survive. Where that proves a similarity of `similarity` or more the pair is linked; otherwise the exact Jaccard
   similarity of the k-mer sets decides. Nothing is collected; edges and classes are tables.

With the defaults a pair of longer texts of similarity 0.8 has no set key (24 of 6 k-mers) in common with probability 7e-4 to 9e-4,
whatever its order and repeats; if these agree too, no ordered key (32 of 5) either in 3e-6 of those.

Defined results: null text counts as empty. Texts of fewer than five words (empty ones too) are near duplicates of equal texts only.
Rows with a null id are a class of their own (class_id null). Rows that repeat id and text are one document; of several texts under one id, the one of smallest digest is compared, the
others are matched to equal texts only. Ties do not arise: the class is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import words
from sessionloom.session import cut_lineage

SHINGLE = 5
#: Bytes of a signature, and members of a k-mer compared in one go.
BINS = 256
BLOCK = 1_000
#: Texts of fewer distinct k-mers find their partners by an exact prefix filter.
SHORT = 100
#: The filter's order puts k-mers last that recur in one of so many texts; at most so many are known by their count, the rest count as rare.
SAMPLED = 8
KNOWN = 100_000
#: Bytes of text whose k-mers are held at a time.
SLICE = 500_000
#: Turns over the buckets end when so few of the pairs are links; the last step finds all that are left.
CLOSING = 0.01
_SEEDS = words.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence number in the text."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return shingles
    head = np.concatenate([[0], np.flatnonzero(~same) + 1])
    count = np.arange(len(ranked)) - np.repeat(head, np.diff(np.append(head, len(ranked))))
    out = shingles.copy()
    out[order[count > 0]] = words.mix(ranked[count > 0] + count[count > 0].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return out


def order_sketch(shingles: np.ndarray, sketches: int, depth: int) -> np.ndarray:
    """One hash per sketch: the `depth` smallest labelled k-mers in text order."""
    return _minima(labelled(shingles), _SEEDS[:sketches], depth, in_order=True)


def set_sketch(distinct: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band: the `rows` smallest k-mers of the set, wherever and however often the text has them."""
    return _minima(distinct, _SEEDS[len(_SEEDS) - bands :], rows, in_order=False)


def _minima(marked: np.ndarray, seeds: np.ndarray, depth: int, in_order: bool) -> np.ndarray:
    n, take, sketches = len(marked), min(depth, len(marked)), len(seeds)
    out = np.empty(sketches, np.uint64)
    step = max(1, min(sketches, 400_000 // n))
    cut = np.uint64(min(1.0, (3.0 * depth + 8) / n) * (2.0**64 - 2048))
    for a in range(0, sketches, step):
        values = marked[None, :] * seeds[a : a + step, None]
        row, place = np.nonzero(values <= cut)
        have = np.bincount(row, minlength=len(values))
        if (have < take).any():
            row, place = np.repeat(np.arange(len(values)), n), np.tile(np.arange(n), len(values))
            have = np.full(len(values), n)
        ranked = np.lexsort((place, values[row, place], row))
        first = np.concatenate([[0], np.cumsum(have)[:-1]])
        picked = place[ranked][first[:, None] + np.arange(take)]
        if in_order:
            picked.sort(axis=1)
        key = np.zeros(len(values), np.uint64)
        for j in range(take):
            key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + marked[picked[:, j]])
        out[a : a + step] = words.mix(key + seeds[a : a + step])
    return out


def may_be_short(distinct: int, similarity: float) -> bool:
    """Whether a text of so many k-mers can be alike to one of fewer than `SHORT`."""
    return distinct * similarity < SHORT


def prefix_keys(distinct: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The k-mers of which two sets of `similarity` or more share one, whatever the order: all but `similarity` of them, and one more.

    distinct and common are sorted; rank tells the place of the common ones, which come after all others.
    """
    n = len(distinct)
    take = min(n, n - int(np.ceil(similarity * n - 1e-9)) + 1)
    late = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
        late = np.where(common[at] == distinct, rank[at] + 1, 0)
    return words.mix(distinct[np.lexsort((distinct, late))[:take]] ^ np.uint64(0x8EBC6AF09C88C6E3))


def signature(shingles: np.ndarray) -> bytes:
    """One-permutation min-hash of the k-mer set: a byte for each of `BINS` ranges of hash values, 0 where the text has none."""
    ranked = np.sort(shingles)
    at = np.searchsorted(ranked, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    some = at < np.append(at[1:], len(ranked))
    out = np.zeros(BINS, np.uint8)
    out[some] = words.mix(ranked[at[some]]) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs are not ruled out: four standard errors below the similarity, so one pair in 30,000 at the bound is."""
    bins = ((a | b) != 0).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return same >= similarity * bins - 4 * np.sqrt(similarity * (1 - similarity) * bins)


def _prefix_rows(similarity: float, recurring):
    """The first k-mers of each text in the order of prefix_keys, with their place in it and the number of the text's k-mers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                data, offsets = words.text_buffer(part.column(2))
                starts, ends, first = words.word_bounds(data, offsets)
                hashes = words.word_hashes(data, starts, ends)
                sets = [np.unique(words.grams(hashes[a:b], SHINGLE)) for a, b in zip(first[:-1], first[1:], strict=True)]
                keys = [prefix_keys(x, similarity, *recurring.value) for x in sets]
                length = np.array([len(x) for x in keys])
                place = np.concatenate([np.arange(n) for n in length])
                size = np.repeat([len(x) for x in sets], length)
                rep, root = (np.repeat(part.column(i).to_numpy(), length) for i in (0, 1))
                columns = [np.concatenate(keys).view(np.int64), rep, root, place.astype(np.int32), size.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["gram", "rep", "root", "place", "size"])

    return rows


def _partners(similarity: float):
    """Pairs of different classes that can still have `similarity`, if the k-mer of their group is the first one they share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for one_block, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rep, root, block, place, size = (members.values.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                for i in range(len(rep) - 1):
                    rest = slice(i + 1, len(rep))
                    most = np.minimum(size[i] - place[i], size[rest] - place[rest])
                    wanted = (root[rest] != root[i]) & (most >= similarity / (1 + similarity) * (size[i] + size[rest]) - 1e-9)
                    if not one_block:
                        wanted &= block[rest] != block[i]
                    others = rep[rest][wanted]
                    left.append(np.minimum(rep[i], others))
                    right.append(np.maximum(rep[i], others))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return rows


def partners(texts: DataFrame, similarity: float, recurring=None) -> DataFrame:
    """a, b: pairs of the texts (rep, root, text) of different roots, among them all of `similarity` or more. recurring: broadcast of `recurring_grams`.

    Texts meet under the first k-mers of an order that puts recurring ones last, which two alike texts must share. The places of the
    first shared k-mer bound how many can follow, so texts that have a common passage only don't become pairs.
    """
    recurring = recurring or texts.sparkSession.sparkContext.broadcast(recurring_grams(texts))
    held = cut_lineage(texts.select("rep", "root", "text").mapInArrow(_prefix_rows(similarity, recurring), "gram long, rep long, root long, place int, size int"))
    # Only k-mers that several classes have make pairs.
    spans = held.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    split = held.join(spans.select("gram", parts.alias("parts")), "gram")
    split = split.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    groups = split.groupBy("gram", "low", "high").agg(F.collect_list(F.struct("rep", "root", "block", "place", "size")).alias("members"))
    return groups.select((F.col("low") == F.col("high")).alias("one"), "members").mapInArrow(_partners(similarity), "a long, b long").distinct()


def bucket_keys(shingles: np.ndarray, sketches: int, depth: int, bands: int, rows: int, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Keys of one text. All partners of a short text are found by its prefix keys, so it needs no others."""
    distinct = np.unique(shingles)
    keys = []
    if len(distinct) >= SHORT:
        keys += [order_sketch(shingles, sketches, depth), set_sketch(distinct, bands, rows)]
    if may_be_short(len(distinct), similarity):
        keys.append(prefix_keys(distinct, similarity, common, rank))
    return np.concatenate(keys)


def _ruled(similarity: float):
    """a, b and whether their signatures leave the pair open."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike(a, b, similarity))], names=["a", "b", "open"])

    return rows


def _sampled_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "text", SLICE):
            data, offsets = words.text_buffer(part.column(0))
            starts, ends, first = words.word_bounds(data, offsets)
            hashes = words.word_hashes(data, starts, ends)
            sets = [np.unique(words.grams(hashes[a:b], SHINGLE)) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["gram"])


def recurring_grams(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """k-mers that recur in a sample of the different texts, sorted, and their places from the rarest on. They set an order only; no result depends on them."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct()
    grams = sample.mapInArrow(_sampled_grams, "gram long")
    # As Arrow columns: rows of Python objects would take the driver many times the memory.
    counted = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "gram").limit(KNOWN).toArrow()
    common, n = counted["gram"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    rank = np.empty(len(common), np.int64)
    rank[np.lexsort((common, -n))] = np.arange(len(common))[::-1]
    order = np.argsort(common)
    return common[order], rank[order]


def _sketch_rows(sketches: int, depth: int, bands: int, minima: int, similarity: float, recurring):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                data, offsets = words.text_buffer(part.column(2))
                starts, ends, first = words.word_bounds(data, offsets)
                hashes = words.word_hashes(data, starts, ends)
                own = np.flatnonzero(np.diff(first) >= SHINGLE)
                flat, length = [np.zeros(0, np.uint64)], np.zeros(len(part), np.int64)
                marks: list[bytes | None] = [None] * len(part)
                for i in own:
                    shingles = words.grams(hashes[first[i] : first[i + 1]], SHINGLE)
                    keys = bucket_keys(shingles, sketches, depth, bands, minima, similarity, *recurring.value)
                    flat.append(keys)
                    length[i] = len(keys)
                    marks[i] = signature(shingles)
                flat = np.concatenate(flat).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat))
                size = np.maximum(np.diff(first) - SHINGLE + 1, 0)
                columns = [part.column(0), part.column(1), lists, pa.array(size), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "keys", "size", "mark"])

    return rows


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Insertions, deletions and substitutions between two word sequences if at most `most`, along the diagonals of that band."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    breaks: dict[int, np.ndarray] = {}

    def slide(i: int, k: int) -> int:
        if k not in breaks:
            lo, hi = max(0, -k), min(n, m - k)
            breaks[k] = np.append(np.flatnonzero(a[lo:hi] != b[lo + k : hi + k]) + lo, hi)
        stops = breaks[k]
        return int(stops[np.searchsorted(stops, i)]) if i < stops[-1] else int(max(i, stops[-1]))

    reach = {0: slide(0, 0)}
    goal = m - n
    for d in range(most + 1):
        if d:
            last, reach = reach, {}
            for k in range(max(-d, -n), min(d, m) + 1):
                options = []
                if k in last:
                    options.append(last[k] + 1)
                if k - 1 in last:
                    options.append(last[k - 1])
                if k + 1 in last:
                    options.append(last[k + 1] + 1)
                if not options:
                    continue
                i = min(max(options), n, m - k)
                if i >= max(0, -k):
                    reach[k] = slide(i, k)
        if reach.get(goal, -1) >= n:
            return d
    return None


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two word-hash sequences have k-mer similarity `similarity` or more: alignment first, else the exact sets."""
    left, right = words.grams(a, SHINGLE), words.grams(b, SHINGLE)
    x, y = np.unique(left), np.unique(right)
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    if len(x) == len(left) and len(y) == len(right):
        need = int(np.ceil(similarity / (1 + similarity) * (len(x) + len(y)) - 1e-9))
        most = (len(x) - need) // SHINGLE
        # An edit touches at most five k-mers, so few edits prove many common ones.
        if most >= 0 and edits_within(a, b, most) is not None:
            return True
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def _verified(similarity: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            held: dict[str, np.ndarray] = {}
            for i in range(len(batch)):
                pair = []
                for side in (2, 3):
                    text = batch.column(side)[i].as_py()
                    if text not in held:
                        if len(held) > 8:
                            held.clear()
                        data, offsets = words.text_buffer(pa.array([text]))
                        starts, ends, _ = words.word_bounds(data, offsets)
                        held[text] = words.word_hashes(data, starts, ends)
                    pair.append(held[text])
                good[i] = similar(pair[0], pair[1], similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], names=["a", "b", "linked"])

    return rows


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node it is connected to) for all nodes of the links (a, b); rounds double the reach and are written."""
    links = cut_lineage(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct())
    ways = cut_lineage(links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high"))))
    roots = cut_lineage(ways.groupBy(F.col("low").alias("node")).agg(F.min("high").alias("other")).select("node", F.least("node", "other").alias("root")))
    while True:
        near = ways.join(roots.select(F.col("node").alias("high"), F.col("root").alias("seen")), "high").select(F.col("low").alias("node"), F.col("seen").alias("root"))
        far = roots.alias("x").join(roots.alias("y"), F.col("x.root") == F.col("y.node")).select("x.node", "y.root")
        # A root also hears of the smaller roots next to its members.
        back = near.join(roots.select("node", F.col("root").alias("at")), "node").where("root < at").select(F.col("at").alias("node"), "root")
        fresh = roots.withColumn("was", F.col("root")).unionByName(near.unionByName(far).unionByName(back).withColumn("was", F.lit(None).cast("long")))
        fresh = cut_lineage(fresh.groupBy("node").agg(F.min("root").alias("root"), F.max("was").alias("was")))
        changed = not fresh.where("root < was").isEmpty()
        roots = fresh.select("node", "root")
        if not changed:
            return roots


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, sketches: int = 32, depth: int = 5, bands: int = 24, rows: int = 6
) -> DataFrame:
    """doc_id, content (digest of the text) and class_id (smallest doc_id of its near duplicates) of each distinct document."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("content"), "text")
    named = own.where("doc_id is not null")
    # One order for short texts and for the last step, so that the sample follows the input and not what is left then.
    recurring = docs.sparkSession.sparkContext.broadcast(recurring_grams(named))
    keyed = named.mapInArrow(_sketch_rows(sketches, depth, bands, rows, similarity, recurring), "doc_id long, content binary, keys array<long>, size long, mark binary")
    firsts = [F.min("doc_id").alias("rep"), F.min_by(F.struct("keys", "mark"), "doc_id").alias("own"), F.min("size").alias("size")]
    texts = cut_lineage(keyed.groupBy("content").agg(*firsts).select("content", "rep", "own.keys", "own.mark", "size"))
    nodes = texts.where("size > 0").join(texts.groupBy("rep").agg(F.min("content").alias("content")), ["rep", "content"])
    buckets = nodes.select(F.explode("keys").alias("bucket"), "rep")
    leaders = buckets.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("bucket", "lead")
    shared = cut_lineage(buckets.join(leaders, "bucket").select("bucket", "rep", "lead"))
    wanted = nodes.select("rep", "content").join(shared.select("rep").distinct(), "rep").select(F.col("rep").alias("doc_id"), "content")
    bodies = cut_lineage(
        own.where("doc_id is not null").join(wanted, ["doc_id", "content"]).groupBy(F.col("doc_id").alias("rep")).agg(F.first("text").alias("text"))
    )

    def verified(pairs: DataFrame) -> DataFrame:
        """Distinct pairs of representatives with the verdict; texts are joined only where signatures leave it open."""
        marked = (
            pairs.select("a", "b").distinct()
            .join(nodes.select(F.col("rep").alias("b"), F.col("mark").alias("mark_b")), "b")
            .join(nodes.select(F.col("rep").alias("a"), F.col("mark").alias("mark_a")), "a")
        )
        ruled = cut_lineage(marked.select("a", "b", "mark_a", "mark_b").mapInArrow(_ruled(similarity), "a long, b long, open boolean"))
        texted = (
            ruled.where("open").select("a", "b")
            .join(bodies.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
            .join(bodies.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        )
        judged = texted.select("a", "b", "text_a", "text_b").mapInArrow(_verified(similarity), "a long, b long, linked boolean")
        return cut_lineage(judged.unionByName(ruled.where("not open").select("a", "b", F.lit(False).alias("linked"))))

    # Everyone meets the smallest leader of all its buckets.
    seen = verified(shared.groupBy("rep").agg(F.min("lead").alias("a")).where("a < rep").select("a", F.col("rep").alias("b")))
    edges = cut_lineage(seen.where("linked").select("a", "b"))
    roots = components(edges)
    going, turn = shared.select("bucket", "rep"), 0
    while True:
        # In buckets that still hold several classes, everyone meets a leader drawn anew, unless they are of one class or have met.
        turn += 1
        placed = going.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
        drawn = F.min_by(F.struct("rep", "root"), F.xxhash64("bucket", "rep", F.lit(turn))).alias("lead")
        leads = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), drawn).where("low < high").select("bucket", "lead")
        met = placed.join(leads, "bucket").where("root <> lead.root").select("bucket", F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"))
        met = cut_lineage(met)
        fresh = verified(met.select("a", "b").join(seen.select("a", "b"), ["a", "b"], "left_anti"))
        seen = cut_lineage(seen.unionByName(fresh))
        linked = fresh.where("linked").select("a", "b")
        judged, links = fresh.agg(F.count("*"), F.count_if("linked")).first()
        if links:
            edges = cut_lineage(edges.unionByName(linked))
            roots = components(edges)
        if links <= judged * CLOSING:
            break
        # A bucket whose members don't link to its leader holds a passage, not a group; it waits for the last step.
        hit = met.join(linked, ["a", "b"], "left_semi").select("bucket").distinct()
        going = cut_lineage(going.join(hit, "bucket", "left_semi"))
    placed = shared.select("bucket", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    open_buckets = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    left = cut_lineage(placed.join(open_buckets.select("bucket"), "bucket").select("rep", "root").distinct())
    cross = partners(left.join(bodies, "rep"), similarity, recurring)
    third = verified(cross.join(seen.select("a", "b"), ["a", "b"], "left_anti"))
    roots = components(edges.unionByName(third.where("linked").select("a", "b")))
    classes = texts.select("content", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("content", F.coalesce("root", "rep").alias("class_id"))
    result = named.select("doc_id", "content").distinct().join(classes, "content")
    unnamed = own.where("doc_id is null").select("doc_id", "content", F.lit(None).cast("long").alias("class_id"))
    return result.select("doc_id", "content", "class_id").unionByName(unnamed)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stand for their class: one document of each group of near duplicates, and rows without an id."""
    classes = near_duplicates(docs, doc_id, text, similarity)
    gone = classes.where("doc_id is not null").groupBy("doc_id", "content").agg(F.min("class_id").alias("class_id")).where("doc_id <> class_id")
    content = F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")))
    return docs.join(gone, (docs[doc_id].cast("long") == gone["doc_id"]) & (content == gone["content"]), "left_anti")
