"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets: each source's share of the wanted size by its weight, none above `limit` times the source's own size; what a full source leaves
is shared by weight among the others until none is above. Rates: of all document rates that meet a source's token target and stay
within [0, `limit`], those closest in relative entropy to one copy of each. They are exponentially tilted,
`min(limit, exp(l * size / mean size))`, with one dual variable `l` per source; the dual is convex and is solved by guarded Newton
steps for all sources at once, each step one distributed aggregate.

A rate depends only on source and size, so the steps run on the counts of (source, size), not on the documents. Rates become copies by systematic
rounding along the sizes: documents in order of size carry their fractions on, so a source's words miss its target by a fraction
of one document. The order is cut into bins of neighbouring sizes, large ones also by a hash, and bins hand on their sums; no task orders a
whole source. Sums are of integers (units of 2**-30), so reruns agree bit for bit.

Defined results: a null text has size 0; a null source is a source of its own, last in the order; documents of size 0 are taken 0 words
and 0 or more copies, which change nothing; a source whose target equals the limit takes every document `limit` times; a source of size 0 has target 0; repeated
rows are documents of their own (equal ids are told apart by text, equal texts share one rounding); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.session import cut_lineage

UNIT = 1 << 30
WEIGHTS = (5, 2, 1)
#: Starting points tried for the rounding of each source.
PHASES = 16


def size_of(text: Column) -> Column:
    """Number of words: runs of characters other than space and 0x09-0x0D."""
    tidy = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(tidy == "", 0).otherwise(F.length(tidy) - F.length(F.replace(tidy, F.lit(" "))) + 1).cast("long")


def targets(counts: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """source, weight, source_size, target of every source. counts: source, size, n. Sources are few beside documents: one row each."""
    own = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    own = own.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (turn + 1).cast("int")))
    own = cut_lineage(own)
    full = cut_lineage(own.where("false").select("source"))
    while True:
        open_ = F.coalesce("full", F.lit(False))
        marked = own.join(full.select(F.col("source").alias("other"), F.lit(True).alias("full")), F.col("source").eqNullSafe(F.col("other")), "left")
        totals = marked.agg(
            (F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share)).alias("wanted"),
            F.coalesce(F.sum(F.when(open_, F.col("source_size") * limit)), F.lit(0.0)).alias("held"),
            F.sum(F.when(~open_, F.col("weight"))).alias("weights"),
            F.sum(open_.cast("long")).alias("n_full"),
        ).first()
        rate = (totals["wanted"] - totals["held"]) / totals["weights"] if totals["weights"] else 0.0
        target = F.when(open_, F.col("source_size") * limit).otherwise(F.col("weight") * F.lit(float(rate)))
        shared = marked.select("source", "weight", "source_size", "n", target.alias("target"))
        above = shared.where(F.col("target") >= F.col("source_size") * limit).select("source")
        if above.count() <= (totals["n_full"] or 0):
            return shared
        full = cut_lineage(above)


def tilts(counts: DataFrame, goals: DataFrame, limit: float, rounds: int = 60) -> DataFrame:
    """source, tilt: the dual variable of every source; null where every document is taken `limit` times or not at all."""
    solved = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * limit)
    state = goals.where(solved).select(
        "source", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high")
    )
    state = cut_lineage(state)
    for _ in range(rounds):
        met = counts.join(state.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
        x = F.col("size") / F.col("mean")
        rate = F.least(F.exp(F.least(F.col("tilt") * x, F.lit(60.0))), F.lit(limit))
        words = F.col("size") * F.col("n")
        # Integer units make the sums independent of their order.
        sums = met.groupBy("own").agg(
            F.sum((words * rate * 1024).cast("decimal(30,0)")).alias("taken"),
            F.sum(F.when(rate < limit, words * rate * x * 1024).otherwise(0.0).cast("decimal(30,0)")).alias("slope"),
            *(F.first(c).alias(c) for c in ("target", "mean", "tilt", "low", "high")),
        )
        miss = F.col("taken").cast("double") / 1024 - F.col("target")
        low, high = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")), F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / (F.col("slope").cast("double") / 1024)
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        middle = F.when((low == -700) | (high == 700), F.when(miss < 0, F.greatest(F.col("tilt") * 2, F.lit(1.0))).otherwise(F.least(F.col("tilt") * 2, F.lit(-1.0)))).otherwise((low + high) / 2)
        near = F.abs(miss) <= F.greatest(F.col("target") * 1e-7, F.lit(0.01))
        state = cut_lineage(sums.select(
            F.col("own").alias("source"), "target", "mean", F.when(near, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"),
            low.alias("low"), high.alias("high"), near.alias("near"),
        ))
        if state.where(~F.col("near")).isEmpty():
            break
    return state.select("source", "tilt", "mean")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
    limit: int = 2, bin_rows: int = 20_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (words with repeats) of every row."""
    own = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("check")
    )
    own = cut_lineage(own)
    counts = cut_lineage(own.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = targets(counts, weights, share, float(limit))
    solved = tilts(counts, goals, float(limit))
    rated = goals.select(F.col("source").alias("of"), "source_size", "target").join(
        solved.select(F.col("source").alias("for"), "tilt", "mean"), F.col("of").eqNullSafe(F.col("for")), "left"
    )
    free = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(60.0))), F.lit(float(limit)))
    rate = F.when(F.col("tilt").isNotNull(), free).when(F.col("target") > 0, float(limit)).otherwise(0.0)
    # One row per source and size: its rate, and the bin of neighbouring sizes it lies in.
    shares = counts.join(rated, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "n", "source_size", "target", rate.alias("rate"))
    part = F.floor((F.col("rate") - F.floor("rate")) * UNIT).cast("long")
    shares = shares.withColumn("band", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")).withColumn("part", part)
    bands = shares.groupBy("source", "band").agg(F.sum("n").alias("rows"))
    cuts = bands.select(F.col("source").alias("s"), F.col("band").alias("b"), F.ceil(F.col("rows") / bin_rows).cast("long").alias("cuts"))
    shares = cut_lineage(shares.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b"))).drop("s", "b"))
    s = shares.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "rate", "part", "band", "cuts")
    rows = own.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    rows = cut_lineage(rows.withColumn("cut", F.pmod(F.xxhash64("doc_id", "check"), F.col("cuts"))))
    bins = rows.groupBy("source", "band", "cut").agg(F.sum("part").alias("sum"))
    before = Window.partitionBy("source").orderBy("band", "cut").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("s"), F.col("band").alias("b"), F.col("cut").alias("c"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("source", "band", "cut").orderBy("size", "doc_id", "check").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("along", F.sum("part").over(inner)).join(
        bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")) & (F.col("cut") == F.col("c"))
    )
    placed = cut_lineage(placed.drop("s", "b", "c"))

    def extra(phase: Column | int) -> Column:
        upto = F.col("offset") + F.col("along") + phase
        return (upto.cast("decimal(38,0)") - F.pmod(upto, F.lit(UNIT)) - (upto - F.col("part")) + F.pmod(upto - F.col("part"), F.lit(UNIT))) / UNIT

    def copied(phase: Column | int) -> Column:
        return F.floor("rate").cast("long") + extra(phase).cast("long")

    # Of a few starting phases, each source takes the one that comes nearest to its target.
    phases = [i * (UNIT // PHASES) for i in range(PHASES)]
    misses = [F.abs(F.sum(copied(p) * F.col("size")) - F.first("target")).alias(f"p{i}") for i, p in enumerate(phases)]
    tried = placed.groupBy("source").agg(*misses)
    best = F.array_min(F.array(*(F.struct(F.col(f"p{i}").alias("miss"), F.lit(p).cast("long").alias("phase")) for i, p in enumerate(phases))))["phase"]
    placed = placed.join(tried.select(F.col("source").alias("s"), best.alias("phase")), F.col("source").eqNullSafe(F.col("s")))
    copies = copied(F.col("phase"))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "check"
    )
