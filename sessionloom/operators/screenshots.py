"""Matching screenshots to actions: near in time, text in the path, each used once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import keys
from sessionloom.functions.timefn import base_name, path_epoch
from sessionloom.session import cut_lineage

SESSION = "session_id"


def parse_paths(shots: DataFrame) -> DataFrame:
    """Time, action text and tag of each path; a name with the part ``key`` keeps all of it as action."""
    name = base_name(F.col("path"))
    parts = F.split(name, "_")
    is_key = F.array_contains(parts, "key")
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "_")
    middle = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    return shots.withColumns(
        {
            "ss_time": path_epoch(F.col("path")),
            "ss_text": parts[0],
            "action": F.when(is_key, F.regexp_replace(rest, "[.jpg]+$", "")).otherwise(middle),
            "tag": F.when(is_key, "before").otherwise(F.split(F.element_at(parts, -1), r"\.")[0]),
        }
    )


def candidates(constituents: DataFrame, shots: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Every (event, screenshot) pair closer than ``tolerance`` whose path contains the event text.

    An equal join on time buckets: each event looks into its own bucket and the two beside it, so a
    pair is met once and only neighbours in time are ever compared.
    constituents: session_id, run_id, pos, ts, action.  shots: session_id, path.
    """
    bucket = lambda t: F.floor(t / F.lit(tolerance))
    events = constituents.withColumn("_b", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: bucket(F.col("ts")) + d)))
    pictures = shots.select(SESSION, "path", path_epoch(F.col("path")).alias("ss_time"), F.split(base_name(F.col("path")), "_")[0].alias("ss_text"))
    pictures = pictures.where(F.col("ss_time").isNotNull()).withColumn("_b", bucket(F.col("ss_time")))
    gap = F.abs(F.col("ss_time") - F.col("ts"))
    pairs = events.join(pictures, [SESSION, "_b"]).withColumn("gap", gap).where((gap < tolerance) & F.col("path").contains(F.col("action")))
    is_key = keys.is_key(F.col("action"))
    suits = lambda key_suffix, other: F.col("path").endswith(F.when(is_key, key_suffix).otherwise(other))
    return pairs.select(
        SESSION, "run_id", "pos", "ts", "path", "ss_time", "ss_text", "gap",
        suits("_first.jpg", "_before.jpg").alias("suits_before"), suits("_final.jpg", "_after.jpg").alias("suits_after"),
    )


ASK = [SESSION, "ask"]
SHOT = [SESSION, "path"]


def claim(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(session, ask, path) of every ask that gets a screenshot, and the number of rounds it took.

    pairs: session_id, ask (number in the order of claims), wish (a struct, smallest first), path.  In the recorder's order each ask takes its
    best screenshot that is still free.  The same comes out in rounds over all asks at once: every open ask wants its best screenshot, the
    smallest ask that wants one holds it, and larger asks can't get it any more, because a holder gives way to smaller asks only.  A
    screenshot that no smaller ask lists is settled and leaves with its ask.  Each round keys rows by ask, then by screenshot, never by session, and settles
    the first open ask of every group of rivals; rounds go on with contested rows only and are written, so a lost executor costs one round.
    """
    rival = Window.partitionBy(*SHOT)
    own = Window.partitionBy(*ASK)
    open_pairs, settled, rounds = pairs.select(*ASK, "wish", "path").withColumn("settled", F.lit(False)), [], 0
    while True:
        left = open_pairs.withColumn("_done", F.max("settled").over(own)).where(~F.col("_done")).withColumn("_best", F.min(F.struct("wish", "path")).over(own))
        wants = F.col("path") == F.col("_best.path")
        left = left.withColumns({"_holder": F.min(F.when(wants, F.col("ask"))).over(rival), "_first": F.min("ask").over(rival)})
        left = left.where(F.col("_holder").isNull() | (F.col("ask") <= F.col("_holder")))
        found = cut_lineage(left.select(*ASK, "wish", "path", (wants & (F.col("_first") == F.col("ask"))).alias("settled")))
        settled.append(found.where("settled").select(*ASK, "path"))
        rounds += 1
        if found.where("not settled").isEmpty():
            return reduce(DataFrame.unionByName, settled), rounds
        open_pairs = found


def claims(constituents: DataFrame, shots: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Wishes of every run: ask 2n is the before of run n, from its first event on, ask 2n + 1 its after, from its last event back."""
    wanted = candidates(constituents, shots, tolerance)
    side = lambda ask, pos, suits: F.struct((F.col("run_id") * 2 + ask).alias("ask"), F.struct(pos.alias("pos"), (~F.col(suits)).alias("unfit"), "gap", "ss_text").alias("wish"))
    sides = F.array(side(0, F.col("pos"), "suits_before"), side(1, -F.col("pos"), "suits_after"))
    return wanted.withColumn("_side", F.explode(sides)).select(SESSION, "_side.ask", "_side.wish", "path")


def match_states(runs: DataFrame, constituents: DataFrame, shots: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Before and after screenshot of every run (run_id), each screenshot used once, in the order of runs.

    runs: session_id, run_id.  constituents: session_id, run_id, pos, ts, action.  shots: session_id, path.
    """
    found, _ = claim(claims(constituents, shots, tolerance))
    side = lambda n: F.min(F.when(F.col("ask") % 2 == n, F.col("path")))
    claimed = found.groupBy(SESSION, F.floor(F.col("ask") / 2).alias("run_id")).agg(side(0).alias("before"), side(1).alias("after"))
    return runs.join(claimed, [SESSION, "run_id"], "left")


def missing_flags(entries: DataFrame, listing: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Flags for missing screenshots; a missing after counts only when a path was given."""
    known = listing.select(SESSION, "path").distinct()
    there = lambda side: known.select(SESSION, F.col("path").alias(side), F.lit(True).alias(f"_{side}_there"))
    out = entries.join(there(before), [SESSION, before], "left").join(there(after), [SESSION, after], "left")
    given = F.coalesce(F.col(after), F.lit("")) != ""
    return out.withColumns(
        {"missing_before": F.col(f"_{before}_there").isNull(), "missing_after": given & F.col(f"_{after}_there").isNull()}
    ).drop(f"_{before}_there", f"_{after}_there")


def annotated(shots: DataFrame, boxes: DataFrame) -> DataFrame:
    """Screenshots with their stored box, matched by file name within the session."""
    named = shots.withColumn("screenshot_path", base_name(F.col("path")))
    return named.join(boxes, [SESSION, "screenshot_path"])


def data_url(path: Column, content: Column) -> Column:
    """Image bytes as a data URL; anything but .png counts as JPEG."""
    mime = F.when(F.lower(path).endswith(".png"), "image/png").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
