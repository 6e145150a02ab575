"""Task threads: assignment maps, episodes, roll-ups, absorption, consolidation answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators.profiles import first_distinct
from sessionloom.operators.segments import first_seen, top_ranked
from sessionloom.operators.sequence import islands, order_sessions

SESSION = "session_id"
ROOT = "canonical_root_id"


def thread_map(assignments: DataFrame, members: DataFrame, roots: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Leaf to provisional to canonical thread; an override of a leaf wins; unmapped leaves get ''.

    assignments: session_id, leaf_idx, provisional_root_id.  members: session_id, canonical_root_id,
    provisional_root_id.  roots: session_id, canonical_root_id, label, objective.
    """
    out = assignments.join(members.withColumnRenamed(ROOT, "_mapped"), [SESSION, "provisional_root_id"], "left")
    chosen = F.col("_mapped")
    if overrides is not None:
        out = out.join(overrides.select(SESSION, "leaf_idx", F.col(ROOT).alias("_override")), [SESSION, "leaf_idx"], "left")
        chosen = F.coalesce("_override", "_mapped")
    out = out.withColumn(ROOT, F.coalesce(chosen, F.lit(""))).drop("_mapped", "_override")
    name = F.coalesce(text.text_or_null(F.col("label")), text.text_or_null(F.col("objective")), F.col(ROOT))
    labels = roots.select(SESSION, ROOT, name.alias("canonical_root_label"))
    return out.join(labels, [SESSION, ROOT], "left").withColumn(
        "canonical_root_label", F.coalesce("canonical_root_label", F.lit(""))
    )


def episode_rows(assigned: DataFrame) -> DataFrame:
    """Each assigned leaf with the number of its episode: a maximal run of neighbouring leaves of one thread."""
    leaves = assigned.where(F.col(ROOT) != "").select(SESSION, ROOT, "leaf_idx").distinct()
    so = order_sessions(leaves, (SESSION, ROOT), "leaf_idx").neighbours(prev={"_prev": "leaf_idx"})
    so = islands(so, F.coalesce(F.col("_prev") + 1 != F.col("leaf_idx"), F.lit(True)), "episode_no")
    label = F.concat(F.col(ROOT), F.lit(".E"), F.col("episode_no").cast("string"))
    return so.df.drop("_prev").withColumn("episode_id", label)


def episodes(assigned: DataFrame) -> DataFrame:
    """One row per episode: first and last leaf, length."""
    return episode_rows(assigned).groupBy(SESSION, ROOT, "episode_no", "episode_id").agg(
        F.min("leaf_idx").alias("start_leaf_idx"), F.max("leaf_idx").alias("end_leaf_idx"), F.count(F.lit(1)).alias("n_leaves")
    )


def identity_consolidation(assignments: DataFrame) -> DataFrame:
    """One canonical thread per provisional one, numbered by first leaf."""
    first = assignments.groupBy(SESSION, "provisional_root_id").agg(F.min("leaf_idx").alias("first_leaf_idx"))
    so = order_sessions(first, SESSION, ("first_leaf_idx", "provisional_root_id")).index("_n", start=1)
    return so.df.select(SESSION, "provisional_root_id", "first_leaf_idx", F.concat(F.lit("C"), F.col("_n").cast("string")).alias(ROOT))


def apply_consolidation(answer_members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Canonical threads of an answer: known members only, ordered by their earliest leaf.

    answer_members: session_id, answer_root, provisional_root_id.
    """
    first = assignments.groupBy(SESSION, "provisional_root_id").agg(F.min("leaf_idx").alias("first_leaf_idx"))
    known = answer_members.distinct().join(first, [SESSION, "provisional_root_id"])
    order = known.groupBy(SESSION, "answer_root").agg(
        F.min("first_leaf_idx").alias("first_leaf_idx"), F.count(F.lit(1)).alias("n_members")
    )
    so = order_sessions(order, SESSION, ("first_leaf_idx", "answer_root")).index("_n", start=1)
    return so.df.withColumn(ROOT, F.concat(F.lit("C"), F.col("_n").cast("string"))).drop("_n")


def _first_values(rows: DataFrame, keys: list[str], items: str, keep: int, name: str) -> DataFrame:
    """First ``keep`` distinct items of an array column per thread, in leaf order."""
    spread = rows.select(*keys, "leaf_idx", F.posexplode(items).alias("_p", "_v"))
    spread = spread.withColumn("_at", F.struct("leaf_idx", "_p"))
    seen = first_seen(spread, keys, F.col("_v"), "_at")
    top = top_ranked(seen, keys, [F.col("first_at")], keep)
    return top.groupBy(*keys).agg(text.ordered_collect("first_at", "value").alias(name))


def sample_texts(rows: DataFrame, keys: list[str], value: Column, order: str, keep: int = 8) -> DataFrame:
    """Evenly spaced sample of a group's distinct texts without collecting the group.

    Ranks are running counts; only the chosen places and the first few distinct texts are collected.
    """
    seen = first_seen(rows, keys, value, order)
    ranked = order_sessions(seen.withColumn("_place", F.col("first_at").cast("double")), keys, ("_place", "value")).index("_pos").df
    size = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked.join(size, keys)
    last = F.col("_n") - 1
    if keep > 1:
        places = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.bround(i * last / F.lit(keep - 1)).cast("bigint"))
    else:
        places = F.array(F.lit(0).cast("bigint"))
    chosen = rows.where(F.array_contains(places, F.col("_pos")) | (F.col("_n") <= keep)).select(*keys, "_n", "_pos", "value", F.lit(0).alias("_turn"))
    norm = rows.withColumn("_norm", text.normalize(F.col("value"))).groupBy(*keys, "_n", "_norm").agg(
        F.min(F.struct("_pos", "value")).alias("_f")
    )
    spare = top_ranked(norm, keys, [F.col("_f._pos")], 2 * keep).select(*keys, "_n", "_f._pos", "_f.value", F.lit(1).alias("_turn"))
    few = chosen.unionByName(spare).groupBy(*keys, "_n").agg(
        F.array_sort(F.collect_list(F.struct("_turn", "_pos", "value"))).alias("_all")
    )
    everything = F.transform(F.filter("_all", lambda x: x["_turn"] == 0), lambda x: x["value"])
    spaced = F.slice(text._distinct_by_norm(F.col("_all")["value"]), 1, keep)
    return few.select(*keys, F.when(F.col("_n") <= keep, everything).otherwise(spaced).alias("samples"))


def roll_up(leaves: DataFrame, assigned: DataFrame) -> DataFrame:
    """Canonical thread profile: span, counts, first applications (8), entities (12), sample objectives (8)."""
    keys = [SESSION, ROOT]
    rows = assigned.where(F.col(ROOT) != "").select(*keys, "leaf_idx").join(leaves, [SESSION, "leaf_idx"])
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("leaf_count"),
        F.min("leaf_idx").alias("first_leaf_idx"),
        F.max("leaf_idx").alias("last_leaf_idx"),
        F.min_by("start_node_idx", "leaf_idx").alias("start_node_idx"),
        F.max_by("end_node_idx", "leaf_idx").alias("end_node_idx"),
    )
    apps = _first_values(rows, keys, "apps_used", 8, "apps_used")
    entities = _first_values(rows, keys, "entities", 12, "entities")
    samples = sample_texts(rows, keys, F.col("objective"), "leaf_idx", 8).withColumnRenamed("samples", "sample_leaf_objectives")
    count = episodes(assigned).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_episodes"))
    for part in (apps, entities, samples, count):
        base = base.join(part, keys, "left")
    empty = F.array().cast("array<string>")
    return base.withColumns({c: F.coalesce(c, empty) for c in ("apps_used", "entities", "sample_leaf_objectives")})


# How much of a thread its summary shows.
SHOWN = {"anchor": 5, "apps_used": 4, "entities": 6, "ocr_texts": 3}
SCREEN_CHARS = 240


def root_summaries(leaves: DataFrame, assigned: DataFrame) -> DataFrame:
    """One bounded row per thread for a prompt: span, counts, first applications, entities, anchors, screen texts, samples, first and last wording.

    Every list is the first few distinct values in leaf order (`profiles.first_distinct`), so no thread is collected; its episodes are rows of `episodes`.
    leaves: leaf_idx, objective, procedure_summary, apps_used, entities, ocr_texts.
    """
    keys = [SESSION, ROOT]
    own = assigned.where(F.col(ROOT) != "").select(*keys, "leaf_idx")
    rows = own.join(leaves, [SESSION, "leaf_idx"]).withColumn("anchor", text.infer_anchors(F.col("objective"), F.col("procedure_summary"), F.col("entities"), F.col("ocr_texts")))
    told = F.coalesce(text.text_or_null(F.col("procedure_summary")), F.col("objective"))
    first = F.concat(text.or_empty(F.col("objective")), F.lit(". "), text.or_empty(told))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("leaf_count"), F.min("leaf_idx").alias("first_leaf_idx"), F.max("leaf_idx").alias("last_leaf_idx"),
        text.limit_sentences(F.min_by(first, "leaf_idx"), 2, 320).alias("summary"), text.limit_sentences(F.max_by(told, "leaf_idx"), 1, 180).alias("last_update"),
    )
    spread = [rows.select(*keys, "leaf_idx", F.lit(c).alias("_list"), F.posexplode(c).alias("_p", "_value")) for c in SHOWN]
    values = reduce(DataFrame.unionByName, spread).where(text.filled(F.col("_value")))
    most = max(SHOWN.values())
    firsts = first_distinct(values, [*keys, "_list"], "_value", F.struct("leaf_idx", "_p"), most, "_values")
    packed = firsts.groupBy(*keys).agg(*(F.max(F.when(F.col("_list") == c, F.slice("_values", 1, k))).alias(c) for c, k in SHOWN.items()))
    samples = sample_texts(rows, keys, F.col("objective"), "leaf_idx", 8).withColumnRenamed("samples", "sample_leaf_objectives")
    count = episodes(assigned).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_episodes"))
    for part in (packed, samples, count):
        out = out.join(part, keys, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in (*SHOWN, "sample_leaf_objectives")})
    return out.withColumn("ocr_texts", F.transform("ocr_texts", lambda t: text.truncate(t, SCREEN_CHARS)))


def outputs(leaves: DataFrame, assigned: DataFrame) -> DataFrame:
    """Thread output counts: activities, distinct semantic actions, distinct raw actions, events."""
    keys = [SESSION, ROOT]
    rows = assigned.where(F.col(ROOT) != "").select(*keys, "leaf_idx").join(leaves, [SESSION, "leaf_idx"])
    base = rows.groupBy(*keys).agg(
        F.count_distinct("activity_id").alias("activity_count"), F.sum("event_count").alias("event_count"),
        F.min_by("activity_id", "leaf_idx").alias("first_activity_id"), F.max_by("activity_id", "leaf_idx").alias("last_activity_id"),
    )
    span = rows.select(*keys, F.explode(F.sequence("start_node_idx", "end_node_idx")).alias("_s"))
    semantic = span.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("semantic_action_count"))
    boundary = F.array_distinct(F.filter(F.array("start_action_id", "end_action_id"), text.filled))
    ids = F.when(F.size("raw_action_ids") > 0, F.col("raw_action_ids")).otherwise(boundary)
    raw = rows.select(*keys, F.explode(ids).alias("_r")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_action_count"))
    return base.join(semantic, keys, "left").join(raw, keys, "left")


def output_ids(leaves: DataFrame, assigned: DataFrame) -> DataFrame:
    """What a thread's output lists, one row per member: kind (activity, semantic, raw, application), id and its place by first appearance.

    A leaf without raw or semantic ids lists its border ids. Places are running counts of first appearances, so no thread is collected.
    """
    keys = [SESSION, ROOT]
    rows = assigned.where(F.col(ROOT) != "").select(*keys, "leaf_idx").join(leaves, [SESSION, "leaf_idx"])
    border = F.array_distinct(F.filter(F.array("start_action_id", "end_action_id"), text.filled))
    listed = {
        "activity": F.array("activity_id"), "semantic": F.col("semantic_action_ids"), "raw": F.when(F.size("raw_action_ids") > 0, F.col("raw_action_ids")).otherwise(border),
        "application": F.col("apps_used"),
    }
    parts = [rows.select(*keys, "leaf_idx", F.lit(kind).alias("kind"), F.posexplode(c).alias("_p", "id")) for kind, c in listed.items()]
    spread = reduce(DataFrame.unionByName, parts).where(text.filled(F.trim("id")))
    first = spread.groupBy(*keys, "kind", "id").agg(F.min(F.struct("leaf_idx", "_p")).alias("_at"))
    placed = first.select(*keys, "kind", "id", F.col("_at.leaf_idx").alias("_leaf"), F.col("_at._p").alias("_p"))
    return order_sessions(placed, (*keys, "kind"), ("_leaf", "_p", "id")).index("place", start=1).df.drop("_leaf", "_p")


def semantic_assignments(leaves: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per semantic action; short id lists reuse their first id, short texts the objective."""
    rows = leaves.join(assigned.select(SESSION, "leaf_idx", "provisional_root_id", ROOT, "canonical_root_label"), [SESSION, "leaf_idx"])
    spread = rows.select("*", F.posexplode(F.sequence("start_node_idx", "end_node_idx")).alias("_off", "semantic_action_idx"))
    ids, texts, place = F.col("semantic_action_ids"), F.col("semantic_actions"), F.col("_off") + 1
    return spread.select(
        SESSION, "leaf_idx", "semantic_action_idx",
        F.coalesce(F.try_element_at(ids, place), F.get(ids, 0), F.lit("")).alias("semantic_action_id"),
        F.coalesce(F.try_element_at(texts, place), F.col("objective")).alias("semantic_action"),
        "provisional_root_id", ROOT, "canonical_root_label",
    )


def micro_absorption(threads: DataFrame, leaves: DataFrame, max_actions: int = 3, max_distance: int = 2) -> DataFrame:
    """Leaves of one-leaf threads of few actions that move to a neighbouring thread.

    threads: session_id, canonical_root_id, leaf_count, first_leaf_idx, last_leaf_idx.  Neighbours are
    the threads before and after by first leaf; nearest wins, then the smaller, then the earlier one.
    """
    so = order_sessions(threads, SESSION, ("first_leaf_idx", ROOT)).neighbours(
        prev={"_p_root": ROOT, "_p_last": "last_leaf_idx", "_p_count": "leaf_count"},
        next={"_n_root": ROOT, "_n_first": "first_leaf_idx", "_n_count": "leaf_count"},
    )
    micro = so.df.where(F.col("leaf_count") == 1).join(
        leaves.select(SESSION, F.col("leaf_idx").alias("first_leaf_idx"), "num_actions"), [SESSION, "first_leaf_idx"]
    ).where(F.col("num_actions") <= max_actions)
    leaf = F.col("first_leaf_idx")

    def option(distance: Column, count: str, turn: int, root: str) -> Column:
        fits = distance.between(0, max_distance)
        return F.when(fits, F.struct(distance.alias("d"), F.col(count).alias("n"), F.lit(turn).alias("t"), F.col(root).alias("root")))

    best = F.least(option(leaf - F.col("_p_last"), "_p_count", 0, "_p_root"), option(F.col("_n_first") - leaf, "_n_count", 1, "_n_root"))
    return micro.select(SESSION, leaf.alias("leaf_idx"), F.col(ROOT).alias("from_root_id"), best["root"].alias(ROOT)).where(
        F.col(ROOT).isNotNull()
    )


def later_wins(*overrides: DataFrame) -> DataFrame:
    """Union of leaf overrides; for a leaf named twice the later table counts."""
    tagged = [o.select(SESSION, "leaf_idx", ROOT, F.lit(i).alias("_turn")) for i, o in enumerate(overrides)]
    merged = tagged[0]
    for part in tagged[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(SESSION, "leaf_idx").agg(F.max_by(ROOT, "_turn").alias(ROOT))


def thread_documents(threads: DataFrame, activities: DataFrame) -> DataFrame:
    """Thread members joined to their activities; ``missing`` marks ids without an activity.

    threads: session_id, canonical_root_id, position, activity_id.
    """
    rows = activities.select(SESSION, "activity_id", "objective", F.lit(True).alias("_known"))
    out = threads.join(rows, [SESSION, "activity_id"], "left")
    return out.withColumn("missing", F.col("_known").isNull()).drop("_known")


def manifest(documents: DataFrame) -> DataFrame:
    """Per thread: activities found and activities missing."""
    return documents.groupBy(SESSION, ROOT).agg(
        F.count_if(~F.col("missing")).alias("activity_count"), F.count_if("missing").alias("missing_activity_count")
    )


def default_thread(threads: DataFrame) -> DataFrame:
    """Thread with the most activities per session, the first one on ties."""
    rank = F.struct(F.col("activity_count"), -F.col("manifest_order"))
    return threads.groupBy(SESSION).agg(F.max_by(ROOT, rank).alias(ROOT))


# ---- checks of model answers -----------------------------------------------------------------


def check_partition(answer: DataFrame, expected: DataFrame, item: str, group: str, known_groups: DataFrame | None = None) -> DataFrame:
    """Findings per session when an answer should place every expected item exactly once.

    answer: session_id, item, group.  expected: session_id, item.  known_groups: session_id, group.
    """
    counts = answer.groupBy(SESSION, item).agg(F.count(F.lit(1)).alias("_n"))
    both = expected.select(SESSION, item, F.lit(True).alias("_e")).join(counts, [SESSION, item], "full")
    placed = both.groupBy(SESSION).agg(
        F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull()).alias("unknown_items"),
        F.count_if(F.col("_n") > 1).alias("repeated"),
    )
    if known_groups is None:
        return placed.withColumn("unknown_groups", F.lit(0).cast("bigint"))
    strange = answer.join(known_groups.select(SESSION, group).distinct(), [SESSION, group], "left_anti")
    strange = strange.groupBy(SESSION).agg(F.count(F.lit(1)).alias("unknown_groups"))
    return placed.join(strange, SESSION, "left").withColumn("unknown_groups", F.coalesce("unknown_groups", F.lit(0)))


def check_wording(answer: DataFrame, key: str, required: tuple[str, ...] = ("deliverable", "success_criteria")) -> DataFrame:
    """Per session: repeated ids and missing texts among new threads or updates."""
    blank = [F.count_if(~text.filled(F.trim(F.col(c)))).alias(f"missing_{c}") for c in required]
    return answer.groupBy(SESSION).agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated_ids"), *blank)
