"""Line and document sources.  Files are read in splits; a line keeps its place by (split start, row in split)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import schemas
from sessionloom.functions.text import filled, text_or_null
from sessionloom.functions.timefn import coerce_epoch
from sessionloom.operators import keyset
from sessionloom.operators.resume import last_wins

SESSION = "session_id"


def session_of_path(path: Column) -> Column:
    """The folder a file lies in names the session."""
    return F.element_at(F.split(path, "/"), -2)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """session_id, file, split_start, split_row, value for every line; big files stay splittable.

    Rows of one file are in file order under (split_start, split_row).
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"))
    return lines.withColumns({"split_row": F.monotonically_increasing_id(), SESSION: session_of_path(F.col("file"))})


def line_order() -> Column:
    return F.struct("split_start", "split_row")


def json_objects(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Lines that are JSON objects, and the others.  Blank lines are skipped.

    Strict: reading a bad line fails and names its file and place (byte where the split starts, row within it).  Otherwise the second table lists bad lines.
    """
    kept = lines.where(F.length(F.trim("value")) > 0)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    if not strict:
        return kept.where(is_object), kept.where(~is_object)
    message = F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(" at "), F.concat_ws("+", F.col("split_start").cast("string"), F.col("split_row").cast("string")), F.lit(": "), F.substring("value", 1, 200))
    checked = kept.withColumn("value", F.when(is_object, F.col("value")).otherwise(F.raise_error(message)))
    return checked, kept.where(F.lit(False))


def parse_objects(lines: DataFrame, schema: str) -> DataFrame:
    """Fields of the given schema beside the line's own columns."""
    return lines.withColumn("_o", F.from_json("value", schema)).select("*", "_o.*").drop("_o", "value")


def raw_events(objects: DataFrame) -> DataFrame:
    """Raw log rows with a text and a time, as session_id, action, ts and the line order columns."""
    rows = parse_objects(objects, schemas.RAW_LINE)
    rows = rows.where(F.col("content").isNotNull() & F.col("timestamp").isNotNull())
    return rows.select(SESSION, "split_start", "split_row", F.col("content").alias("action"), F.col("timestamp").cast("double").alias("ts"))


def legacy_events(observations: DataFrame) -> DataFrame:
    """Older tables: session_id, id, content, created_at; order is (created_at, id)."""
    return observations.select(
        SESSION, F.lit(0).cast("bigint").alias("split_start"), F.col("id").cast("bigint").alias("split_row"),
        F.col("content").cast("string").alias("action"), coerce_epoch(F.col("created_at")).alias("ts"),
    )


def prefer(*tables: DataFrame, key: str = SESSION) -> DataFrame:
    """Rows of the first table that knows the session, else of the next one."""
    out = tables[0]
    known = tables[0].select(key).distinct()
    for table in tables[1:]:
        out = out.unionByName(table.join(known, key, "left_anti"), allowMissingColumns=True)
        known = known.unionByName(table.select(key)).distinct()
    return out


def sessions_without(sessions: DataFrame, *tables: DataFrame) -> DataFrame:
    """Sessions that no source covers."""
    out = sessions.select(SESSION).distinct()
    for table in tables:
        out = out.join(table.select(SESSION), SESSION, "left_anti")
    return out


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One JSON document per file (an object, else the read fails): session_id, file, value."""
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    named = files.withColumn(SESSION, session_of_path(F.col("file")))
    return json_objects(named)[0]


def read_bounding_boxes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stored boxes by screenshot file name, the last line winning."""
    rows = parse_objects(json_objects(read_lines(spark, paths))[0], schemas.BOUNDING_BOX)
    return last_wins(rows.drop("file"), [SESSION, "screenshot_path"], line_order())


def list_screenshots(spark: SparkSession, folder: str) -> DataFrame:
    """Screenshot paths without reading the pictures."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(folder)
    return files.select("path").withColumn(SESSION, F.element_at(F.split("path", "/"), -3))


def read_trajectory(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """Typed action rows. Strict: a row with an unknown field, or without id or action, fails the read and names its place.

    Otherwise ``value`` tells what the row held, for `keyset.key_findings`.
    """
    objects = json_objects(read_lines(spark, paths))[0]
    if strict:
        where = F.concat(F.col("file"), F.lit(" at "), F.concat_ws("+", F.col("split_start").cast("string"), F.col("split_row").cast("string")))
        objects = keyset.strict(objects, keyset.TRAJECTORY, where)
    return objects.withColumn("_o", F.from_json("value", schemas.TRAJECTORY)).select("*", "_o.*").drop("_o")


def action_trace(rows: DataFrame) -> DataFrame:
    """Grounded rows as an action trace: only actions, ids and texts with their fallbacks; error rows stay.

    rows: idx and any of id, node_id, provenounce_id, row_type, node_type, action, goal, ... as text.
    """
    have = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    not_meta = F.coalesce(have("row_type") != "meta", F.lit(True)) & F.coalesce(have("node_type") != "sequence", F.lit(True))
    is_node = F.coalesce(have("row_type") == "node", F.lit(False)) & F.coalesce(have("node_type") != "action", F.lit(False))
    idx = F.col("idx").cast("string")
    parts = F.concat_ws(
        " | ", text_or_null(have("goal")),
        F.concat(F.lit("Active application: "), text_or_null(have("active_application"))),
        F.concat(F.lit("Visible content: "), text_or_null(have("visual_content"))),
    )
    row_id = F.coalesce(*[F.nullif(have(c), F.lit("")) for c in ("id", "node_id", "provenounce_id", "provenance_id")], F.concat(F.lit("row_"), idx))
    action = F.coalesce(text_or_null(have("action")), F.nullif(parts, F.lit("")), F.concat(F.lit("action_"), idx))
    given = have("original_index").try_cast("bigint")
    screen = F.coalesce(text_or_null(have("md_results")), text_or_null(F.get_json_object(have("ocr_results"), "$.md_results")))
    visible = text_or_null(have("visual_content"))
    return rows.where(not_meta & ~is_node).select(
        SESSION, "idx", row_id.alias("action_id"), action.alias("action"),
        F.when(given >= 0, given).otherwise(F.col("idx")).cast("bigint").alias("original_index"),
        text_or_null(have("status")).alias("status"), text_or_null(have("goal")).alias("goal"), text_or_null(have("active_application")).alias("active_application"),
        visible.alias("grounded_visual_content"), visible.alias("visual_content"), screen.alias("md_results"),
        text_or_null(have("state_before")).alias("state_before"), text_or_null(have("state_after")).alias("state_after"),
    )


ACTIVITY_PREFIXES = "^(local_objective_|subgoal_segment_)"


def activity_rows(objects: DataFrame) -> DataFrame:
    """Stored activities with old field names and id prefixes translated.  objects: session_id, value."""
    get = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    named = get("activity_id", "subgoal_segment_id", "local_objective_id")
    strings = lambda name: F.coalesce(F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
    number = lambda name, default: F.coalesce(F.get_json_object("value", f"$.{name}").try_cast("bigint"), F.lit(default))
    return objects.select(
        *[c for c in objects.columns if c != "value"],
        F.regexp_replace(named, ACTIVITY_PREFIXES, "activity_").alias("activity_id"),
        F.coalesce(get("objective"), F.lit("")).alias("objective"),
        F.coalesce(get("additional_context", "detail_brief"), F.lit("")).alias("additional_context"),
        number("start_semantic_action_idx", -1).alias("start_semantic_action_idx"), number("end_semantic_action_idx", -1).alias("end_semantic_action_idx"),
        *[strings(n).alias(n) for n in ("semantic_action_ids", "raw_action_ids", "apps_used", "entities", "ocr_texts")],
        number("event_count", 0).alias("event_count"),
    )


def activities_by_id(rows: DataFrame, order: Column) -> DataFrame:
    """Activities keyed by id; blank ids drop, the last row of an id wins."""
    return last_wins(rows.where(filled(F.trim("activity_id"))), [SESSION, "activity_id"], order)


LEAF_LISTS = ["activities", "subgoal_segments", "leaf_latent_tasks", "segments"]


def leaf_values(documents: DataFrame) -> DataFrame:
    """Leaves of a stored document: a JSON list, or an object holding one under a known key; place is leaf_idx."""
    is_list = F.ltrim("value").startswith("[")
    lists = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in LEAF_LISTS])
    items = F.from_json(F.when(is_list, F.col("value")).otherwise(lists), "array<variant>")
    spread = documents.select(SESSION, F.posexplode(items).alias("_p", "_v"))
    return spread.select(SESSION, F.col("_p").cast("bigint").alias("leaf_idx"), F.to_json("_v").alias("value"))


def leaf_rows(leaves: DataFrame) -> DataFrame:
    """Thread leaves with all their fallbacks.  leaves: session_id, leaf_idx, value (JSON object)."""
    get = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{n}"), F.lit("")) for n in names])
    whole = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}").try_cast("bigint") for n in names])
    non_negative = lambda c, default: F.when(c >= 0, c).otherwise(F.lit(default))
    start, end = whole("start_semantic_action_idx", "start_node_idx"), whole("end_semantic_action_idx", "end_node_idx")
    rows = activity_rows(leaves)
    extra = leaves.select(
        SESSION, "leaf_idx",
        F.coalesce(get("activity_id", "latent_leaf_objective_id"), F.format_string("subgoal_segment_%04d", "leaf_idx")).alias("activity_id"),
        F.trim(F.coalesce(get("objective", "leaf_latent_task", "subgoal"), F.lit("Unclassified step"))).alias("objective"),
        F.trim(F.coalesce(get("procedure_summary", "additional_context", "detail_brief"), F.lit(""))).alias("procedure_summary"),
        F.coalesce(start, F.lit(-1)).alias("start_node_idx"), F.coalesce(end, F.lit(-1)).alias("end_node_idx"),
        F.coalesce(non_negative(whole("num_actions", "event_count", "semantic_action_count"), 0), F.lit(0)).alias("num_actions"),
        F.coalesce(get("pre_state"), F.lit("")).alias("pre_state"), F.coalesce(get("post_state"), F.lit("")).alias("post_state"),
    )
    lists = rows.select(SESSION, "leaf_idx", "semantic_action_ids", "raw_action_ids", "apps_used", "entities", "ocr_texts", "event_count")
    return extra.join(lists, [SESSION, "leaf_idx"])


def complete_evidence(activities: DataFrame) -> DataFrame:
    """Stored evidence lists, then what the source actions add; states fall back to the source actions.

    activities: apps_used, entities, raw_action_ids, ocr_texts, pre_state, post_state and source_actions
    array<struct<action_id, active_application, grounded_visual_content, visual_content, md_results, state_before, state_after>>.
    """
    from sessionloom.functions.text import unique_texts

    src = F.coalesce(F.col("source_actions"), F.slice("source_actions", 1, 0))
    pick = lambda field: F.transform(src, field)
    grounded = lambda a: F.coalesce(F.nullif(a["grounded_visual_content"], F.lit("")), a["visual_content"])
    first = lambda values: F.get(F.filter(values, filled), 0)
    add = {
        "apps_used": pick(lambda a: a["active_application"]), "entities": pick(grounded),
        "raw_action_ids": pick(lambda a: a["action_id"]), "ocr_texts": pick(lambda a: a["md_results"]),
    }
    lists = {name: unique_texts(F.concat(F.coalesce(name, F.array().cast("array<string>")), more)) for name, more in add.items()}
    before, after = first(pick(lambda a: a["state_before"])), first(F.reverse(pick(lambda a: a["state_after"])))
    states = {
        "pre_state": F.coalesce(text_or_null(F.col("pre_state")), before, F.lit("")),
        "post_state": F.coalesce(text_or_null(F.col("post_state")), after, F.lit("")),
    }
    return activities.withColumns(lists | states)


# ---- files of threads and models -------------------------------------------------------------


def resolve_inputs(sessions: DataFrame, listing: DataFrame, names: list[str]) -> DataFrame:
    """The first of several file names that each session's folder has: session_id, path, name, found.

    A session without any of them gets the first name in its own folder and found = false. An absolute first name (with a slash in front or a scheme) is looked up as it
    is. sessions: session_id, folder. listing: path, without contents.
    """
    turns = F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(n).alias("name")) for i, n in enumerate(names)))
    wanted = sessions.select(SESSION, "folder", F.explode(turns).alias("_w")).select(SESSION, "_w.turn", "_w.name", in_folder(F.col("folder"), F.col("_w.name")).alias("path"))
    there = wanted.join(listing.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    best = there.groupBy(SESSION).agg(F.min(F.struct(F.col("_there").isNull().alias("absent"), "turn", "path", "name")).alias("_b"))
    return best.select(SESSION, "_b.path", "_b.name", (~F.col("_b.absent")).alias("found"))


def in_folder(folder: Column, name: Column) -> Column:
    """A file of a folder, unless the name is absolute."""
    return F.when(name.startswith("/") | name.contains("://"), name).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), name))


def manifest_inputs(manifests: DataFrame, listing: DataFrame) -> DataFrame:
    """Thread files named by the session's manifest; sessions without one use every plain document listed.

    manifests: session_id, value with roots[].file.  listing: session_id, file_name.
    """
    named = manifests.select(SESSION, F.explode(F.from_json(F.get_json_object("value", "$.roots"), "array<struct<file: string, canonical_root_id: string>>")).alias("r"))
    wanted = named.select(SESSION, F.col("r.file").alias("file_name")).join(listing, [SESSION, "file_name"])
    plain = listing.where(F.col("file_name").endswith(".json") & ~F.col("file_name").rlike("(^manifest|meta|hierarchy)"))
    return prefer_sessions(wanted, plain, manifests)


def prefer_sessions(first: DataFrame, second: DataFrame, decided_by: DataFrame) -> DataFrame:
    """``first`` for the sessions of ``decided_by``, ``second`` for the others."""
    return first.unionByName(second.join(decided_by.select(SESSION).distinct(), SESSION, "left_anti").select(*first.columns))


def merged_roots(documents: DataFrame, model_key: str) -> DataFrame:
    """Roots of merged outputs that succeeded and hold a model.  documents: session_id, value."""
    roots = F.from_json(F.get_json_object("value", "$.roots"), "array<variant>")
    rows = documents.select(SESSION, F.posexplode(roots).alias("root_order", "_v"))
    get = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    model = F.to_json(F.try_variant_get("_v", f"$.{model_key}", "variant"))
    return rows.where(F.coalesce(get("ok", "boolean"), F.lit(False)) & model.isNotNull()).select(
        SESSION, "root_order", get("root_id", "string").alias("root_id"), model.alias("model")
    )


def with_source(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the source they name, resolved against their own folder.

    documents: session_id, file, value.  sources: file, value.
    """
    named = F.get_json_object("value", "$.source_file")
    folder = F.regexp_replace("file", "[^/]+$", "")
    resolved = F.when(named.startswith("/") | named.contains("://"), named).otherwise(F.concat(folder, named))
    other = sources.select(F.col("file").alias("_file"), F.col("value").alias("source_value"))
    return documents.withColumn("_file", resolved).join(other, "_file", "left").drop("_file")
