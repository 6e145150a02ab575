"""Reading model answers: the JSON object inside free text, and typed fields of groups and merge ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.bind import let
from sessionloom.functions.text import strip, text_or_null


def _fenced(response: Column, opening: str) -> Column:
    """Text between the first opening fence and the next fence; null without one."""
    after = F.substr(response, F.instr(response, opening) + F.lit(len(opening)))
    return F.when(response.contains(opening), strip(F.substring_index(after, "```", 1)))


def json_object_text(response: Column) -> Column:
    """First of: ```json block, any block, whole text, outermost braces that is a JSON object; else '{}'."""

    def first_object(r: Column) -> Column:
        braces = text_or_null(F.regexp_extract(r, r"(?s)\{.*\}", 0))
        tried = F.array(_fenced(r, "```json"), _fenced(r, "```"), strip(r), braces)
        usable = F.filter(tried, lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False)))
        return F.coalesce(F.get(usable, 0), F.lit("{}"))

    return F.when(response.isNull(), "{}").otherwise(let(response, first_object))


def without_thinking(response: Column) -> Column:
    """Answer text after any thinking block."""
    return strip(F.regexp_replace(response, r"(?s)<think>.*?</think>", ""))


def _whole_number(item: Column, key: str) -> Column:
    return F.coalesce(item[key].try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def _ranges(json: Column, key: str, default: str, texts: tuple[str, ...]) -> Column:
    fields = ["start_idx", "end_idx", *texts]
    schema = f"struct<{key}: array<struct<{', '.join(f'{f}: string' for f in fields)}>>>"
    items = F.coalesce(F.from_json(json, schema)[key], F.from_json(F.lit("[]"), f"array<struct<{', '.join(f'{f}: string' for f in fields)}>>"))
    # A number that does not parse drops the whole entry; an absent one is 0.
    numeric = F.filter(items, lambda i: reduce(lambda a, b: a & b, [i[f].isNull() | i[f].try_cast("double").isNotNull() for f in ("start_idx", "end_idx")]))

    def shape(i: Column, place: Column) -> Column:
        text = F.coalesce(*[text_or_null(i[t]) for t in texts], F.lit(default))
        return F.struct(
            _whole_number(i, "start_idx").alias("start_idx"), place.cast("bigint").alias("range_order"), _whole_number(i, "end_idx").alias("end_idx"), text.alias("label")
        )

    return F.array_sort(F.transform(numeric, shape))


def parse_groups(json: Column) -> Column:
    """Groups of an answer, sorted by start; old and new text keys."""
    return _ranges(json, "segments", "Unclassified activity", ("objective", "semantic_action"))


def parse_merges(json: Column) -> Column:
    """Merge ranges of an answer, sorted by start."""
    return _ranges(json, "merge_actions", "", ("objective", "merged_semantic_action"))
