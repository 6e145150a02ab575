"""Zero-padded ids and id ranges: activity_0001-activity_0004."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.bind import let

ACTIVITY = ("activity",)
ACTIVITY_AND_SEGMENT = ("activity", "subgoal_segment")


def padded(prefix: str, number: Column, width: int = 4) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def id_number(ref: Column) -> Column:
    """Integer at the end of an id."""
    return F.regexp_extract(ref, r"_(\d+)$", 1).try_cast("int")


def expand_range(ref: Column, prefixes: tuple[str, ...] = ACTIVITY_AND_SEGMENT, digits: str = "{4,}") -> Column:
    """Array of ids behind one reference; null when it is malformed or runs backwards.

    The prefix must be repeated on the right side.  ``digits`` is the regular-expression count of
    the number: ids are padded to four digits, past 9999 they grow ("+" accepts any width and pads to the width of the left number).
    """
    pattern = rf"^({'|'.join(prefixes)})_(\d{digits})(?:-\1_(\d{digits}))?$"
    # One regular expression a reference, none an id: a reference that fits is cut at its hyphen and its last underscores.
    # Like the pattern's end, it allows one line break.
    whole = F.rtrim(ref, F.lit("\r\n\u0085\u2028\u2029"))
    left = F.substring_index(whole, "-", 1)
    first, last = F.substring_index(left, "_", -1), F.substring_index(whole, "_", -1)
    start, end = first.try_cast("int"), last.try_cast("int")
    parts = F.struct(F.left(left, F.length(left) - F.length(first)).alias("head"), F.length(first).alias("width"), start.alias("start"), end.alias("end"))

    def spread(p: Column) -> Column:
        text = lambda n: n.cast("string")
        one = lambda n: F.concat(p["head"], F.lpad(text(n), F.greatest(p["width"], F.length(text(n))), F.lit("0")))
        return F.when(p["start"] <= p["end"], F.transform(F.sequence(p["start"], p["end"]), one))

    # A single id stands for itself.
    alone = F.when(last.try_cast("int").isNotNull(), F.array(whole))
    return F.when(ref.rlike(pattern), F.when(whole.contains("-"), let(parts, spread)).otherwise(alone))


def range_size(ref: Column) -> Column:
    """Number of ids that `expand_range` can make of a reference, without making them; 1 for anything that is no range."""
    whole = F.rtrim(ref, F.lit("\r\n\u0085\u2028\u2029"))
    end = F.substring_index(whole, "_", -1).try_cast("bigint")
    start = F.substring_index(F.substring_index(whole, "-", 1), "_", -1).try_cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(end - start + 1, F.lit(1).cast("bigint")))


def range_text(prefix: Column | str, start: Column, end: Column) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    one = lambda n: F.concat(prefix, F.lit("_"), F.lpad(n.cast("string"), F.greatest(F.lit(4), F.length(n.cast("string"))), F.lit("0")))
    return F.when(start == end, one(start)).otherwise(F.concat(one(start), F.lit("-"), one(end)))
