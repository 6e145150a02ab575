"""Text columns: clipping, normalizing, anchors, samples, thread-leaf wording."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.bind import let

# White space as Python's str methods and regular expressions see it.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Words that name a user-interface control rather than a result.
CONTROL_WORDS = ["button", "checkbox", "dialog", "dropdown", "field", "icon", "link", "menu", "tab", "toolbar"]


_NOT_BLANK = SPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")
# Runs that are not already one blank; single blanks, the common case, are left alone.
_UNEVEN_SPACE = f"(?: {SPACE}+|{_NOT_BLANK}{SPACE}*)"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _UNEVEN_SPACE, " "))


def text_or_null(c: Column) -> Column:
    """Trimmed text; empty counts as missing."""
    return F.nullif(strip(c), F.lit(""))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


# The limits below name the text once, so a long text is cleaned once however it is used. What shows is decided on the clean text's first characters,
# so the expressions that cut never walk through the rest.


def truncate(c: Column, max_chars: int = 180) -> Column:
    text = strip(F.replace(or_empty(c), F.lit("\n"), F.lit(" ")))
    return F.regexp_replace(F.substring(text, 1, max_chars + 1), rf"(?s)^(.{{{max_chars - 3}}}).{{4}}$", "$1...")


def clip(c: Column, max_chars: int) -> Column:
    """Collapsed text; when cut, the part before the dots ends in no space."""
    keep = max(1, max_chars - 3)
    return F.regexp_replace(F.substring(collapse(or_empty(c)), 1, max_chars + 1), rf"^(?=.{{{max_chars + 1}}})((?:.{{0,{keep - 1}}}[^ ])?).*$", "$1...")


def limit_sentences(c: Column, max_sentences: int, max_chars: int) -> Column:
    """First sentences, then truncated.  Text past the limit cannot show, so sentences are split before it only."""
    head = F.substring(collapse(or_empty(c)), 1, max_chars + 2)
    sentences = F.slice(F.split(head, r"(?<=[.!?]) +"), 1, max_sentences)
    return truncate(F.array_join(F.filter(sentences, lambda s: s != ""), " "), max_chars)


def normalize(c: Column) -> Column:
    return F.lower(collapse(or_empty(c)))


def slug(c: Column, fallback: Column) -> Column:
    # 81 letters or digits decide the first 80 places.
    head = F.regexp_extract(F.lower(strip(c)), "^(?:[^A-Za-z0-9]*+[A-Za-z0-9]){0,81}+", 0)
    cleaned = F.regexp_replace(F.regexp_replace(head, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.substring(cleaned, 1, 80)
    return F.when(cut == "", fallback).otherwise(cut)


# ---- arrays of texts -------------------------------------------------------------------------


def unique_texts(items: Column) -> Column:
    """Trimmed, non-empty, first occurrence kept, order kept."""
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: strip(or_empty(x)))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def ordered_collect(order: Column | str, value: Column | str) -> Column:
    """Aggregate: values in the given order, duplicates kept, nulls dropped."""
    order = F.col(order) if isinstance(order, str) else order
    value = F.col(value) if isinstance(value, str) else value
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def ordered_distinct(order: Column | str, value: Column | str) -> Column:
    """Aggregate: ordered distinct non-empty texts (for groups of bounded size)."""
    return unique_texts(ordered_collect(order, value))


def _distinct_by_norm(items: Column) -> Column:
    """First item for every normalized text, order kept."""
    pairs = F.transform(items, lambda x: F.struct(x.alias("item"), normalize(x).alias("norm")))
    first = lambda ps: F.filter(
        ps, lambda p, i: (p["norm"] != "") & (F.array_position(ps["norm"], p["norm"]) == i + 1)
    )
    return let(pairs, first)["item"]


def concise_anchors(items: Column, max_items: int = 5) -> Column:
    """Cleaned anchors of at most 80 characters, distinct by normalized text."""
    cleaned = F.transform(unique_texts(items), lambda x: F.btrim(F.regexp_replace(x, f"{SPACE}+", " "), F.lit(" ,;")))
    return F.slice(_distinct_by_norm(F.filter(cleaned, lambda x: (x != "") & (F.length(x) <= 80))), 1, max_items)


JOINED_WORDS = r"(?U)\b[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+){1,}\b"
CAMEL_WORDS = r"(?U)\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b"


def infer_anchors(objective: Column, summary: Column, entities: Column, ocr_texts: Column, max_items: int = 3) -> Column:
    """Joined tokens (a-b, a_b, a/b) first, then CamelCase words, then entities until full."""
    parts = F.concat(F.array(or_empty(objective), or_empty(summary)), entities, F.slice(ocr_texts, 1, 2))
    text = F.array_join(F.filter(parts, filled), " ")
    found = let(
        text,
        lambda t: F.array_distinct(
            F.concat(F.regexp_extract_all(t, F.lit(JOINED_WORDS), F.lit(0)), F.regexp_extract_all(t, F.lit(CAMEL_WORDS), F.lit(0)))
        ),
    )
    short = F.array_distinct(F.filter(F.transform(entities, lambda e: truncate(e, 60)), lambda e: e != ""))

    def top_up(f: Column) -> Column:
        room = F.greatest(F.lit(0), F.lit(max_items) - F.size(f))
        return F.concat(f, F.slice(F.array_except(short, f), F.lit(1), room))

    return concise_anchors(let(found, top_up), max_items)


def deliverable(entities: Column, objective: Column) -> Column:
    """Last entity that names no control, else the objective."""
    controls = F.array(*[F.lit(w) for w in CONTROL_WORDS])
    plain = F.filter(
        entities, lambda e: ~F.arrays_overlap(F.regexp_extract_all(F.lower(e), F.lit("[a-z]+"), F.lit(0)), controls)
    )
    return truncate(F.when(F.size(plain) > 0, F.element_at(plain, -1)).otherwise(objective), 220)


def success_criterion(entities: Column, objective: Column, ocr_texts: Column) -> Column:
    seen = F.concat(F.lit(' Use visible text such as "'), truncate(F.try_element_at(ocr_texts, F.lit(-1)), 100), F.lit('" as evidence.'))
    criterion = F.concat(
        F.lit('Verify in the post-action UI that "'), deliverable(entities, objective),
        F.lit('" reflects the intended result "'), truncate(objective, 140), F.lit('".'),
        F.when(F.size(ocr_texts) > 0, seen).otherwise(F.lit("")),
    )
    return truncate(criterion, 260)


def _labelled(pairs: list[tuple[str, Column]]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), or_empty(value)) for label, value in pairs])


def _ocr_line(ocr_texts: Column) -> Column:
    return F.array_join(F.transform(F.slice(ocr_texts, 1, 3), lambda t: truncate(t, 240)), " | ")


def leaf_profile(leaf: dict[str, Column]) -> Column:
    """Comparison text of one activity."""
    return _labelled(
        [
            ("objective", leaf["objective"]),
            ("procedure_summary", leaf["procedure_summary"]),
            ("apps_used", F.array_join(leaf["apps_used"], ", ")),
            ("entities", F.array_join(leaf["entities"], ", ")),
            ("ocr_text", _ocr_line(leaf["ocr_texts"])),
            ("pre_state", leaf["pre_state"]),
            ("post_state", leaf["post_state"]),
        ]
    )


def representative_samples(items: Column, max_items: int) -> Column:
    """Evenly spaced sample of distinct texts: both ends and half-even positions between them.

    Positions whose normalized text was already taken are made up from the front of the list.
    """
    if max_items <= 1:
        return F.slice(unique_texts(items), 1, max(max_items, 0))
    places = F.array(*[F.lit(i) for i in range(max_items)])

    def pick(unique: Column) -> Column:
        last = F.size(unique) - 1
        place = lambda i: (F.bround(i * last / F.lit(max_items - 1)) + 1).cast("int")
        spaced = F.transform(places, lambda i: F.try_element_at(unique, place(i)))
        sample = F.slice(_distinct_by_norm(F.concat(spaced, unique)), 1, max_items)
        return F.when(F.size(unique) <= max_items, unique).otherwise(sample)

    return let(unique_texts(items), pick)


def uniq_truncated(items: Column, max_items: int, max_chars: int) -> Column:
    """First ``max_items`` distinct texts, white space collapsed, each truncated."""
    whole = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: collapse(or_empty(x)))
    return F.transform(F.slice(F.array_distinct(F.filter(whole, lambda x: x != "")), 1, max_items), lambda x: truncate(x, max_chars))


def ends(items: Column, repeat: bool) -> Column:
    """First two and last two members; the short-list overlap is kept only when ``repeat``."""
    n = F.size(items)
    start = F.greatest(F.lit(1), n - 1) if repeat else F.greatest(F.lit(3), n - 1)
    tail = F.when(n >= start, F.slice(items, start, F.lit(2))).otherwise(F.slice(items, 1, 0))
    return F.concat(F.slice(items, 1, 2), tail)


def shared_count(a: Column, b: Column) -> Column:
    """How many normalized items two lists share."""
    def norm(x: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(x, normalize), lambda t: t != ""))

    return F.size(F.array_intersect(norm(a), norm(b)))


@F.pandas_udf(T.DoubleType())
def text_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two already normalized texts; equal is 1, empty is 0."""
    from difflib import SequenceMatcher

    def ratio(a: str | None, b: str | None) -> float:
        if not a or not b:
            return 0.0
        return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()

    return pd.Series([ratio(a, b) for a, b in zip(left, right)])
