"""Input-event text: kinds, key tokens, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the recorder's action text.
HOTKEY_PARTS = [".cmd", ".enter", ".tab", ".up", ".down"]
BACKSPACE = "Key.backspace"


def is_key(action: Column) -> Column:
    return action.contains("press")


def is_click(action: Column) -> Column:
    return action.contains("click")


def is_scroll(action: Column) -> Column:
    return action.contains("scroll")


def is_drag(action: Column) -> Column:
    return action.contains("drag")


def is_hotkey(action: Column) -> Column:
    test = F.lit(False)
    for part in HOTKEY_PARTS:
        test = test | action.contains(part)
    return test


def merge_kind(action: Column) -> Column:
    """Kind that decides run merging: key before scroll before anything else."""
    return F.when(is_key(action), "key").when(is_scroll(action), "scroll").otherwise("other")


def _first_parenthesis(action: Column) -> Column:
    """Text after the first '(' up to the next '(' or ')', whichever comes first."""
    return F.regexp_extract(action, r"^[^(]*\(([^()]*)", 1)


def key_token(action: Column) -> Column:
    inside = F.when(action.contains("(") & action.contains(")"), _first_parenthesis(action)).otherwise(action)
    token = F.trim(F.replace(inside, F.lit("'"), F.lit("")))
    return (
        F.when(token == "Key.space", " ")
        .when(token == "Key.shift", "")
        .when(token == BACKSPACE, token)
        .when(token.startswith("Key."), F.concat(token, F.lit("+")))
        .otherwise(token)
    )


def compose_tokens(tokens: Column) -> Column:
    """Text of an ordered token array; a backspace cuts one character of the token before it.

    For token rows use ``consolidate.merge_runs``; this form is for arrays that already exist.
    """
    empty = F.array().cast("array<string>")

    def step(acc: Column, token: Column) -> Column:
        last = F.element_at(acc, -1)
        shortened = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.substr(last, F.lit(1), F.greatest(F.length(last) - 1, F.lit(0)))))
        return F.when((token == BACKSPACE) & (F.size(acc) > 0), shortened).otherwise(F.concat(acc, F.array(token)))

    return F.array_join(F.aggregate(tokens, empty, step), "")


def typed_text(action: Column) -> Column:
    """Text typed by a key row.  Named keys become a space, a newline or nothing.

    "backspace" contains "space", so a row holding only a backspace counts as a space.
    """
    content = F.regexp_extract(action, r"(?s)^key_press\((.*).$", 1)
    content = F.regexp_replace(F.regexp_replace(content, r"(?s)^'(.*)'$", "$1"), r'(?s)^"(.*)"$', "$1")
    named = F.when(content.contains("space"), " ").when(content.contains("enter"), "\n").otherwise("")
    return (
        F.when(~action.startswith("key_press("), "")
        .when(content.contains("Key."), named)
        .otherwise(content)
    )


def click_x(action: Column) -> Column:
    return F.regexp_extract(action, r"\(\s*([^,()]+),", 1).try_cast("double")


def click_y(action: Column) -> Column:
    return F.regexp_extract(action, r"\([^,()]+,([^,()]+)\)", 1).try_cast("double")


def event_text(kind: Column, x: Column, y: Column, dx: Column, dy: Column, end_x: Column, end_y: Column, text: Column) -> Column:
    """Recorded text of an input event: scroll with deltas, drag with both ends, click, or key."""
    return (
        F.when(is_scroll(kind), F.format_string("scroll(%.1f, %.1f, dx=%.2f, dy=%.2f)", x, y, dx, dy))
        .when(is_drag(kind), F.format_string("%s(start_x=%.1f, start_y=%.1f, end_x=%.1f, end_y=%.1f)", kind, x, y, end_x, end_y))
        .when(is_click(kind), F.format_string("%s(%.1f, %.1f)", kind, x, y))
        .otherwise(F.concat(kind, F.lit("("), text, F.lit(")")))
    )
