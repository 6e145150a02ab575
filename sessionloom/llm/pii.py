"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans: the four base kinds, numbers of seven digits or more in any grouping, and mail addresses with
the at sign and dots spelled out. Spans of different generators may overlap. Each span has small integer features of its format and its context. Distant
labels come from what can be validated: address form, octets, checksums, an international prefix (which the features do not see).
All spans of all documents are counted by feature cell; the cells are few, whatever the data (`CELLS` at most), so trees are boosted on
the exact counts of half the documents. The other half calibrates, for each kind, the lowest score whose precision reaches `precision`. Base spans
are always kept; other spans are added where their score reaches that threshold and no base rule already covers them.

Both passes are projections; the only shuffle is the count of cells. Texts are used whole.

Defined results: null text counts as empty; a text without spans has zero counts, the digest of the empty string and an empty list; every
input row gives one row, repeated rows too; positions are code points, the end is exclusive; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order.
KINDS = ("email", "ip", "card", "phone")
# The contract's patterns in a form that Java's matcher runs in constant stack and one scan: starts inside a run that has already
# failed are skipped, and a repeated group is a lazy run of its characters up to the first place where the group can't go on.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])[A-Za-z0-9.-]*?\.[A-Za-z0-9.-]*?(?<=[A-Za-z0-9-])(?!\.?[A-Za-z0-9-])",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9][0-9\x20-]*?(?<=[0-9])(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "spelled": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]+(?: ?(?:[(\[](?:dot|DOT)[)\]]|\.) ?[A-Za-z0-9-]+){1,8}",
    "number": r"(?:(?<![0-9])|\G)[(]?[0-9][\x20().0-9-]{5,}[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "spelled": r"[(\[](?:at|AT)[)\]]", "number": r"[0-9][\x20().0-9-]{5,}[0-9]"}
GENERATORS = (*KINDS, *WIDE)

CONTEXT = 24
#: Words before a span that speak for or against a kind.
CLUES = {
    1: r"(?i)\b(phone|tel|telefon|call|mobile|fax|whatsapp)\b",
    2: r"(?i)\b(e-?mail|mail|contact|write)\b",
    3: r"(?i)\b(card|visa|mastercard|credit|iban|konto|account)\b",
    4: r"(?i)\b(ip|host|server|address)\b",
    5: r"(?i)\b(version|page|isbn|total|no|nr|figure|table|year)\b",
}
#: Features and how many values each has.
FEATURES = {"generator": 6, "digits": 7, "groups": 6, "opened": 2, "checksum": 2, "octets": 2, "clue": 6, "glued": 3, "same": 2}
CELLS = int(np.prod(list(FEATURES.values())))

_SPAN = "array<struct<start: int, end: int, hit: string>>"


def found(text: Column, pattern: str, needs: str) -> Column:
    """All matches, left to right without overlap, with code-point positions."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    parts = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("long"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["gap"]
        end = begin + part["long"]
        span = F.struct(begin.alias("start"), end.alias("end"), part["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(text.rlike(needs), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    return hit.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\.|$)){4}$")


def _luhn(digits: Column) -> Column:
    return F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def valid(kind: str, span: Column, text: Column) -> Column:
    """What can be checked about a span; for the wide generators, whether a rule vouches for it."""
    digits = _digits(span["hit"])
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(span["hit"])
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "spelled":
        plain = F.regexp_replace(F.regexp_replace(span["hit"], r" ?[(\[](?:at|AT)[)\]] ?", "@"), r" ?[(\[](?:dot|DOT)[)\]] ?", ".")
        return plain.rlike("^" + BASE["email"] + "$")
    prefixed = (F.substring(text, span["start"], F.lit(1)) == "+") & F.length(digits).between(10, 15)
    return prefixed | _luhn(digits) | _octets(span["hit"])


def _step(value: Column, edges: list[int]) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + (value >= edge).cast("int")
    return out


def described(kind: str, span: Column, text: Column) -> Column:
    """The span with its features and its distant label."""
    hit, digits = span["hit"], _digits(span["hit"])
    before = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    clue = F.lit(0)
    for value, pattern in reversed(CLUES.items()):
        clue = F.when(before.rlike(pattern), value).otherwise(clue)
    values = {
        "generator": F.lit(GENERATORS.index(kind)),
        "digits": _step(F.length(digits), [1, 7, 9, 10, 12, 14]),
        "groups": _step(F.size(F.split(hit, "[^0-9]+", -1)), [2, 3, 4, 5, 6]),
        "opened": hit.contains("(").cast("int"),
        "checksum": _luhn(digits).cast("int"),
        "octets": _octets(hit).cast("int"),
        "clue": clue,
        "glued": before.rlike("[A-Za-z0-9._/-]$").cast("int") + after.rlike("^[A-Za-z0-9]").cast("int"),
        "same": digits.rlike(r"^([0-9])\1*$").cast("int"),
    }
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"), F.lit(kind).alias("kind"),
        *(values[name].cast("int").alias(name) for name in FEATURES), F.coalesce(valid(kind, span, text), F.lit(False)).alias("valid"),
    )


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, half (for fitting and calibration) and the described spans of every generator."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    half = F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")
    body = F.col("text")

    def listed(kind: str) -> Column:
        return F.transform(found(body, {**BASE, **WIDE}[kind], NEEDS[kind]), lambda s: described(kind, s, body))

    lists = [listed(kind) for kind in GENERATORS]
    any_needed = body.rlike("[0-9@]|[(\\[](?:at|AT)[)\\]]")
    spans = F.concat(*lists)
    return own.select("doc_id", half, F.when(any_needed, spans).alias("spans"))


@dataclass(frozen=True)
class Tree:
    """Depth two: a test, and a test on either side; a test is (feature, value): is the feature at least the value?"""

    top: tuple[str, int]
    low: tuple[str, int]
    high: tuple[str, int]
    leaves: tuple[float, float, float, float]


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[Tree, ...]
    thresholds: dict[str, float]

    def margin(self, feature: Callable[[str], object], choose: Callable[[object, object, object], object], at_least: Callable[[object, int], object], add: Callable):
        total = self.base
        for t in self.trees:
            low = choose(at_least(feature(t.low[0]), t.low[1]), t.leaves[1], t.leaves[0])
            high = choose(at_least(feature(t.high[0]), t.high[1]), t.leaves[3], t.leaves[2])
            total = add(total, choose(at_least(feature(t.top[0]), t.top[1]), high, low))
        return total

    def column(self, span: Column) -> Column:
        def lit(x):
            return x if isinstance(x, Column) else F.lit(float(x))

        return lit(self.margin(lambda n: span[n], lambda c, a, b: F.when(c, lit(a)).otherwise(lit(b)), lambda f, v: f >= v, lambda a, b: lit(a) + b))

    def values(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        return np.zeros(len(cells["generator"])) + self.margin(lambda n: cells[n], np.where, lambda f, v: f >= v, lambda a, b: a + b)


def _split(cells, names, grad, hess, where):
    """Best test among all features and values inside `where`, by the gain of Newton boosting."""
    best, gain = (names[0], 10**6), -1.0
    for name in names:
        for value in range(1, FEATURES[name]):
            right = where & (cells[name] >= value)
            left = where & ~right
            g = [grad[left].sum(), grad[right].sum()]
            h = [hess[left].sum(), hess[right].sum()]
            now = sum(a * a / (b + 1.0) for a, b in zip(g, h, strict=True))
            if now > gain + 1e-12:
                best, gain = (name, value), now
    return best


def boost(cells: dict[str, np.ndarray], count: np.ndarray, positive: np.ndarray, rounds: int = 24, rate: float = 0.3) -> tuple[float, tuple[Tree, ...]]:
    """Newton boosting of log loss on counted cells."""
    names = sorted(FEATURES)
    share = (positive.sum() + 0.5) / (count.sum() + 1.0)
    base = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(count), base), []
    for _ in range(rounds if len(count) else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = positive - count * p, count * p * (1 - p)
        everywhere = np.ones(len(count), bool)
        top = _split(cells, names, grad, hess, everywhere)
        right = cells[top[0]] >= top[1]
        low, high = _split(cells, names, grad, hess, ~right), _split(cells, names, grad, hess, right)
        leaves, masks = [], []
        for side, test in ((~right, low), (right, high)):
            inner = cells[test[0]] >= test[1]
            masks += [side & ~inner, side & inner]
        for mask in masks:
            leaves.append(float(rate * grad[mask].sum() / (hess[mask].sum() + 1.0)))
            margin[mask] += leaves[-1]
        trees.append(Tree(top, low, high, tuple(leaves)))
    return base, tuple(trees)


def fit(spans: DataFrame, precision: float = 0.95) -> Model:
    """Boost on the cells of half the documents, calibrate each generator's threshold on the other half."""
    counted = (
        spans.select("half", F.explode("spans").alias("s"))
        .groupBy("half", *(F.col(f"s.{n}").alias(n) for n in FEATURES))
        .agg(F.count("*").alias("count"), F.sum(F.col("s.valid").cast("long")).alias("positive"))
        .collect()  # at most 2 * CELLS rows
    )
    counted.sort(key=lambda r: tuple(r))
    sides = []
    for half in (0, 1):
        own = [r for r in counted if r["half"] == half]
        cells = {n: np.array([r[n] for r in own], int) for n in FEATURES}
        sides.append((cells, np.array([r["count"] for r in own], float), np.array([r["positive"] for r in own], float)))
    base, trees = boost(*sides[0])
    model = Model(base, trees, {})
    cells, count, positive = sides[1]
    margin = model.values(cells)
    thresholds = {}
    for kind in WIDE:
        own = np.flatnonzero(cells["generator"] == GENERATORS.index(kind))
        own = own[np.argsort(-margin[own], kind="stable")]
        good, seen = np.cumsum(positive[own]), np.cumsum(count[own])
        # Cells of one score stand or fall together.
        ends = [i for i in range(len(own)) if i + 1 == len(own) or margin[own[i + 1]] < margin[own[i]]]
        passing = [i for i in ends if seen[i] >= 20 and good[i] >= precision * seen[i]]
        thresholds[kind] = float(margin[own[passing[-1]]]) if passing else float("inf")
    return Model(base, trees, thresholds)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = 0.95) -> DataFrame:
    """doc_id, base (array of spans), added (array of spans) of every row."""
    spans = candidates(docs, doc_id, text)
    model = fit(spans, precision)

    def plain(s: Column) -> Column:
        rank = F.lit(0)
        for i, kind in enumerate(GENERATORS):
            rank = F.when(s["kind"] == kind, i).otherwise(rank)
        return F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))

    def added(s: Column) -> Column:
        wanted = F.lit(False)
        for kind, least in model.thresholds.items():
            if least < float("inf"):
                wanted = wanted | ((s["kind"] == kind) & (model.column(s) >= least - 1e-9))
        # A span that a base rule vouches for is there already; a spelled address is none of the base kinds.
        return wanted & (~s["valid"] | (s["kind"] == "spelled"))

    held = F.coalesce("spans", F.array())
    base = F.filter(held, lambda s: s["valid"] & s["kind"].isin(*KINDS))
    more = F.filter(held, added)
    order = lambda c: F.sort_array(F.transform(c, plain))
    return spans.select("doc_id", F.when(F.col("spans").isNotNull(), order(base)).alias("base"), F.when(F.col("spans").isNotNull(), order(more)).alias("added"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans and the list of all spans."""
    base, more = F.coalesce("base", F.array()), F.coalesce("added", F.array())

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id",
        *(number(kind) for kind in KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat(base, more))).alias("spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
