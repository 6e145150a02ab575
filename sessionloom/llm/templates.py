"""Line deduplication with a log-template tree, in DataFrame functions only.

A line is parsed to a leaf of a tree of fixed depth: its number of tokens, then its leading `depth` tokens, where a token that holds a digit
is a variable field. Inside a leaf, lines that differ in other fields fall together where most lines agree: at each place the token held
by more than half of the leaf's documents is constant, every other place is a variable field. A line belongs to the leaf's template if it
holds enough of the constants (`least_match` of all places); a line that recurs on its own is a template without open fields. Lines of
fewer than `least_tokens` tokens, such as "Read more" or a page number, are only judged as they are written: none of their fields is open.

A template is boilerplate if it recurs in at least `least_docs` documents *and in as many different surroundings*: the lines before and
after it differ in at least `least_spread` of those documents. Lines of copied documents recur with their neighbours and stay; whole
copies are for the near-duplicate operator.

Scale: lines travel as hashes, counts are combined before the shuffle, and tokens are only laid out for the distinct lines of leaves
that recur. A line held by a third of all documents is one row per task in every count; joins have one row per key on one side. Texts are shuffled
once, to meet their dropped line numbers.

Defined results: null text stays null and has no lines; empty lines are kept, never counted and never dropped; a null id counts as one document
for the statistics, and its lines are dropped like any other; repeated rows with equal id and text are counted once and treated alike; documents that lose every line stay with
an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.session import cut_lineage

OPEN = "<*>"
# A token with a digit; starts inside a token are skipped at once.
_VARIABLE = r"(?<![^\x20\n])[^\x20\n0-9]*+[0-9][^\x20\n]*"
_BLANKS = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"


def parsed(text: Column, least_tokens: int) -> Column:
    """Each line's tokens joined by one space: masked with those with a digit opened, and exact as they are where a line is too short for
    a template and has a digit (else null); as many entries as the text has lines.
    """
    uneven = text.contains("  ")
    for blank in "\t\r\x0b\x0c":
        uneven = uneven | text.contains(blank)
    even = F.when(uneven, F.regexp_replace(text, _BLANKS, " ")).otherwise(text)

    def masked(line: Column) -> Column:
        return F.trim(F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, OPEN)).otherwise(line))

    def exact(line: Column) -> Column:
        return F.when(line.rlike("[0-9]") & (tokens_of(F.trim(line)) < least_tokens), F.trim(line))

    return F.transform(F.split(even, "\n", -1), lambda line: F.struct(masked(line).alias("masked"), exact(line).alias("exact")))


def tokens_of(masked: Column) -> Column:
    return F.length(masked) - F.length(F.replace(masked, F.lit(" "))) + 1


def leaf(masked: Column, depth: int) -> Column:
    return F.xxhash64(tokens_of(masked), F.substring_index(masked, " ", depth))


def spelled(docs: DataFrame, doc_id: str, text: str, depth: int, least_tokens: int) -> DataFrame:
    """One row per line that isn't blank: doc, check, place, masked, line (hash), tokens, leaf, around (hash of both neighbours' leaves).

    Neighbours count by their leaves, so the edited copies of a document are one surrounding.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("check"), parsed(body, least_tokens).alias("parts"))
    own = own.withColumn("leaves", F.transform("parts", lambda x: leaf(x["masked"], depth)))
    rows = own.select("doc", "check", "leaves", F.posexplode("parts").alias("place", "part")).select("*", "part.masked", "part.exact").where("masked <> ''")
    # Past either end the neighbour is null, which hashes like any other value.
    before, after = (F.get("leaves", F.col("place") + d) for d in (-1, 1))
    return rows.select(
        "doc", "check", "place", "masked", F.xxhash64(F.coalesce("exact", "masked")).alias("line"), tokens_of(F.col("masked")).alias("tokens"),
        F.get("leaves", F.col("place")).alias("leaf"), F.xxhash64(before, F.lit(0), after).alias("around"),
    )


def recurring(counted: DataFrame, key: str, least_docs: int, least_spread: float) -> DataFrame:
    """Keys with enough documents and surroundings. counted: key, around, docs."""
    return (
        counted.groupBy(key, "around").agg(F.sum("docs").alias("docs"))
        .groupBy(key).agg(F.sum("docs").alias("docs"), F.count("*").alias("ways"))
        .where((F.col("docs") >= least_docs) & (F.col("ways") >= least_docs) & (F.col("ways") >= least_spread * F.col("docs")))
    )


#: A list of documents of at most so many rows (16 bytes each) is sent to all tasks; a longer one is joined by a shuffle.
SENT_ROWS = 250_000


def boilerplate(
    every: DataFrame, wording_of: Callable[[DataFrame], DataFrame], least_docs: int = 8, least_spread: float = 0.5, least_match: float = 0.7, least_tokens: int = 3
) -> DataFrame:
    """line: hash of every line that belongs to a boilerplate template.

    every: spelled() without `masked`, written once; wording_of(doc, check): spelled() of those documents, to read out lines of recurring leaves.
    """
    # A line that a document repeats counts once for each of its surroundings there.
    counted = cut_lineage(every.groupBy("line", "leaf", "tokens", "around").agg(F.count("*").alias("docs")))

    def in_documents(found: DataFrame, key: str) -> DataFrame:
        """Those found in enough documents; one document may repeat a line in many surroundings."""
        met = found.join(every.select("line", "doc", "check"), "line").select(key, "doc", "check").distinct()
        return met.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select(key)

    whole = in_documents(recurring(counted, "line", least_docs, least_spread).select("line"), "line")
    leaves = recurring(counted.where(F.col("tokens") >= least_tokens), "leaf", least_docs, least_spread).select("leaf")
    # Only leaves of several lines can open further fields; only their distinct lines are laid out token by token.
    several = counted.join(leaves, "leaf").groupBy("leaf", "line").agg(F.sum("docs").alias("docs"))
    several = cut_lineage(several.join(several.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("all")).where("kinds > 1"), "leaf"))
    # One document that holds the line tells its wording.
    lines = several.select("line").distinct()
    holders = cut_lineage(every.join(lines, "line", "left_semi").groupBy("line").agg(F.min(F.struct("doc", "check")).alias("at")).select("at.doc", "at.check").distinct())
    wording = wording_of(F.broadcast(holders) if holders.count() <= SENT_ROWS else holders)
    wording = wording.select("line", "masked").join(lines, "line", "left_semi").groupBy("line").agg(F.min("masked").alias("masked"))
    member = several.join(wording, "line")
    tokens = cut_lineage(member.select("leaf", "line", "docs", "all", F.posexplode(F.split("masked", " ")).alias("at", "token")))
    constants = (
        tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs"), F.max("all").alias("all"))
        .where((F.col("docs") * 2 > F.col("all")) & (F.col("token") != OPEN)).select("leaf", "at", F.col("token").alias("constant"))
    )
    match = (
        tokens.join(constants, ["leaf", "at"], "left")
        .groupBy("leaf", "line").agg(F.count("*").alias("places"), F.sum((F.col("token") == F.col("constant")).cast("long")).alias("kept"))
    )
    fitting = match.where(F.col("kept") >= least_match * F.col("places")).select("leaf", "line")
    shaped = counted.join(fitting, ["leaf", "line"])
    good = shaped.join(recurring(shaped, "leaf", least_docs, least_spread).select("leaf"), "leaf", "left_semi").select("leaf", "line").distinct()
    good = good.join(in_documents(good, "leaf"), "leaf", "left_semi")
    return whole.unionByName(good.select("line")).distinct()


def drop_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 3, least_docs: int = 8, least_spread: float = 0.5, least_match: float = 0.7,
    length: str | None = None, counts: bool = True, least_tokens: int = 3,
) -> DataFrame:
    """Every row and column of `docs`, its text without boilerplate lines; `length` names a column that holds the text's length.

    With `counts`, n_lines and n_dropped follow (and replace columns of these names). Lines of fewer than `least_tokens` tokens are judged
    by their exact wording only.
    """
    every = cut_lineage(spelled(docs, doc_id, text, depth, least_tokens).drop("masked"))

    def wording_of(holders: DataFrame) -> DataFrame:
        own = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
        met = own.join(holders, F.col("d").eqNullSafe(F.col("doc")) & (F.xxhash64(F.coalesce("t", F.lit(""))) == F.col("check")), "left_semi")
        return spelled(met, "d", "t", depth, least_tokens)

    dropped = boilerplate(every, wording_of, least_docs, least_spread, least_match, least_tokens)
    gone = (
        every.select("doc", "check", "place", "line").join(dropped, "line", "left_semi")
        .groupBy("doc", "check").agg(F.collect_set("place").alias("places"))
    )
    # The row travels as one value, so no name of its columns can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    body = F.col("row")[text]
    met = rows.join(gone, F.col("row")[doc_id].eqNullSafe(F.col("doc")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("check")), "left")
    parts = F.split(body, "\n", -1)
    left = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("places", i)), "\n")
    kept = F.when(F.col("places").isNull(), body).otherwise(left)
    changed = {text: kept}
    if length:
        changed[length] = F.when(F.col("places").isNull(), F.col("row")[length]).otherwise(F.length(kept).cast(docs.schema[length].dataType))
    columns = [changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        columns.append(F.when(body.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"))
        columns.append(F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
    return met.select(*columns)
