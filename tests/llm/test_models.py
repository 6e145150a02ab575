"""Operators with learned or chosen parts, and the pipeline."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import decontam, mixing, pages, queries, templates, toxicity
from sessionloom.session import ship_package

from . import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return odd.documents(spark, clashing=True)


# Lines


def test_templates_are_dropped_and_the_rest_stays(spark, docs):
    got = templates.drop_lines(docs)
    assert got.columns == [*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped"]
    rows = {r["doc_id"]: r for r in got.where("doc_id >= 20").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.where("doc_id >= 20").collect()}
    for d, text in before.items():
        lines = text.split("\n")
        assert rows[d]["text"] == "\n".join([lines[0], lines[2]]) and rows[d]["n_dropped"] == 1 and rows[d]["n_lines"] == 3
    others = lambda df: Counter((r["doc_id"], r["text"]) for r in df.where("doc_id < 20 or doc_id is null").collect())
    assert others(got) == others(docs)
    assert templates.drop_lines(odd.nothing(spark)).count() == 0


def test_lines_of_copies_stay_and_open_fields_are_found(spark):
    copy = "\n".join(odd.prose(i, 12) for i in range(5))
    rows = [(i, copy) for i in range(40)]
    names = ["red", "green", "blue", "white", "black", "grey", "pink", "brown", "gold", "teal", "navy", "lime"]
    rows += [(100 + i, f"{odd.prose(300 + i, 15)}\nPosted by the user {n} in the morning news section\n{odd.prose(400 + i, 15)}") for i, n in enumerate(names)]
    one = "\n".join(f"{odd.prose(500 + i, 10)}\nthe same line again and again" for i in range(20))
    rows += [(200, one)]
    got = {r["doc_id"]: r for r in templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_dropped"] == 0 for i in range(40))
    assert all(got[100 + i]["n_dropped"] == 1 and "Posted" not in got[100 + i]["text"] for i in range(12))
    assert got[200]["n_dropped"] == 0


def test_short_lines_are_judged_by_their_wording(spark):
    rows = [(i, f"{odd.prose(600 + i, 10)}\nRead more\n{odd.prose(700 + i, 10)}\nShare\n{odd.prose(800 + i, 10)}\n{1000 + i}\n{odd.prose(900 + i, 10)}\n 2024 \n{odd.prose(950 + i, 10)}") for i in range(12)]
    rows += [(100 + i, "Solo line") for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: t.replace("\nRead more\n", "\n").replace("\nShare\n", "\n").replace("\n 2024 \n", "\n") for d, t in rows}


# Benchmark copies


def test_benchmark_copies(spark, docs):
    rnd = random.Random(1)
    items = [(i, odd.prose(1_000 + i, 30)) for i in range(20)] + [(50, None), (51, ""), (52, "two words"), (None, odd.prose(9, 30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0))
    rows, want = [], set()
    for i, text in items[:20]:
        w = text.split()
        if i % 4 == 1:  # a tenth of the words exchanged
            w = [x if rnd.random() > 0.1 else "other" for x in w]
        if i % 4 == 2:  # words left out and put in
            w = [y for x in w if rnd.random() > 0.08 for y in ([x, "more"] if rnd.random() < 0.05 else [x])]
        if i % 4 == 3:  # a third is no copy
            w = w[:10]
        else:
            want.add((1_000 + i, i))
        rows.append((1_000 + i, f"{odd.prose(50 + i, 60)} {' '.join(w).upper()} {odd.prose(80 + i, 60)}", "en", "s", 1))
    mixed = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, odd.SCHEMA))
    got = decontam.contaminated(mixed, benchmark, block_words=200).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(55 <= r["first_word"] <= 65 and r["end_word"] - r["first_word"] <= 45 for r in got)
    left = {r["doc_id"] for r in decontam.drop_contaminated(mixed, benchmark).collect()}
    assert {d for d, *_ in rows} - left == {d for d, _ in want} and {r["doc_id"] for r in docs.collect()} <= left
    assert decontam.contaminated(mixed, benchmark.where("false")).count() == 0
    assert decontam.contaminated(odd.nothing(spark), benchmark).count() == 0


def test_every_exact_copy_in_the_table(spark):
    folder = "/root/testdata/sf0.01"
    flat = lambda t: " ".join(t.lower().split())
    items = {r["item_id"]: flat(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = {(r["doc_id"], i) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() for i, t in items.items() if t in flat(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op4_decontamination"](spark, folder).collect()}
    assert want <= got and len(got) <= 1.1 * len(want)


# Mixing


def wanted(sizes: dict, share: float = 1.5, limit: float = 2.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(limit * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: limit * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        above = {s for s in order if target[s] >= limit * sizes[s]}
        if above <= full:
            return target
        full |= above


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", None])
def test_mixing(spark, docs, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet") if folder else docs
    first = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    by = lambda rows: Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in rows)
    assert by(first) == by(again)
    source = {(r["doc_id"], r["text"]): r["source"] for r in df.collect()}
    assert Counter((d, len(WORD.findall(t or ""))) for d, t in ((r["doc_id"], r["text"]) for r in df.collect())) == Counter((r["doc_id"], r["size"]) for r in first)
    sizes: dict = defaultdict(int)
    taken: dict = defaultdict(int)
    largest: dict = defaultdict(int)
    for r in first:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = wanted(sizes)
    assert set(source.values()) == set(want)
    for r in first:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(largest[s], 0.02 * t)
    assert mixing.mix(odd.nothing(spark)).count() == 0


def test_a_source_in_many_bins(spark):
    df = spark.range(4_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(df, bin_rows=16).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in wanted(dict(sizes)).items():
        assert abs(taken[s] - t) <= 50


# Toxicity


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(4)
    bad = ["idiotic", "wretched", "stupidly", "vileness"]
    rows, labels = [], []
    for i in range(1_500):
        w = odd.prose(5_000 + i, rnd.randint(5, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(9_000, None), (9_001, ""), (None, "text"), (9_002, "w " * 200_000), (3, "again")]
    labels += [(7, None), (None, 1), (1, 0), (1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("toxic", F.lit(1)).withColumn("label", F.lit(1))
    truth = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.toxicity(df, truth).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1_500 and r["doc_id"] != 3]
    assert sum(right) >= 0.97 * len(right)
    again = {(r["doc_id"], r["score"]) for r in toxicity.toxicity(df.repartition(5), truth).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}
    assert {r["predicted"] for r in toxicity.toxicity(df, truth.where("toxic = 0")).collect()} == {0}
    assert {r["predicted"] for r in toxicity.toxicity(df, truth.where("false")).collect()} == {0}
    assert toxicity.toxicity(odd.nothing(spark), truth).count() == 0


# Pages

ARTICLE = "<h1>A headline of the day</h1><p>One <b>bold &amp; plain<br>line of text that goes on.<p>Two sentences are here. They go on.</p><ul><li>A first point of some length.</li></ul>"
EXPECTED = "A headline of the day\n\nOne bold & plain line of text that goes on.\n\nTwo sentences are here. They go on.\n\nA first point of some length."
AROUND = "<html><head><title>t</title><script>x='<p>no</p>'</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{}<footer>&copy; house</footer></body></html>"


@pytest.fixture(scope="module")
def model(spark):
    ship_package(spark)
    return pages.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("wrap", [
    "<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div>{}</div>",
    "<div class='cookie-notice'><p>We use cookies to make this site better for you.</p></div><article>{}<div class='comments'><h3>Comments</h3><p>I like this very "
    "much, thank you all.</p><p>So do I, it is very good.</p></div><aside><p>More to read is found here and there.</p></aside><form><p>Join our letter today.</p>"
    "<input><button>Go</button></form></article><div class='ad'>Buy this now, it is cheap and good.</div>",
])
def test_main_text(model, wrap):
    assert pages.main_text(AROUND.format(wrap.format(ARTICLE)), model) == EXPECTED


@pytest.mark.parametrize("before", [
    "<head><title>t</title><body><div>", "<head><meta charset=utf-8><title>t</title><script>x</script><div>", "<head><link rel=x><style>y</style></head><body><div>",
    "<body><div><button>Go", "<body><div><select><option>one<option>two", "<body><div><svg><path d='x'>", "<div><div><button>Go</div>",
])
def test_hidden_elements_left_open(before):
    assert [t for t in pages.parse(f"<html>{before}{ARTICLE}</div></html>").text if t] == EXPECTED.split("\n\n")
    assert [t for t in pages.parse("<head><title>t</title>Text alone").text if t] == ["Text alone"]


def test_pages_table(spark, model):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r for r in queries.QUERIES["op6_main_text"](spark, folder).collect()}
    import html

    for r in table.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|li|ul)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", body)))
        want = "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text only"), (None, "u", "<p>" * 3_000), (4, "u", "<div>" * 2_000 + "x"), (5, "u", "</p></div><<>&lt;"), (1, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = pages.extract(df, model).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[3] == "plain text only"
    assert pages.extract(df.where("false"), pages.train(df.where("false"))).count() == 0


# Pipeline


def test_stages_take_odd_documents(spark, docs, tmp_path):
    folder = "/root/testdata/sf0.001"
    held = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, folder).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == docs.columns
        held = after
    assert held.count() > 20
    nothing = odd.nothing(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0


def test_pipeline_on_the_table(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < got.count() <= 200 and {"doc_id", "source", "target", "taken"} <= set(got.columns)
