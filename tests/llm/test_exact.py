"""Operators with a brute-force version: token counts, personal data, repeats, near duplicates, nearest neighbours."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sessionloom import session
from sessionloom.llm import ann, orderminhash, pii, queries, substrings, tokens
from sessionloom.session import ship_package

from . import odd

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return odd.documents(spark, clashing=True)


def pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    want = Counter((d, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs(docs))
    for chunk, overlap in ((65_536, 1_024), (500, 80)):
        got = tokens.count_tokens(docs, path, chunk=chunk, overlap=overlap).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert tokens.count_tokens(odd.nothing(spark), path).count() == 0


def test_splicing_agrees_with_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = tokens._untrimmed(path)
    rnd = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'ll", "é", "日本", "<|endoftext|>", "1", "!!", " world", "🙂", " " * 90, "x" * 150]
    for _ in range(150):
        text = "".join(rnd.choices(parts, k=rnd.randint(50, 900)))
        whole = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert tokens.count_long(tokenizer, text, chunk=rnd.choice([200, 300, 500]), overlap=rnd.choice([80, 130])) == whole


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple]:
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}.get(kind)
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_personal_data(spark):
    texts = [
        "a@b.c_d@e.f 1.2.3.4.5.6.7.8 007.1.2.3 256.1.1.1", "+1 (988) 555-2485x(988) 555-2485", "4111 1111 1111 1111 4111-1111-1111-1112",
        "x" * 3_000 + "@" + "y" * 50 + ".com é1.1.1.1", "joe (at) mail (dot) example.com", None, "", "1" * 20_000, "+1" * 2_000, "1 " * 3_000,
        "a@b..c a@b.c. @x.y a@.b", "١.٢.٣.٤ 1.2.3.4", "😀 a@b.co 😀 10.0.0.1", "a@b.c a@b.c", "a." * 4_000 + "b@c.d" + ".e" * 4_000,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans", "half", "base", "hit")})
    got = pii.digest(pii.find(df)).collect()

    def want(d, t):
        spans = base_spans(t or "")
        digest = sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()
        return (d, *(sum(x[3] == k for x in spans) for k in PATTERNS), digest)

    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == Counter(want(*r) for r in rows)
    assert pii.digest(pii.find(odd.nothing(spark))).count() == 0


def test_redaction_joins_overlaps(spark):
    df = spark.sql("select 'ab 12 34 cd' text, array(named_struct('start', 3, 'end', 6, 'kind', 'card'), named_struct('start', 5, 'end', 8, 'kind', 'ip')) spans")
    assert df.select(pii.redact(F.col("text"), F.col("spans"))).first()[0] == "ab [card] cd"


def repeats(rows: list[tuple], window: int) -> list[tuple]:
    words = [WORD.findall(t or "") for _, t in rows]
    first: dict = {}
    for (d, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[a : a + window])] < d:
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [20, 50])
def test_repeats(spark, docs, window):
    got = substrings.remove_repeats(docs, window=window).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(repeats(pairs(docs), window))
    assert all(sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert all(sum(s["end"] - s["first"] for s in r["repeats"]) == r["n_removed"] for r in got)
    assert substrings.remove_repeats(odd.nothing(spark)).count() == 0


def test_repeats_of_the_table(spark):
    got = queries.QUERIES["op3_substring_dedup"](spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(repeats(pairs(spark.read.parquet(f"{SF}/documents.parquet")), 50))


def classes(rows: list[tuple], similarity: float = 0.8) -> dict:
    shingles, texts = {}, defaultdict(list)
    for d, t in rows:
        w = WORD.findall(t or "")
        shingles[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        texts[t or ""].append(d)
    root = {d: d for d in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for same in texts.values():
        for d in same[1:]:
            join(same[0], d)
    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(shingles[a] & shingles[b])
            if common and common >= similarity * (len(shingles[a]) + len(shingles[b]) - common):
                join(a, b)
    return {d: find(d) for d in shingles}


def test_near_duplicates_of_the_table(spark):
    got = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op9_order_minhash"](spark, SF).collect()}
    assert got == classes(pairs(spark.read.parquet(f"{SF}/documents.parquet")))


def test_near_duplicates_of_odd_documents(spark, docs):
    got = orderminhash.near_duplicates(docs).collect()
    by_id = {(r["doc_id"], bytes(r["content"])): r["class_id"] for r in got}
    ids = {d: c for (d, _), c in by_id.items()}
    assert ids[5] == 4 and ids[7] == 6 and ids[8] == 0 and ids[10] == 9 and ids[2] == 1 and ids[3] == 3 and ids[None] is None
    kept = orderminhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = Counter(r["doc_id"] for r in kept.collect())
    assert not {5, 7, 8, 10, 2} & set(left) and left[None] == 2 and left[12] == 2 and left[11] == 2
    assert orderminhash.keep_one(odd.nothing(spark)).count() == 0


def test_leaders_and_classes_of_one_bucket(spark):
    base = odd.prose(1, 300).split()
    chain = []
    for i in range(12):
        # Each differs from the one before in a few words; the ends are less than 0.8 alike.
        base = [*base[: i * 20], f"new{i}", *base[i * 20 + 1 :]]
        chain.append((i, " ".join(base)))
    got = {r["doc_id"]: r["class_id"] for r in orderminhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert got == classes(chain)


def test_one_word_edits_of_short_texts(spark):
    rows = []
    for n in [*range(5, 41), 90, 103, 110, 128]:
        w = odd.prose(7_000 + n, n).split()
        half = n // 2
        for v in (w, w[:-1], w[1:], [*w[:-1], "other"], [*w[:half], "other", *w[half + 1 :]], [*w, "more"], [*w, "some", "more"]):
            rows.append((len(rows), " ".join(v)))
    rows += [(len(rows) + i, f"{odd.prose(1, 20)} {odd.prose(8_000 + i, 4)}") for i in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in orderminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_moved_passages_and_repeated_lines(spark):
    rows = []
    for i in range(20):
        w, line = odd.prose(9_000 + i, 300).split(), odd.prose(9_500 + i, 10).split()
        for v in (w, w[150:] + w[:150], w[:150] + line * 10, w[:150] + line * 60):
            rows.append((len(rows), " ".join(v)))
    got = {r["doc_id"]: r["class_id"] for r in orderminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    passage = odd.prose(5, 300)
    rows = [(i, f"{passage} {odd.prose(6_000 + i, 52)}") for i in range(160)]
    # Two more are alike to the third and the fifth.
    rows += [(1_000 + i, rows[i][1] + " and some more words") for i in (3, 5)]
    judged = []

    def cut(df):
        out = session.cut_lineage(df)
        if out.columns == ["a", "b", "open"]:
            judged.append(out.count())
        return out

    monkeypatch.setattr(orderminhash, "cut_lineage", cut)
    got = {r["doc_id"]: r["class_id"] for r in orderminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and got[1_003] == 3 and got[1_005] == 5
    # Whoever met no leader of its buckets meets by rare k-mers, not by the passage.
    assert judged[-1] < 300, str(judged)


def test_a_common_passage_takes_one_turn(spark, monkeypatch):
    passage, rows = odd.prose(5, 300), []
    for k in range(12):
        base = odd.prose(7_500 + k, 300).split()
        for i in range(12):
            base = [*base[: i * 20], f"new{i}", *base[i * 20 + 1 :]]
            rows.append((len(rows), " ".join(base)))
    rows += [(1_000 + i, f"{passage} {odd.prose(6_000 + i, 80)}") for i in range(30)]
    judged = []

    def cut(df):
        out = session.cut_lineage(df)
        if out.columns == ["a", "b", "open"]:
            judged.append((out.count(), out.where("a >= 1000 and b >= 1000").count()))
        return out

    monkeypatch.setattr(orderminhash, "cut_lineage", cut)
    got = {r["doc_id"]: r["class_id"] for r in orderminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)
    # The buckets of the passage bring no link; the others go on.
    assert judged[1][1] and not any(n for _, n in judged[2:-1]), str(judged)


def test_partners_of_other_classes_are_all_found(spark):
    rnd, rows = random.Random(4), []
    for i in range(12):
        w = odd.prose(4_000 + i % 4, 8 + 15 * i).split()
        for _ in range(8):
            v = [x if rnd.random() > 0.03 else f"new{rnd.randint(0, 9)}" for x in w]
            rows.append((len(rows), len(rows), " ".join(v[: len(v) - rnd.randint(0, 2)])))
    got = {(r["a"], r["b"]) for r in orderminhash.partners(spark.createDataFrame(rows, "rep long, root long, text string"), 0.8).collect()}
    sets = {i: {tuple(x.split()[j : j + 5]) for j in range(len(x.split()) - 4)} for i, _, x in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_alignment_counts_edits():
    rnd = random.Random(2)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    for _ in range(200):
        a = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 25))]
        b = [x for x in a if rnd.random() > 0.1] + [rnd.randint(0, 5) for _ in range(rnd.randint(0, 3))]
        want = edits(a, b)
        for most in (0, 2, 30):
            assert orderminhash.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (want if want <= most else None)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 200)]
    got = {r["node"]: r["root"] for r in orderminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100, 102: 100}


def nearest(rows: list[tuple], k: int, every: int) -> dict:
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            out[i] = sorted(((-float(v @ w), j) for j, w in good if j != i))[:k]
    return out


def test_nearest_neighbours(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0] * 8) for i in range(60)] + [(400, None), (420, []), (440, [0.0] * 8), (460, [1.0, None] * 4), (480, [float("nan")] * 8), (None, [1.0] * 8)]
    rows += [(500, [float("inf")] * 8), rows[0], (520, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("score", F.lit(1))
    distinct = list({i: (i, v) for i, v in rows}.values())
    want = nearest(distinct, 20, 20)
    got = defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0, k=20, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for i, answers in got.items():
        assert [a[0] for a in answers] == list(range(1, len(answers) + 1))
        assert [a[1] for a in answers] == [j for _, j in want[i]]
        assert np.allclose([a[2] for a in answers], [-s for s, _ in want[i]], rtol=0, atol=1e-12)
    assert ann.search(df.where("false"), F.col("id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id < 5"), F.col("id") % 20 == 0).count()
    assert few == 4


def test_recall(spark):
    folder = "/root/testdata/sf0.1"
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = nearest(table, 20, 20)
    got = defaultdict(set)
    for r in queries.QUERIES["op7_inverted_multi_index"](spark, folder).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[i] & {j for _, j in best}) for i, best in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
