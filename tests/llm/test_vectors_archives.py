"""Hard negatives, vector codes and legacy archives against plain versions."""

from __future__ import annotations

import gzip
import math
import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import archives, integers, negatives, queries, vectorcodes
from sessionloom.session import ship_package

SCHEMA = "vec_id long, embedding array<float>, label int, id long, key long, q int, rank int, cell int, _salt int, code string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def odd_vectors(n: int = 600, d: int = 6) -> list[tuple]:
    """vec_id, embedding, label: clusters, a hot vector, zeros, repeats, and every row that takes no part."""
    rnd = random.Random(8)
    centers = [[rnd.gauss(0, 1) for _ in range(d)] for _ in range(9)]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = [0.5, -0.25, 1.0, 0.125, 0.0, 2.0][:d]
        elif i % 50 == 1:
            v = [0.0] * d
        else:
            c = centers[i % 9]
            size = rnd.choice([0.1, 1.0, 3.0])
            v = [size * (x + rnd.gauss(0, 0.1)) for x in c]
        rows.append((i * 4, v, rnd.choice([0, 1, 1, 2, 9])))
    bad = [None, [], [1.0] * (d - 1), [1.0] * (d + 2), [None] + [1.0] * (d - 1), [math.nan] + [1.0] * (d - 1), [math.inf] + [1.0] * (d - 1), [-math.inf] * d]
    rows += [(n * 4 + 4 * i, v, 1) for i, v in enumerate(bad)]
    rows += [(100_000, [1.0] * d, None), (None, [1.0] * d, 1), rows[2], rows[3], rows[0], (8, [0.3] * d, 0), (100_100, [9_000.0] * d, 2), (200_000, [-1.0] * d, 5)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 7, 7, 7, 7, 7, 7, "x") for i, v, c in rows], SCHEMA)


def usable(rows: list[tuple], scale: int, d: int) -> list[tuple]:
    fine = [r for r in rows if r[1] and len(r[1]) == d and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], c) for i, v, c in fine]


def plain_negatives(rows: list[tuple], d: int) -> list[tuple]:
    kept = sorted({(i, tuple(q), c) for i, q, c in usable(rows, 256, d) if i is not None and c is not None})
    out = []
    for a, qa, la in kept:
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(qa, q, strict=True)), i, c) for i, q, c in kept if i != a]
        for s, p, _ in sorted(r for r in scores if r[2] == la)[:5]:
            near = sorted(r for r in scores if r[2] != la and 80 * -s <= 100 * -r[0] <= 100 * -s)[:5]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("setting", [{}, {"directions": 3, "bands": 4, "sample": 60, "block": 40}, {"directions": 1, "bands": 1, "sample": 1, "block": 7}])
def test_hard_negatives(spark, setting):
    rows = odd_vectors()
    got = negatives.mine(frame(spark, rows), F.col("id") % 100 == 0, F.col("label"), **setting)
    want = plain_negatives(rows, 6)
    assert len(want) > 100
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_hard_negatives(spark):
    assert negatives.mine(frame(spark, []), F.col("id") % 100 == 0).count() == 0
    assert negatives.mine(frame(spark, [(1, [1.0], 1), (2, [2.0], 2)]), F.col("id") % 100 == 0).count() == 0
    assert negatives.mine(frame(spark, [(100, [0.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, [0.0, 0.0], 2)]), F.col("id") % 100 == 0).count() == 1


def test_bounds_hold():
    """No exact score leaves its interval, near and far, at small and large norms."""
    rnd = np.random.default_rng(4)
    for d, size in ((2, 3), (64, 40), (64, 10_000), (300, 100)):
        x = np.concatenate([rnd.integers(-size, size + 1, (300, d)), np.repeat(rnd.integers(-size, size + 1, (3, d)), 2, axis=0) * np.array([[1], [-1]] * 3)])
        directions = negatives.spread(x / np.maximum(1e-300, np.linalg.norm(x, axis=1))[:, None], 6)
        norm, angle = negatives.angles(x, directions)
        exact = integers.products(x, x)
        for i in range(len(x)):
            low, high = negatives.bounds(norm[i], angle[i], norm, angle, negatives._slack(d))
            assert (low <= exact[i]).all() and (exact[i] <= high).all()


def test_bounds_exclude_rows():
    """In clustered data most rows are ruled out without a score."""
    rnd = np.random.default_rng(5)
    centers = rnd.normal(size=(8, 32))
    x = np.floor(256 * (np.repeat(centers, 100, axis=0) + rnd.normal(scale=0.05, size=(800, 32)))).astype(np.int64)
    norm, angle = negatives.angles(x, negatives.spread(x / np.linalg.norm(x, axis=1)[:, None], 8))
    exact = integers.products(x, x)
    open_rows = [(negatives.bounds(norm[i], angle[i], norm, angle, negatives._slack(32))[1] >= np.sort(exact[i])[-6]).sum() for i in range(0, 800, 50)]
    assert np.mean(open_rows) < 200


def plain_codes(rows: list[tuple], d: int, parts: int, entries: int, rounds: int):
    kept = usable(rows, 4096, d)
    width = -(-d // parts)
    kept = [(i, q + [0] * (parts * width - d), c) for i, q, c in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda q: [q[p * width : (p + 1) * width] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(q) for _, q, _ in order), strict=True)]

    def assign(q):
        found = []
        for v, book in zip(cut(q), books, strict=True):
            found.append(min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), e) for e, c in enumerate(book)))
        return found

    for _ in range(rounds):
        held = defaultdict(list)
        for _, q, _ in kept:
            for p, (_, e) in enumerate(assign(q)):
                held[p, e].append(cut(q)[p])
        for (p, e), vs in held.items():
            books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    coded = [(i, c, assign(q)) for i, q, c in kept]
    rows = [(i, "".join(f"{e:02x}" for _, e in found), min(sum(s for s, _ in found), 2**63 - 1), c) for i, c, found in coded]
    errors = defaultdict(int)
    for _, _, e, c in rows:
        errors[c] += e
    digest = sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return sorted(((i, t, e, min(errors[c], 2**63 - 1)) for i, t, e, c in rows), key=str), digest


@pytest.mark.parametrize(("parts", "entries", "few"), [(2, 16, 10_000), (4, 5, 1), (1, 3, 10_000)])
def test_vector_codes(spark, parts, entries, few):
    rows = odd_vectors(300)
    found = vectorcodes.compress(frame(spark, rows), parts=parts, entries=entries, rounds=3)
    got = vectorcodes.with_label_error(found.rows, few_labels=few, salts=3).select("vec_id", "code", "error", "label_error").collect()
    want, digest = plain_codes(rows, 6, parts, entries, 3)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert found.digest() == digest


def test_vector_codes_of_huge_components(spark):
    """Products beyond 64 bits: Python integers, errors at the largest long."""
    rows = [(i, [x, 1.0, -x, 0.5], i % 2) for i, x in enumerate([1e9, -1e9, 1e12, 3e15, 1e30, 2.0, 3e4, 1e9 + 64, 7e8])]
    rows = [(i, v, c) for i, v, c in rows if abs(v[0]) < 2e15]
    found = vectorcodes.compress(frame(spark, rows), parts=2, entries=2, rounds=2)
    want, digest = plain_codes(rows, 4, 2, 2, 2)
    got = vectorcodes.with_label_error(found.rows).select("vec_id", "code", "error", "label_error").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert found.digest() == digest
    beyond = vectorcodes.compress(frame(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 0.0], 1), (3, [3e38, 1.0], 1)]), parts=2, entries=2, rounds=1)
    assert beyond.rows.count() == 3


def test_no_vector_codes(spark):
    found = vectorcodes.compress(frame(spark, [(1, None, 1)]))
    assert vectorcodes.with_label_error(found.rows).count() == 0
    assert found.digest() == sha256(b"").hexdigest()


def test_products_are_exact():
    rnd = random.Random(3)
    for bits in (1, 12, 26, 30, 31, 40, 61, 63):
        x = [[rnd.randint(-(2**bits), 2**bits - 1) for _ in range(9)] for _ in range(7)]
        y = [[rnd.choice([-(2**bits), 2**bits - 1, 0, 1, -1]) for _ in range(9)] for _ in range(5)]
        got = integers.products(np.array(x), np.array(y))
        assert [[int(v) for v in r] for r in got] == [[sum(a * b for a, b in zip(r, s, strict=True)) for s in y] for r in x]
        assert got.dtype == (np.int64 if bits < 30 else got.dtype)


# ---- archives --------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, file string, offset long, head string, payload string, record_id string, _salt int, first_id string"


def odd_pages() -> list[tuple]:
    long = "<p>" + "wörd " * 60_000 + "</p>"
    same = "<html>" + "same " * 40 + "</html>"
    rows = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "short"), (4, "", "short"), (5, "http://a/ b\n c", same), (6, "http://a/6", same), (6, "http://a/6", same)]
    rows += [(7, "http://a/7", long), (8, "http://a/7", long), (9, "http://x/é", "\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nxx\r\n\r\n" * 5), (None, "http://n/", "n" * 100)]
    rows += [(10, "http://a/10", "n" * 99), (11, "http://a/11", "n" * 99), (-3, "http://a/12", "n" * 100), (13, "dns:a", "é" * 50), (12, "ftp://a", "é" * 50), (14, "filedesc://a", "x"), (15, "no scheme", "y" * 300)]
    rows += [(20, "http://a/20", "HTTP/1.0 200 OK\n\nhttp://x 1.1.1.1 20010101000000 text/html 5\n" * 3), (21, "http://a/21", "HTTP/1.0 200 OK\n\nhttp://x 1.1.1.1 20010101000000 text/html 5\n" * 3)]
    rows += [(100 + i, f"http://hot/{i}", same) for i in range(300)] + [(500 + i, f"http://own/{i}", f"own page {i} " * 20) for i in range(60)]
    return rows


def plain_archive(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            again = len(raw) >= 100 and n > 0
            out.append((i, len(raw), sha256(raw).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("version", [1, 2])
def test_pages_through_archives(spark, tmp_path, version):
    pages = spark.createDataFrame([(*r, "f", 1, "h", "p", "r", 0, "x") for r in odd_pages()], PAGES)
    archives.write_arc(archives.page_captures(pages), f"{tmp_path}/arc", version=version, per_file=9)
    read = archives.read_arc(spark, f"{tmp_path}/arc")
    assert read.where("problem is not null").count() == 0
    assert {r[0] for r in read.select("version").distinct().collect()} == {version}
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", key=archives.page_id_of(F.col("head")), per_file=7)
    back = archives.read_warc(spark, f"{tmp_path}/warc")
    assert back.where("problem is not null").count() == 0
    replies = back.where("record_type in ('response', 'revisit')").withColumn("page_id", archives.page_id_of(F.col("head")))
    got = archives.resolve(replies, "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_archive(odd_pages())
    bodies = {(r["page_id"], bytes(r["payload"])) for r in replies.where("record_type = 'response'").collect()}
    assert (7, odd_pages()[7][2].encode()) in bodies
    assert replies.where(F.col("stated_digest") != F.concat(F.lit("sha256:"), "payload_digest")).where("record_type = 'response'").count() == 0
    ids = [r[0] for r in back.select("record_id").collect()]
    assert len(ids) == len(set(ids)) and all(i.startswith("<urn:uuid:") and i[24] == "5" for i in ids)


def test_no_pages(spark, tmp_path):
    archives.write_arc(archives.page_captures(spark.createDataFrame([], PAGES)), f"{tmp_path}/arc")
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert archives.read_warc(spark, f"{tmp_path}/warc").count() == 0


def test_captures_without_fields(spark, tmp_path):
    """Null and empty fields still make lines that parse."""
    rows = [(None, None, None, None, None, None), ("http://a/ b", "", "yesterday", "text / html", 404, bytearray(b"HTTP/1.0 404 No\r\n\r\n\x80")), ("http://c", "1.1.1.1", "1999", "a/b", 200, bytearray())]
    captures = spark.createDataFrame(rows, "url string, ip string, date string, mime string, status int, content binary")
    for version in (1, 2):
        archives.write_arc(captures, f"{tmp_path}/{version}", version=version)
        got = archives.read_arc(spark, f"{tmp_path}/{version}").where("url not like 'filedesc%'")
        found = sorted((r["url"], r["date"], r["mime"], r["status"], bytes(r["payload"]), r["problem"]) for r in got.collect())
        status = (lambda n: n) if version == 2 else (lambda n: None)
        assert found == [
            ("http://a/%20b", "19700101000000", "text/html", status(404), b"\x80", None), ("http://c", "1999", "a/b", status(200), b"", None), ("unknown:", "19700101000000", "-", None, b"", None),
        ]


def legacy(version: int) -> bytes:
    """A hand-written archive: replies, a name look-up, a page without a head, bytes that aren't UTF-8, junk and a short last record."""
    names = " ".join(archives.FIELDS[version])
    described = f"{version} 0 house\n{names}\n\n".encode()
    rest = b"" if version == 1 else b" 200 - - 0 f.arc"

    def record(url: bytes, date: bytes, mime: bytes, content: bytes, declared: int | None = None) -> bytes:
        return b"%s 10.0.0.1 %s %s%s %d\n%s\n" % (url, date, mime, rest, len(content) if declared is None else declared, content)

    return b"".join([
        record(b"filedesc://f.arc", b"19970102030405", b"text/plain", described), record(b"http://a/ page", b"19970102030405", b"text/html", b"HTTP/1.0 200 OK\r\n\r\nbody\n\nend"),
        record(b"dns:a", b"1997", b"text/dns", b"19970102\na. 10.0.0.1"), b"\n\nnot a header\nneither is this 12\n", record(b"http://a/old", b"19970102030405", b"text/html", b"<html>no head"),
        record(b"http://a/img", b"19970102030405", b"image/gif", b"HTTP/1.0 200 OK\n\n\xff\xfe\x00\r\nGIF"), record(b"http://a/cut", b"19970102030405", b"text/html", b"HTTP/1.0 200 OK\r\n\r\ncut", 999),
    ])


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packing", ["plain", "one", "members"])
def test_legacy_files(spark, tmp_path, version, packing):
    raw = legacy(version)
    half = raw.index(b"dns:a")
    packed = {"plain": raw, "one": gzip.compress(raw), "members": gzip.compress(raw[:half]) + gzip.compress(raw[half:]) + b"\0" * 20}[packing]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "f.arc").write_bytes(packed)
    rows = {r["url"] or r["problem"]: r for r in archives.read_arc(spark, f"{tmp_path}/arc").collect()}
    assert list(rows) == ["filedesc://f.arc", "http://a/ page", "dns:a", "header", "http://a/old", "http://a/img", "http://a/cut"]
    assert bytes(rows["http://a/ page"]["payload"]) == b"body\n\nend" and bytes(rows["http://a/img"]["payload"]) == b"\xff\xfe\x00\r\nGIF"
    assert rows["http://a/cut"]["problem"] == "truncated" and bytes(rows["http://a/cut"]["payload"]) == b"cut\n"
    assert all(r["offset"] == raw.index((r["url"] or "not a header").encode()) for r in rows.values())
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    back = {r["url"]: r for r in archives.read_warc(spark, f"{tmp_path}/warc").collect()}
    kinds = {u: (r["record_type"], r["mime"], r["date"]) for u, r in back.items() if u}
    assert kinds["dns:a"] == ("resource", "text/dns", "1997-01-01T00:00:00Z")
    assert kinds["http://a/old"] == ("resource", "text/html", "1997-01-02T03:04:05Z")
    assert kinds["http://a/img"][:2] == ("response", "application/http;msgtype=response")
    assert bytes(back["http://a/img"]["payload"]) == b"\xff\xfe\x00\r\nGIF" and bytes(back["dns:a"]["payload"]) == b"19970102\na. 10.0.0.1"
    assert back["http://a/img"]["payload_digest"] == sha256(b"\xff\xfe\x00\r\nGIF").hexdigest()


def test_broken_packing(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    packed = gzip.compress(legacy(1))
    (tmp_path / "arc" / "f.arc.gz").write_bytes(packed[: len(packed) - 40])
    assert archives.read_arc(spark, f"{tmp_path}/arc").where("problem = 'packing'").count() == 1


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_warc", "op13_vector_codes"])
def test_plan_of_the_query(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
