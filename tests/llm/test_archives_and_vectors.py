"""WARC packages and vector search."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zipfile
from collections import Counter

import numpy as np
import pytest

from stemma.llm import bitsliced, warc_zip

PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = [(5, "http://a/x y", "<p>é</p>"), (3, "u", "<p>é</p>"), (9, None, None), (8, "u", ""), (7, "u", "z" * 100_000), (11, "u", "<p>é</p>"), (None, "u", "none"), (None, "u", "<p>é</p>"), (4, "u", "WARC/1.1\r\n\r\nPK\x05\x06")]
    got = Counter(tuple(r) for r in warc_zip.round_trip_report(spark.createDataFrame(rows, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for i, _, html in rows:
        payload = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(ids) if ids else None
        want[(i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert got == want
    assert warc_zip.round_trip_report(spark.createDataFrame([], PAGES)).count() == 0


def test_most_pages_are_one_payload(spark):
    rows = [(k, "u", "same" * 30_000 if k % 5 else f"page {k}") for k in range(400)]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_zip.round_trip_report(spark.createDataFrame(rows, PAGES).repartition(9)).collect()}
    assert got == {k: (len(h), "revisit" if k % 5 and k != 1 else "response", 1 if k % 5 and k != 1 else None) for k, _, h in rows}


@pytest.mark.parametrize("packed", [True, False])
def test_packages_are_zip_files(spark, packed):
    rows = [(k, "u", f"page {k}") for k in range(20)]
    folder, packages = warc_zip.write_packages(spark.createDataFrame(rows, PAGES), packed=packed)
    paths = [r["path"] for r in packages.collect()]
    assert sum(r["records"] for r in packages.collect()) == 20
    for path in paths:
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None
            assert z.namelist() == ["archive/data.warc" + ".gz" * packed, "indexes/index.cdxj"] and all(i.compress_type == 0 for i in z.infolist())
    records = warc_zip.read_packages(folder, packages).collect()
    assert {r["payload"].decode() for r in records} == {f"page {k}" for k in range(20)}


@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 in it"])
def test_reader_on_another_writers_file(comment):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.warc", b"stored bytes")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 1000, zipfile.ZIP_DEFLATED)
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"sixty-four")
        z.comment = comment
    reader = warc_zip.ZipReader(buffer, len(buffer.getvalue()))
    got = {m.name: reader.read(m.start, m.size) for m in reader.members()}
    assert got == {"a.warc": b"stored bytes", "big": b"sixty-four"}
    with pytest.raises(ValueError):
        list(warc_zip.ZipReader(io.BytesIO(b"no archive at all......"), 23).members())


def record(kind, k, payload, http=True):
    block = (b"HTTP/1.1 200 OK\r\n\r\n" if http else b"") + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{k}>\r\nWARC-Target-URI: http://x/{k}\r\nContent-Type: {'application/http; msgtype=response' if http else 'application/warc-fields'}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_packages_of_another_writer(spark, tmp_path, monkeypatch):
    """Several archives and indexes: plain and by gzip members, JSON and columns, and one archive that no index names."""
    monkeypatch.setattr(warc_zip, "RANGE_BYTES", 150)
    r = np.random.default_rng(5)
    payloads = [bytes(r.integers(0, 256, int(r.integers(0, 3000)), dtype=np.uint8)) for _ in range(40)] + [b"\r\n\r\nWARC/1.0"]
    records = [record("response", k, x) for k, x in enumerate(payloads)]
    info = record("warcinfo", "info", b"software: x\r\n", False)
    parts = {"archive/a.warc": (records[:10], False), "archive/b.warc.gz": (records[10:20], True), "deep/c.warc": ([info, *records[20:30]], False), "deep/d.warc.gz": ([info, *records[30:]], True)}
    places = {}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for name, (held, packed) in parts.items():
            data = b""
            for x in held:
                x = gzip.compress(x) if packed else x
                places.setdefault(name, []).append((len(data), len(x)))
                data += x
            z.writestr(name, data)
        z.writestr("indexes/a.cdx", " CDX N b a m s k r M S V g\n" + "".join(f"key 2020 http://x text/html 200 ABC - - {n} {at} a.warc\n" for at, n in places["archive/a.warc"][::-1]))
        z.writestr("indexes/b.cdxj.gz", gzip.compress("".join(f'key 2020 {{"offset": "{at}", "filename": "b.warc.gz"}}\n' for at, _ in places["archive/b.warc.gz"]).encode()))
        z.writestr(zipfile.ZipInfo("pages.jsonl"), b"x" * 1000, zipfile.ZIP_DEFLATED)
    size = (tmp_path / "x.zip").stat().st_size
    packages = spark.createDataFrame([(str(tmp_path / "x.zip"), size)], "path string, bytes long")
    got = warc_zip.read_packages(f"file://{tmp_path}", packages).collect()
    want = {f"<urn:{k}>": ("response", x, f"http://x/{k}") for k, x in enumerate(payloads)}
    assert {g["record_id"]: (g["record_type"], bytes(g["payload"]), g["target_uri"]) for g in got if g["record_type"] == "response"} == want
    assert Counter(g["record_type"] for g in got) == {"response": 41, "warcinfo": 2} and all(g["page_id"] is None for g in got)
    with zipfile.ZipFile(tmp_path / "y.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.warc", records[0] * 9)
    bad = spark.createDataFrame([(str(tmp_path / "y.zip"), (tmp_path / "y.zip").stat().st_size)], "path string, bytes long")
    with pytest.raises(Exception, match="no byte ranges"):
        warc_zip.read_packages(f"file://{tmp_path}", bad).collect()


def test_record_ids_and_urls(spark):
    """Ids differ for rows without a page, for pages with several payloads or addresses, and addresses keep all their characters."""
    rows = [(None, "http://a/é ü\t?q=%20#x", "same")] * 3 + [(1, "http://a", "one"), (1, "http://b", "one"), (1, "http://a", "two"), (2, "http://c", "one")]
    docs = spark.createDataFrame(rows, PAGES).withColumn("sha", bitsliced.F.lit(1)).withColumn("first", bitsliced.F.lit(1)).withColumn("revisit", bitsliced.F.lit(1))
    folder, packages = warc_zip.write_packages(docs)
    records = warc_zip.read_packages(folder, packages).collect()
    assert len({r["record_id"] for r in records}) == 7
    assert Counter(r["record_type"] for r in records) == {"response": 6, "revisit": 1}
    (revisit,) = [r for r in records if r["record_type"] == "revisit"]
    assert [r["target_uri"] for r in records if r["record_id"] == revisit["refers_to_id"]] == ["http://a"]
    assert {r["target_uri"] for r in records if r["page_id"] is None} == {"http://a/%C3%A9%20%C3%BC%09?q=%20#x"}


def brute(vectors, k, every):
    out = {}
    q = {}
    for i, v in vectors:
        if i is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        q.setdefault(i, []).append(tuple(int(np.floor(64 * float(np.float32(c)))) for c in v))
    for i in q:
        if i % every == 0:
            for w in q[i]:
                scored = sorted((-sum(a * b for a, b in zip(w, x, strict=False)), j) for j in q if j != i for x in q[j])
                out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return out


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(8)
    vectors = [(int(k), [float(v) for v in r.normal(0, 0.3, 6).astype(np.float32)]) for k in range(150)]
    vectors += [(200 + k, [0.5, -0.5, 0.25, 0.0, 0.0, 0.0]) for k in range(60)]  # ties beyond k
    vectors += [(400, None), (420, []), (440, [None, 1.0]), (460, [float("nan")] * 6), (480, [float("inf")] * 6), (None, [1.0] * 6), (500, [1.0, 2.0]), (501, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", bitsliced.F.lit("x"))
    got = {}
    for x in bitsliced.search_report(df, 20, 20).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert got == brute(vectors, 20, 20)
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>")
    assert bitsliced.search_report(few).count() == 2
    assert bitsliced.search_report(few.limit(0)).count() == 0


@pytest.mark.parametrize("rows_in_block", [1, 7, 40])
def test_top_k_over_many_blocks(spark, monkeypatch, rows_in_block):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", rows_in_block)
    r = np.random.default_rng(18)
    vectors = [(int(k), [float(v) for v in r.normal(0, 0.4, int(r.integers(1, 6))).astype(np.float32)]) for k in range(90)]
    vectors += [(7, [0.25, 0.5]), (7, [0.25, 0.5]), (40, [0.25, 0.5])] + [(200, [0.5, 0.5, 0.5])] * 12  # repeated rows under one id
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for x in bitsliced.search_report(df, 10, 8).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(got) == {*range(0, 90, 10), 200}
    for k in set(got) - {40}:  # two different vectors have the id 40: both are answered
        q = [tuple(int(np.floor(64 * float(np.float32(c)))) for c in v) for i, v in vectors if i == k][0]
        scored = sorted((-sum(a * int(np.floor(64 * float(np.float32(b)))) for a, b in zip(q, v, strict=False)), i) for i, v in vectors if i != k)
        assert got[k] == [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:8])]


def test_scores_that_do_not_fit(spark):
    big = spark.createDataFrame([(0, [3e7] * 9), (1, [3e7] * 9)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        bitsliced.search_report(big).collect()


def test_sums_of_slices():
    r = np.random.default_rng(1)
    rows = r.integers(-70, 70, (130, 5))
    index = bitsliced.BitSlicedIndex(rows)
    weights = [3, -5, 0, 64, -1]
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << k for k, s in enumerate(index.add(weights)))
    want = rows @ np.array(weights)
    assert len(set((total - want).tolist())) == 1
    top = index.top(weights, 7, np.array([0]))
    assert sorted(want[top].tolist()) == sorted(np.sort(want[1:])[-7:].tolist())
