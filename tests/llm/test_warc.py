import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

from shipwatch.llm import warc as A
from shipwatch.llm.store import new_folder

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    top = {}
    for page, _, h in rows:
        body = (h or "").encode()
        if len(body) >= least and page is not None:
            top[body] = max(page, top.get(body, page))
    out = []
    for page, _, h in rows:
        body = (h or "").encode()
        first = top.get(body) if len(body) >= least else None
        revisit = first is not None and first != page
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    out = [(k, f"http://x.example/{k}?a=b c&é", f"<p>{k % 6}</p>" * (k % 6)) for k in range(40)]
    out += [(100, None, None), (101, "u", ""), (102, "u", "é\r\n\r\nWARC/1.1\r\n" * 20000), (103, "u", "x" * 700001),
            (None, "u", "<p>1</p>"), (None, "v", "only here"), (7, "w", "<p>1</p>"), (104, "u", "y" * (1 << 18)), (105, "u", "z" * (1 << 18) * 2)]
    return out


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, rows, least):
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", chunk string, _sha1 int").repartition(3)
    got = A.archived(pages, new_folder(spark, "warc"), least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, least)


def test_chunks_carry_running_digests_and_payloads(spark, rows):
    folder = new_folder(spark, "warc")
    manifest = A.write_archives(A.record_chunks(spark.createDataFrame(rows, SCHEMA), chunk=1000), folder)
    chunks = A.read_archives(manifest, chunk=4096).where("record_type = 'response'").collect()
    by_page = {}
    for c in sorted(chunks, key=lambda c: c.chunk):
        by_page.setdefault((c.page_id, c.archive, c.url), []).append(c)
    bodies = {}
    for (page, _, url), parts in by_page.items():
        assert [p.chunk for p in parts] == list(range(len(parts))) and [p.last for p in parts] == [False] * (len(parts) - 1) + [True]
        done = b""
        for p in parts:
            assert len(p.data) <= 4096
            done += bytes(p.data)
            assert bytes(p.sha1) == hashlib.sha1(done).digest() and p.bytes_so_far == len(done)
        bodies[page, url] = done
    for page, url, h in rows:
        if (page, url or "") in bodies:
            assert bodies[page, url or ""] == (h or "").encode()
    names = [r.archive for r in manifest.collect()]
    assert all(gzip.open(n.removeprefix("file:")).read(8) == b"WARC/1.1" for n in names)


def test_damage_is_an_error(tmp_path):
    body = b"hello"
    head = A._header(5, "u", False, None, hashlib.sha1(body).digest(), len(body))
    good = gzip.compress(head + body + b"\r\n\r\n")
    assert [r["data"] for r in A.parse(pa.BufferReader(good), "a")] == [body]
    for bad in (gzip.compress(head + b"hullo\r\n\r\n"), gzip.compress(head + b"hel"), gzip.compress(head + body + b"12345678"),
                good + gzip.compress(b"WARC/1.1\r\nWARC-Type")):
        with pytest.raises(ValueError):
            list(A.parse(pa.BufferReader(bad), "a"))


def test_empty_table(spark):
    assert A.archived(spark.createDataFrame([], SCHEMA), new_folder(spark, "warc")).collect() == []
