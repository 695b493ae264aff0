import hashlib

import pytest

from seriesloom.functions.staging import new_path
from seriesloom.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_payloads_with_magic_lines_come_back_whole(spark, small_splits):
    rows = [(1, "u1", "plain é"), (2, None, None), (3, "a b\r\nc", "x" + FAKE + "y"), (4, "u4", FAKE * 3), (5, "u5", "WARC/1.0\r\n"), (6, "u6", "WARC/1.0\r\nContent-Length: 100000\r\n\r\nq"), (7, "u", "z" * 1500), (8, "u", "z" * 1500), (9, "u", FAKE[:-4]), (10, "u", "\r\n\r\n"), (None, "n", "nul"), (11, "long", "é" * 30_000)]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, payload int").coalesce(2)
    path = new_path(spark, "test")
    warc.write_archives(pages, path, records=5)
    got = warc.read_archives(spark, path).collect()
    assert sorted(bytes(r.payload) for r in got) == sorted([(r[2] or "").encode() for r in rows if r[0] != 7] + [b""])
    revisit = [r for r in got if "WARC-Type: revisit" in r.head]
    assert len(revisit) == 1 and "WARC-Refers-To: <urn:page:8>" in revisit[0].head
    assert "WARC-Target-URI: a%20b%20%20c\r\n" in next(r.head for r in got if "<urn:page:3>" in r.head)


def test_digests_match_the_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in warc.op2_warc_boundary_chain(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        body = (p.html or "").encode()
        assert got[p.page_id].payload_bytes == len(body)
        assert got[p.page_id].payload_digest == hashlib.sha1(body).hexdigest()


def test_revisits_resolve_to_the_full_payload(spark, tmp_path):
    rows = [(1, "u", "z" * 1000), (2, "u", "z" * 1000), (3, "u", "z" * 999), (4, "u", "z" * 999), (5, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.op2_warc_boundary_chain(spark, str(tmp_path)).collect()}
    assert got == {1: ("revisit", 2, 1000), 2: ("response", None, 1000), 3: ("response", None, 999), 4: ("response", None, 999), 5: ("response", None, 0)}


def test_a_file_that_starts_with_something_else_has_no_records(spark):
    path = new_path(spark, "test")
    spark.createDataFrame([("junk " + FAKE,)], "value string").coalesce(1).write.text(path)
    assert warc.read_archives(spark, path).count() == 0


def test_repeated_ids_keep_their_own_payloads(spark, tmp_path):
    rows = [(5, "u", "A" * 2000), (5, "u", "B" * 3000), (3, "u", "A" * 2000), (2, "u", "B" * 3000), (5, "u", "A" * 2000), (None, "u", "C" * 1200), (None, "u", "C" * 1200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op2_warc_boundary_chain(spark, str(tmp_path)).collect())
    keeper = {"A": 5, "B": 5, "C": None}
    want = sorted((i or 0, len(h), hashlib.sha1(h.encode()).hexdigest(), "response" if i == keeper[h[0]] else "revisit", None if i == keeper[h[0]] else keeper[h[0]]) for i, _, h in rows)
    assert got == want


def test_no_pages_give_no_records(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string, extra int").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op2_warc_boundary_chain(spark, str(tmp_path)).count() == 0


def test_archives_inside_payloads_come_back_whole(spark, small_splits):
    rows = [(i, f"u{i}", FAKE * (i % 40) + f"tail {i}") for i in range(120)]
    path = new_path(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(3), path, records=17)
    got = warc.read_archives(spark, path).collect()
    assert sorted(bytes(r.payload) for r in got if "revisit" not in r.head) == sorted(r[2].encode() for r in rows)


def test_a_page_of_many_magic_lines(spark, tmp_path):
    """Pieces inside one payload are put together again, byte for byte."""
    html = "".join(f"{warc.MAGIC}{i} of an archive that quotes\r\n\r\nitself é" for i in range(5000))
    pages = spark.createDataFrame([(1, "u", html), (2, "v", "short"), (3, "w", html + "end")], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/warc")
    got = sorted(bytes(r.payload).decode() for r in warc.read_archives(spark, f"{tmp_path}/warc").collect() if "response" in r.head)
    assert got == sorted([html, "short", html + "end"])
