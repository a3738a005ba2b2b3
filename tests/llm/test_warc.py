import base64
import gzip
import hashlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from featuremill.llm import warc as W

from .helpers import column_rows, groups

PAGES = "page_id long, url string, html string"


def want(pages, least=0):
    by = groups(((h or "").encode(), i) for i, h in pages)
    out = {}
    for data, ids in by.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for i in ids:
            hold = i == max(ids) or len(data) < least
            out[i] = (len(data), digest, "response" if hold else "revisit", None if hold else max(ids))
    return out


def table(df):
    return {r[0]: tuple(r)[1:] for r in df.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}


def test_query_round_trip(spark, sf):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in entry.queries()["op7_warc"](spark, sf).collect()}
    assert got == want(column_rows(sf, "pages", "page_id", "html"))


@pytest.mark.parametrize("least", [0, 10])
def test_chunks_copies_and_odd_rows(spark, tmp_path, least):
    rows = [(1, "http://a b\n", "x" * 5000), (2, None, "x" * 5000), (3, "u: v", "x" * 5000), (4, "u", ""), (5, "u", None), (6, "ü", "\r\n\r\nWARC/1.1\r\n\r\n" * 50), (7, "u", "é" * 333), (8, "u", "short"), (9, "u", "short")]
    df = spark.createDataFrame(rows, PAGES).withColumn("data", F.lit(1)).withColumn("row", F.lit("r")).repartition(3)
    folder = str(tmp_path / "w")
    W.archive(df, folder, chunk=64, least=least)
    read = W.read_archives(spark, folder, chunk=64)
    assert table(W.payload_table(read)) == want([(i, h) for i, _, h in rows], least)
    parts = groups((r.record_id, r) for r in read.collect())
    for i, _, h in rows:
        own = sorted(parts[i], key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in own] == list(range(len(own))) and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        if own[0].record_type == "response":
            data = b"".join(bytes(r.data) for r in own)
            assert data == (h or "").encode()
            upto = 0
            for r in own:
                upto += len(r.data)
                assert r.bytes_so_far == upto and base64.b32decode(r.digest_so_far) == hashlib.sha1(data[:upto]).digest()
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert whole.count(b"WARC-Record-ID") == len(rows)
    assert not list((tmp_path / "w").glob(".part*"))


def test_repeated_null_and_empty(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "same"), (1, "u", "other"), (None, "u", "same"), (None, None, None)]
    W.archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"))
    got = W.payload_table(W.read_archives(spark, str(tmp_path / "a"))).collect()
    assert sorted((str(r.record_id), r.record_type) for r in got) == [
        ("1", "response"), ("1", "response"), ("1", "revisit"), ("1", "revisit"), ("None", "response"), ("None", "revisit")]
    assert all(r.payload_bytes is not None for r in got)
    W.archive(spark.createDataFrame([], PAGES), str(tmp_path / "b"))
    assert W.payload_table(W.read_archives(spark, str(tmp_path / "b"))).count() == 0


@pytest.mark.parametrize("least,chunk", [(0, 3), (6, 3), (6, 64)])
def test_a_record_for_each_row(spark, tmp_path, least, chunk):
    """Rows that swap null and text, and rows repeated many times, whose payloads are long and short."""
    rows = [(1, None, "a"), (1, "a", None), (1, "", "a"), (1, "a", "")] + [(2, "u", "long enough")] * 5 + [(3, "u", "tiny")] * 4 + [(3, None, None)] * 3 + [(4, "u", "long enough")] * 2
    W.archive(spark.createDataFrame(rows, PAGES).repartition(4), str(tmp_path / "w"), least=least, chunk=chunk)
    read = W.read_archives(spark, str(tmp_path / "w"), chunk=chunk)
    got = W.payload_table(read).collect()
    assert sorted(r.record_id for r in got) == sorted(i for i, _, _ in rows)
    assert read.select("urn").distinct().count() == len(rows)
    sizes = groups((r.record_id, r.payload_bytes) for r in got)
    for i in (1, 2, 3, 4):
        assert sorted(sizes[i]) == sorted(len(h or "") for j, _, h in rows if j == i)
    for text in ("long enough", "tiny", "a", ""):
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        held = [r for r in got if r.payload_digest == digest and r.record_type == "response"]
        assert len(held) == (1 if len(text) >= least else sum((h or "") == text for _, _, h in rows))
    assert all(r.refers_to == 4 for r in got if r.record_type == "revisit" and r.record_id in (2, 4))


def test_files_roll_and_a_repeated_task_changes_nothing(spark, tmp_path):
    rows = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(40)]
    df, folder = spark.createDataFrame(rows, PAGES), str(tmp_path / "w")
    for _ in range(2):
        chunks = W.chunks_of(df, "page_id", "html", "url")
        records = W.plan_revisits(W.digests(chunks)).join(df.select(W.row_name("page_id", "url", "html"), "url"), "row")
        files = W.write_archives(chunks, records, folder, file_bytes=4000).collect()
    found = [f for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(folder)) if f.base_name.startswith("part")]
    assert len(found) == len(files) > 3
    assert len(table(W.payload_table(W.read_archives(spark, folder)))) == 40


def test_a_wrong_digest_is_found(spark, tmp_path):
    W.archive(spark.createDataFrame([(1, "u", "text")], PAGES), str(tmp_path))
    f = next(tmp_path.glob("*.warc.gz"))
    f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"text\r\n", b"test\r\n")))
    with pytest.raises(Exception, match="digest differs"):
        W.payload_table(W.read_archives(spark, str(tmp_path))).collect()
