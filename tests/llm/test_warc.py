from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.llm import warc
from parley.llm.common import shared_path, stored

PAGES = "page_id long, url string, html string"


def brute(rows):
    payloads = [(r[2] or "").encode() for r in rows]
    out = Counter()
    for (page, _, _), own in zip(rows, payloads):
        same = [r[0] for r, p in zip(rows, payloads) if p == own and r[0] is not None]
        top = max(same) if len(own) >= 1000 and sum(p == own for p in payloads) > 1 and same else None
        revisit = top is not None and page != top
        out[page, len(own), hashlib.sha1(own).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    return out


def rows():
    big, odd = "x" * 5000, "é\r\n\r\nWARC/1.1\r\n" * 200
    return [
        (1, "http://a/1", big), (2, "http://a/2", big), (7, "http://a/7", big), (3, "http://a/ü \r\nX: y", None), (4, None, ""), (5, "http://b", odd),
        (6, "http://c", odd), (8, "http://d", "small"), (9, "http://d", "small"), (10, "http://e", "y" * 999), (11, "http://e", "y" * 999),
        (12, "http://f", "z" * 3_000_000), (13, "http://g", "é" * 500), (14, "http://g", "é" * 500), (None, "http://h", big),
    ]


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), PAGES).withColumns({c: F.lit("clash") for c in ("payload", "n", "response_id", "archive")})
    got = warc.round_trip(pages.repartition(3), payloads=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows())
    for r in got:
        text = next(t for p, _, t in rows() if p == r.page_id)
        assert r.payload == ((text or "").encode() if r.record_type == "response" else b"")
    assert warc.round_trip(pages.where("false")).collect() == []


def test_members_and_sidecar(spark, tmp_path):
    pages = spark.createDataFrame(rows()[:8], PAGES).coalesce(1)
    folder = shared_path(spark, "warc-test")
    archives = stored(warc.write_archives(warc.plan_records(pages), f"{folder}/in"), "archives")
    members = stored(warc.normalise(archives, f"{folder}/out", 1), "members")
    index = stored(warc.read_index(members, f"{folder}/out"), "index").orderBy("offset").collect()
    monolithic = open(archives.first()["archive"], "rb").read()
    whole = open(index[0]["archive"], "rb").read()
    once = zlib.decompressobj(31)
    assert len(once.decompress(monolithic)) and once.eof and not once.unused_data  # one stream over the file
    assert gzip.decompress(whole) == gzip.decompress(monolithic)
    assert sum(r["length"] for r in index) == len(whole) and len(index) == 8
    sidecar = [line.split("\t") for line in open(index[0]["archive"] + ".idx").read().splitlines()]
    assert [(int(a), int(b)) for a, b, *_ in sidecar] == [(r["offset"], r["length"]) for r in index]
    assert [(r["kind"], r["record_id"]) for r in index] == [(kind, record) for *_, kind, record in sidecar]
    for r in index:
        member = zlib.decompressobj(31)
        assert member.decompress(whole[r["offset"] : r["offset"] + r["length"]]).startswith(b"WARC/1.1\r\n") and member.eof


def test_streams_in_bounded_pieces():
    body = b"q" * 10_000_000
    source = io.BytesIO(gzip.compress(warc.record(1, "u", body, len(body), hashlib.sha1(body).hexdigest(), "response", None) * 3))
    out = []
    found = list(warc.normalise_stream(source, lambda part: out.append(part) or len(part)))
    assert len(found) == 3 and found[1][1] == found[0][2] and max(map(len, out)) < 1 << 20
    headers, http, payload = warc.read_member(b"".join(out)[found[2][1] :])
    assert payload == body and headers["warc-type"] == "response" and http["content-length"] == str(len(body))


def test_folders_need_a_scheme(tmp_path):
    files, path = warc._open_folder(f"file:{tmp_path}/a")
    assert path == f"{tmp_path}/a" and files.get_file_info(path).type.name == "Directory"
    with pytest.raises(ValueError):
        warc._open_folder(f"{tmp_path}/b")


def test_a_sidecar_must_be_whole(spark):
    pages = spark.createDataFrame(rows()[:8], PAGES).coalesce(1)
    folder = shared_path(spark, "warc-test")
    archives = stored(warc.write_archives(warc.plan_records(pages), f"{folder}/in"), "archives")
    members = stored(warc.normalise(archives, f"{folder}/out", 1), "members")
    short = members.withColumn("n_records", F.col("n_records") + 1)
    with pytest.raises(Exception, match="records, not"):
        warc.read_index(short, f"{folder}/out").collect()
