"""Legacy parsing, conversion and the written archives, as exact round trips."""

import base64
import hashlib
import random
import zlib

import pytest

from eligspark.llm import warc as A
from tests.llm.fixtures import prose


def legacy(n=5, seed=1):
    rnd = random.Random(seed)
    return [A.page_as_legacy(k, f"http://h/{k} x", prose(rnd, rnd.choice([0, 3, 200])).encode()) for k in range(n)]


@pytest.mark.parametrize("version", [1, 2])
def test_legacy_round_trip(version):
    records = legacy()
    back = list(A.parse_legacy(A.legacy_file(records, version)))
    assert [r.block for r in back] == [r.block for r in records]
    assert [r.fields["URL"] for r in back] == [f"http://h/{k}%20x" for k in range(5)]
    assert list(back[0].fields) == A.FIELDS[version]


def test_malformed_legacy_is_refused():
    data = A.legacy_file(legacy(), 1)
    for broken in (data[:-20], data.replace(b"1 0 pages", b"3 0 pages"), data.replace(b"Archive-length", b"Archive-size!!"), b"http://x 0 20200101000000 text/html 3\nabc\n", data + b"http://x 0.0.0.0 20200101000000 text/html nine\nabc\n"):
        with pytest.raises(ValueError):
            list(A.parse_legacy(broken))
    assert list(A.parse_legacy(b"")) == []


def test_conversion():
    record = next(A.parse_legacy(A.legacy_file([A.page_as_legacy(3, "http://a/", b"<p>x</p>")], 2)))
    warc = A.convert(record)
    assert warc.headers["WARC-Type"] == "response" and warc.headers["WARC-Date"] == "2020-01-01T00:00:03Z"
    assert warc.headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    assert warc.headers == A.convert(record).headers
    dns = A.LegacyRecord(record.fields | {"URL": "dns:a", "Content-type": "text/dns"}, b"a 1.2.3.4")
    assert A.convert(dns).headers["WARC-Type"] == "resource" and A.convert(dns).headers["Content-Type"] == "text/dns"


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_archive_parsing_by_pieces(step):
    records = [A.convert(r) for r in A.parse_legacy(A.legacy_file(legacy(), 1))]
    data = b"".join(A.record_bytes(r) + b"\r\n\r\n" for r in records)
    back = list(A.parse_archive(iter([data[k : k + step] for k in range(0, len(data), step)])))
    assert [b.block for b in back] == [r.block for r in records]
    with pytest.raises(ValueError):
        list(A.parse_archive(iter([data[:-30]])))


def test_a_member_of_its_own_for_each_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "FILE_BYTES", 3000)
    pages = spark.createDataFrame([(k, f"http://h/{k}", prose(random.Random(k), 80)) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    A.write_archives(A.archive_files(pages), str(tmp_path / "w"))
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 3 and all(f.stat().st_size < 3000 + 2000 for f in files)
    seen = 0
    for f in files:
        data, members = f.read_bytes(), []
        while data:
            machine = zlib.decompressobj(31)
            members.append(machine.decompress(data))
            data = machine.unused_data
        assert members[-1] == b"" and all(len(list(A.parse_archive(iter([m])))) == 1 for m in members[:-1])
        seen += len(members) - 1
    assert seen == 40 and A.read_archives(spark, str(tmp_path / "w")).count() == 40


@pytest.mark.parametrize("packed", [False, True])
def test_legacy_files_are_read(spark, tmp_path, packed):
    for version in (1, 2):
        data = A.legacy_file(legacy(5, version), version)
        (tmp_path / f"{version}.arc").write_bytes(A.gzip_member(data[:100]) + A.gzip_member(data[100:]) if packed else data)
    rows = A.read_legacy(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and {r.warc_type for r in rows} == {"response"}
    want = {A.record_bytes(A.convert(r)) for v in (1, 2) for r in A.parse_legacy(A.legacy_file(legacy(5, v), v))}
    assert {bytes(r.record) for r in rows} == want


def test_references_are_resolved_by_id(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "same" if k % 2 else f"own {k}") for k in range(60)], "page_id long, url string, html string")
    A.write_archives(A.archive_files(pages), str(tmp_path / "w"))
    rows = A.read_records(spark, str(tmp_path / "w")).collect()
    ids = {r.record_id: r.page_id for r in rows}
    assert {ids[r.refers_to_id] for r in rows if r.record_type == "revisit"} == {59}
    for most, common in ((0, 5), (0, 100)):
        monkeypatch.setattr(A, "BROADCAST_GROUPS", most if common == 100 else 1)
        monkeypatch.setattr(A, "COMMON", common)
        got = A.archive_round_trip(pages).collect()
        assert sorted((r.page_id, r.refers_to) for r in got) == [(k, 59 if k % 2 and k < 59 else None) for k in range(60)]
    A.write_archives(A.archive_files(pages).limit(0).union(spark.createDataFrame([(A.gzip_member(A.record_bytes(A.as_revisit(A.convert(legacy(1)[0]), {"WARC-Refers-To": "<urn:uuid:0>"})) + b"\r\n\r\n"),)], "file binary")), str(tmp_path / "lost"))
    with pytest.raises(ValueError):
        A.read_archives(spark, str(tmp_path / "lost"))


def test_round_trip_of_pages(spark):
    rnd = random.Random(9)
    html = [prose(rnd, 50) for _ in range(6)] + ["", None, "a\r\n\r\nb\r\n"]
    rows = [(k, f"http://h/{k}", html[k % len(html)], 1) for k in range(40)] + [(None, None, html[0], 1), (None, "u", None, 1), (39, "again", html[39 % len(html)], 1), (None, "alone", "only here", 1), (None, "alone", "only here", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    for least in (0, 10):
        want = []
        for i, _, h, _ in rows:
            data = (h or "").encode()
            ids = [j for j, _, g, _ in rows if (g or "") == (h or "") and j is not None]
            best = max(ids) if ids and len(data) >= least else None
            revisit = best is not None and i != best
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
        got = A.archive_round_trip(pages, least).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert A.archive_round_trip(pages.limit(0)).count() == 0
    ids = {r.page_id: r.record_id for r in got if r.record_type == "response"}
    assert len(set(ids.values())) == len(ids)
