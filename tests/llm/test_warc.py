import gzip
import base64
import hashlib
import io
import zipfile
from collections import Counter

import pytest

from symtrace.llm import warc
from symtrace.llm.common import Scratch

PAGES = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/%0A\r\n", "é" * 5000), (4, "u", None), (5, "u", ""), (6, "u", "x\r\n\r\ny"), (None, "n", "same"), (6, "u", "x\r\n\r\ny"), (7, "big", "<p>" * 300_000)]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages, least, payloads=True).collect()
    groups: dict = {}
    for i, _, h in PAGES:
        groups.setdefault(h or "", []).append((i is None, i or 0))
    want = Counter()
    for h, ids in groups.items():
        raw = h.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for n, (null, i) in enumerate(sorted(ids)):
            again = n > 0 and len(raw) >= least
            want[(None if null else i, len(raw), digest, "revisit" if again else "response", sorted(ids)[0][1] if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload).decode() in groups for r in got if r.record_type == "response")
    assert Counter(r.url for r in got) == Counter(u for _, u, _ in PAGES)


def test_archives_are_zip_files_of_stored_members(spark):
    work = Scratch(spark, "t")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for r in warc.write_archives(work, pages).collect():
        z = zipfile.ZipFile(r.path.removeprefix("file://"))
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_directories():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a", b"12345")
        z.writestr("b", b"")
        z.comment = b"a comment"
    assert directory_data(plain) == {"a": b"12345", "b": b""}
    wide = io.BytesIO()
    w = warc.ZipWriter(wide)
    w.member("a", [b"12", b"345"])
    w.member("b", [])
    w.close()
    assert directory_data(wide) == {"a": b"12345", "b": b""}
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.directory(io.BytesIO(b"x" * 100), 100)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"1" * 1000)
    with pytest.raises(ValueError, match="not stored"):
        directory_data(packed)


def directory_data(f):
    raw = f.getvalue()
    return {k: raw[a : a + n] for k, (a, n) in warc.directory(f, len(raw)).items()}


def test_broken_payload_is_noticed():
    raw = warc.record(1, 0, "u", b"payload", None, None, False, "2024-01-01T00:00:00Z").replace(b"payload\r\n\r\n", b"paylOad\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_records_have_what_the_format_asks_for(spark):
    p = spark.createDataFrame([(1, "http://a/", "x"), (2, None, "x"), (None, "u", "y"), (None, "u", None)], "page_id long, url string, html string").coalesce(1)
    written = warc.write_archives(warc.Scratch(spark, "warc-test"), p)
    path = written.first().path
    with warc._opened(path) as f:
        members = warc.directory(f, f.size())
        raw = warc._at(f, *members[warc.DATA])
    records = [r for r in gzip.decompress(raw).split(b"WARC/1.1\r\n") if r]
    kinds = [r.split(b"\r\n")[0] for r in records]
    assert kinds[0] == b"WARC-Type: warcinfo" and len(records) == 5
    ids = [line for r in records for line in r.split(b"\r\n") if line.startswith(b"WARC-Record-ID: ")]
    assert len(set(ids)) == 5 and all(b"\r\nWARC-Date: 2" in r for r in records)
