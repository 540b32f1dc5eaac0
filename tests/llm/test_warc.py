import base64
import gzip
import hashlib
import io

import pytest

from wordloom.llm import warc
from wordloom.plans.storage import written


def pages(spark, data):
    return spark.createDataFrame(data, "page_id bigint, url string, html string").selectExpr("*", "'x' AS payload", "1 AS part", "2 AS _digest")


def test_round_trip(spark, tmp_path):
    big, other = "é" * 600, "y" * 1000
    data = [(1, "http://a", big), (5, "http://a%\r\nX: y", big), (3, None, big), (2, "b", "x" * 999), (4, "b", "x" * 999), (6, "", None),
            (7, "u", ""), (8, "u", other), (-9, "u", "\r\n\r\n<p>"), (9, "u", big[:-1]), (10, "v", "z" * 3_000_000), (11, "v", "z" * 3_000_000)]
    parts, _ = written(warc.archive(pages(spark, data).repartition(3), part=2000), "warc")
    got = {r.page_id: r for r in warc.read_archive(parts).collect()}
    assert len(got) == len(data)
    for page, url, html in data:
        body = (html or "").encode()
        r = got[page]
        same = [p for p, _, h in data if (h or "").encode() == body]
        target = max(same) if len(body) >= 1000 else page
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if page == target else ("revisit", target))
        assert r.payload == (bytearray(body) if page == target else None)


def test_nulls_repeats_and_empty(spark):
    big = "q" * 1500
    data = [(None, None, big), (1, "a", big), (1, "a", big), (None, "n", None)]
    rows = warc.read_archive(warc.archive(pages(spark, data))).collect()
    assert sorted((r.page_id is None, r.record_type, r.refers_to or 0) for r in rows) == [
        (False, "response", 0), (False, "response", 0), (True, "response", 0), (True, "revisit", 1)]
    assert warc.read_archive(warc.archive(pages(spark, []))).count() == 0


def record(**more):
    return warc.make_record(1, "http://a", b"payload " * 50, None, "2026-01-01T00:00:00Z")


def test_members_are_standard_gzip():
    data = record() + record()
    whole = gzip.decompress(data)
    assert whole.count(b"WARC/1.1\r\n") == 2
    headers, block = next(warc.read_records(io.BytesIO(data)))
    assert headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"payload " * 50).digest()).decode()
    assert len(block) == int(headers["content-length"])


@pytest.mark.parametrize("number", [0, 1, -1, -(1 << 63), (1 << 63) - 1, None])
def test_record_ids_hold_numbers(number):
    assert warc.page_number(warc.record_id(number)) == number


def test_damage_is_an_error():
    data = record()
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data[:-20])))
    plain = gzip.decompress(data)
    for bad in (plain.replace(b"payload payload", b"payload pay1oad", 1), plain.replace(b"WARC/1.1", b"WARC/9.9"),
                plain.replace(b"Content-Length: 4", b"Content-Length: 3"), plain.replace(b"Content-Length: 4", b"Content-Length: 9"),
                plain + b"more"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))


def test_reads_by_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "_READ", 7)
    assert len(list(warc.read_records(io.BytesIO(record() * 5)))) == 5


def foreign(kind, block, version="WARC/1.0", **headers):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:6c2c7a1e-58a4-4a3e-9d6b-2f1f2f9a7b10>", "Content-Length": len(block)}
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {**head, **headers}.items())
    return gzip.compress(f"{version}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark):
    http, body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n", b"hello"
    kind = {"Content_Type": "application/http; msgtype=response", "WARC_Target_URI": "http://a"}
    sha = hashlib.sha1(body).hexdigest()
    parts = [foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
             foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
             foreign("response", http + body, WARC_Payload_Digest=f"sha1:{sha}", **kind),
             foreign("response", http + body, WARC_Payload_Digest=f"sha256:{hashlib.sha256(body).hexdigest()}", **kind),
             foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n", "WARC/1.1",
                     WARC_Payload_Digest=f"sha1:{sha}", **kind),
             foreign("response", b"10.0.0.1", Content_Type="text/dns"),
             foreign("revisit", http, "WARC/1.1", WARC_Payload_Digest=f"sha1:{sha}", WARC_Refers_To="<urn:uuid:other>", **kind),
             foreign("revisit", b"", WARC_Record_ID="<http://x/1>")]
    table = spark.createDataFrame([(b"".join(parts),), (None,), (b"",)], "content binary")
    got = warc.read_archive(table, "content").collect()
    assert [r.record_type for r in got] == ["response"] * 4 + ["revisit"] * 2
    assert [bytes(r.payload) if r.payload is not None else None for r in got] == [
        body, body, b"5\r\nhello\r\n0\r\n\r\n", b"10.0.0.1", None, None]
    assert [r.payload_bytes for r in got][-2:] == [5, None] and [r.payload_digest for r in got][-2:] == [sha, None]
    assert got[0].payload_digest == sha and {r.page_id for r in got} == {None} == {r.refers_to for r in got}
    assert got[4].refers_to_id == "<urn:uuid:other>" and got[5].record_id == "<http://x/1>"
    bad = foreign("response", http + b"hullo", WARC_Payload_Digest=f"sha1:{sha}", **kind)
    with pytest.raises(warc.WarcError):
        warc._page(*next(warc.read_records(io.BytesIO(bad))))
