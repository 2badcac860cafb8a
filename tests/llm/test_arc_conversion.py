"""Foreign ARC archives, built by hand, become WARC records byte for byte."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from topograin.llm import warc

OK = b"HTTP/1.1 200 OK\r\nServer: nginx\r\nSet-Cookie: a=b\r\nSet-Cookie: c=d\r\nContent-Type: application/json\r\n\r\n" + b'{"a": "\xc3\xa9"}\n\r\n'
GONE = b"HTTP/1.0 404 Not Found\nServer: old\n\n<h1>Gone</h1>"
DNS = b"20010203040506\nwww.example.org.\t3600\tIN\tA\t192.0.2.7\n"
BARE = b"HTTP/1.1 204 No Content\r\nServer: x"


def archive(version):
    block = f"{version} 0 Somebody\n{' '.join(warc.ARC_FIELDS[version])}\n".encode()
    more = lambda code, n: "" if version == "1" else f" {code} - - {n} old.arc"
    out = [f"filedesc://old.arc 0.0.0.0 20010203040500 text/plain{more(200, 0)} {len(block)}\n".encode() + block + b"\n"]
    for url, ip, mime, code, body in (("http://example.org/a b", "192.0.2.1", "application/json", 200, OK), ("http://example.org/gone", "192.0.2.2", "text/html", 404, GONE), ("dns:www.example.org", "192.0.2.3", "text/dns", 0, DNS), ("http://example.org/copy", "192.0.2.4", "application/json", 200, OK), ("http://example.org/none", "192.0.2.5", "no-type", 204, BARE)):
        out.append(f"{url} {ip} 20010203040506 {mime}{more(code, 9)} {len(body)}\n".encode() + body + b"\n")
    return out


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("version", ["1", "2"])
@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(spark, tmp_path, version, packed):
    records = archive(version)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.arc").write_bytes(b"".join(map(gzip.compress, records)) if packed else b"".join(records))
    out = warc.convert(str(tmp_path / "in"), spark.range(1))
    (content,) = [bytes(r.content) for r in warc._files(spark.range(1), out).collect()]
    _, *found = warc.parse_warc(warc._gunzip(content))
    assert [(h["warc-type"], h["warc-target-uri"], h["warc-ip-address"], h["warc-date"]) for h, _ in found] == [
        (kind, url, f"192.0.2.{i}", "2001-02-03T04:05:06Z")
        for i, (kind, url) in enumerate([(found[0][0]["warc-type"], "http://example.org/a b"), ("response", "http://example.org/gone"), ("resource", "dns:www.example.org"), (found[3][0]["warc-type"], "http://example.org/copy"), ("response", "http://example.org/none")], 1)
    ]
    assert sorted(found[i][0]["warc-type"] for i in (0, 3)) == ["response", "revisit"]
    for (h, block), body in zip(found, (OK, GONE, DNS, OK, BARE)):
        head = body[: body.index(b"\r\n\r\n") + 4] if body is OK else body
        assert block == (head if h["warc-type"] == "revisit" else body) and h["warc-block-digest"] == "sha1:" + sha(block)
    assert found[2][0]["content-type"] == "text/dns" and found[1][0]["content-type"].startswith("application/http")
    payloads = [OK.partition(b"\r\n\r\n")[2], b"<h1>Gone</h1>", DNS, OK.partition(b"\r\n\r\n")[2], b""]
    rows = {r.url: r for r in warc.read_warc(warc._files(spark.range(1), out)).collect()}
    assert len(rows) == 5
    for (h, _), payload in zip(found, payloads):
        r = rows[h["warc-target-uri"]]
        assert (r.payload_digest, r.payload_bytes, r.page_id) == (sha(payload), len(payload), None)
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    status = {r.url: r.status for r in warc.read_arc(warc._files(spark.range(1), str(tmp_path / "in"))).collect()}
    assert (status["http://example.org/gone"], status["http://example.org/none"]) == (404, 204)


def test_damage_is_loud(spark, tmp_path):
    data = b"".join(archive("1"))
    for bad in (data.replace(b" 192.0.2.2 20010203040506 text/html ", b" text/html "), data.replace(b"text/dns %d" % len(DNS), b"text/dns x")):
        with pytest.raises(ValueError, match="malformed"):
            list(warc.parse_arc(bad))
    for cut in (len(data) - 9, data.rindex(b"http://") + 12):
        assert len(list(warc.parse_arc(data[:cut]))) == 4
        with pytest.raises(ValueError, match="cut off"):
            list(warc.parse_arc(data[:cut], "raise"))
    (tmp_path / "cut.arc").write_bytes(data[:-9])
    files = warc._files(spark.range(1), str(tmp_path))
    assert warc.read_arc(files, damaged="stop").count() == 4
    with pytest.raises(Exception, match="cut off"):
        warc.read_arc(files).collect()
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


@pytest.mark.parametrize("zone", ["America/New_York", "UTC"])
def test_dates_are_utc_in_every_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        pages = spark.range(1).select(F.lit(1).alias("page_id"), F.lit("u").alias("url"), F.lit("x").alias("html"), F.timestamp_seconds(F.lit(1_704_067_200)).alias("at"))
        assert [r.warc_date for r in warc.round_trip(pages, date=F.col("at")).collect()] == ["2024-01-01T00:00:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
