import base64
import gzip
import hashlib
import io
import random
import zlib

import pyarrow.fs as fs
import pytest

from tidemark.llm import warc
from tidemark.llm.queries import op10_warc


def sha(x):
    return hashlib.sha256(x).hexdigest()


def expected(rows):
    first = {}
    for p, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and p is not None:
            first[data] = min(first.get(data, p), p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and data in first and p != first[data]
        out.append((p, len(data), sha(data), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


def rows():
    r = random.Random(2)
    same = "<p>" + "copy é " * 40 + "</p>"
    out = [(i, f"http://x/{i} b\n?", same if i % 3 == 0 else "x" * (i % 130)) for i in range(60, 0, -1)]
    out += [(70, None, None), (71, "", ""), (72, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 9), (73, "u", "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(60_000))), (None, "n", same), (3, "u", same), (74, "u", "y" * 99), (75, "u", "y" * 99)]
    return out


def test_round_trip_in_small_splits(spark):
    data = rows()
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = [tuple(r)[:5] for r in warc.round_trip(pages, ).collect()]
    assert sorted(got, key=str) == expected(data)
    archives = warc.write(pages, warc.shared_dir(spark) + "/tidemark/own")
    got = [tuple(r)[:5] for r in warc.read(archives, split_bytes=37).collect()]
    assert sorted(got, key=str) == expected(data)


def test_archives_are_plain_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>hello</p>")], "page_id long, url string, html string")
    path = warc.write(pages, f"file://{tmp_path}/w").first().archive
    content = gzip.decompress(open(path.removeprefix("file://"), "rb").read())
    assert content.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and content.endswith(b"<p>hello</p>\r\n\r\n")


def test_false_magic_is_not_a_record(tmp_path):
    inner = warc._member(b"not a record")
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the inner member stands in the file as it is
    body = warc.record(5, "u", inner + b"z" * 200, sha(inner + b"z" * 200), None, False)
    data = packer.compress(body) + packer.flush()
    data += warc._member(warc.record(6, "u", b"two", sha(b"two"), None, False))
    (tmp_path / "a").write_bytes(data)
    stream = fs.LocalFileSystem().open_input_file(str(tmp_path / "a"))
    assert data.find(warc.MAGIC, 1) < len(data) - 100
    for step in (1, 7, 50, len(data)):
        found = [warc.parse(c)[0] for s in range(0, len(data), step) for _, c in warc.members(stream, len(data), s, min(s + step, len(data)))]
        assert found == [5, 6], step


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    data = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op10_warc(spark, d).collect()), key=str) == expected(data)


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_each_byte_of_a_long_record_is_read_once():
    body = random.Random(3).randbytes(6 << 20)  # incompressible
    small = warc._member(warc.record(8, "u", b"after", sha(b"after"), None, False))
    data = warc._member(warc.record(7, "u", body, sha(body), None, False)) + small * 300
    stream = Counted(data)
    found = list(warc.members(stream, len(data), 0, len(data)))
    assert len(found) == 301 and found[1][0] == len(data) - 300 * len(small)
    assert warc.parse(found[0][1])[:3] == (7, len(body), sha(body)) and stream.taken <= 1.05 * len(data)
    with pytest.raises(ValueError):
        list(warc.members(Counted(data[: 1 << 20]), 1 << 20, 0, 100))


def foreign():
    """An archive by another writer: other types, header orders, digests, long and folded headers."""
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    body = b"<p>foreign</p>"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    put = lambda head, block: ("\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"])).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return [
        put(["WARC-Filename: a.warc.gz", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x\r\n\r\nmore"),
        put(["WARC-Target-URI: http://a/" + "x" * 5000, "WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Type: response"], http + body),
        put(["warc-type: request", "WARC-Record-ID: <urn:uuid:3>", "Content-Type: application/http;msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        put(["WARC-Type: metadata", "WARC-Record-ID:", " <urn:uuid:4>", "WARC-Payload-Digest: blake3:zz"], b""),
        put(["WARC-Type: revisit", "WARC-Refers-To: <urn:uuid:2>", f"WARC-Payload-Digest: sha256:{sha(body)}"], b""),
    ]


def test_records_of_other_writers(tmp_path):
    records = foreign()
    data = b"".join(warc._member(r) for r in records)
    assert b"WARC-Type" not in records[1][:5000]
    want = [("warcinfo", 19, sha(b"software: x\r\n\r\nmore")), ("response", 14, sha(b"<p>foreign</p>")), ("request", 0, sha(b"")), ("metadata", 0, sha(b"")), ("revisit", None, sha(b"<p>foreign</p>"))]
    for step in (1, 33, 400, len(data)):
        found = [warc.parse(c) for s in range(0, len(data), step) for _, c in warc.members(io.BytesIO(data), len(data), s, min(s + step, len(data)))]
        assert [(r[3], r[1], r[2]) for r in found] == want and all(r[0] is None and r[4] is None for r in found), step
    assert found[1][5] == "http://a/" + "x" * 5000


def test_nothing_is_passed_over():
    a, b = (warc._member(warc.record(i, "u", b"x" * 50, sha(b"x" * 50), None, False)) for i in (1, 2))
    for data in (a + warc._member(b"no record") + b, a + b"junk" + b, b"junk" + a, a + b + b"\0\0"):
        for step in (len(data), len(a)):
            with pytest.raises(ValueError, match="no record at byte"):
                for s in range(0, len(data), step):
                    list(warc.members(io.BytesIO(data), len(data), s, min(s + step, len(data))))
    for wrong in (warc.record(1, "u", b"x", sha(b"y"), None, False), warc.record(1, "u", b"x", sha(b"x"), None, False).replace(b"WARC-Type: response", b"X: y"), warc.record(1, "u", b"xyz", sha(b"xyz"), None, False)[:-6]):
        with pytest.raises(ValueError, match="record <urn:page:1>"):
            warc.parse(wrong)
