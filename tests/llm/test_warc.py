import gzip
import hashlib
import random

import pytest

from inlay.llm import op9_warc as op

SCHEMA = "page_id bigint, url string, html string, payload_bytes int, digest string"


def expected(rows):
    big, out = {}, []
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            latest = big.setdefault(raw, page)
            if latest is None or page is not None and page > latest:
                big[raw] = page
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        latest = big.get(raw)
        later = latest is not None and page != latest
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if later else "response", latest if later else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [2503, 1 << 20])
def test_round_trip(spark, tmp_path, split):
    rng = random.Random(split)
    copies = ["<p>" + "ab" * 600 + "</p>", "é" * 499 + "x", "é" * 500]
    rows = [(i, f"http://h/{i} x\n%", rng.choice(copies), 1, "d") for i in range(40)]
    rows += [(100 + i, None, "".join(chr(rng.randrange(32, 5000)) for _ in range(rng.randrange(4000))), 1, None) for i in range(40)]
    rows += [(200, "u", None, None, None), (201, "u", "", 1, "d"), (None, "u", copies[0], 1, "d"), (39, "u", copies[0], 1, "d")]
    rows += [(300, "u", "long " * 50_000, 1, "d"), (301, "u", "\x1f\u008b\x08" * 900, 1, "d")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    files = op.write_archives(df, str(tmp_path / "w"))
    back = op.read_archives(files, split_bytes=split, payloads=True)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()]
    assert sorted(got, key=repr) == expected(rows)
    held = {r.page_id: r for r in back.collect() if r.record_type == "response"}
    assert held[300].payload == rows[-2][2].encode() and held[300].url == "u"
    assert {r.page_id: r.url for r in back.collect() if r.page_id == 7} == {7: rows[7][1]}
    for f in files.collect():  # any gzip reader can read the archives
        assert gzip.open(f.path).read().count(b"WARC/1.1\r\n") >= f.records


def test_nested_archive_is_no_record(tmp_path):
    inner = b"".join(op.member(op.record(i, None, b"x" * 50, "00" * 20, 50, None), b"other") for i in range(5))
    body = inner + random.Random(1).randbytes(4000)
    outer = op.member(op.record(1, "u", body, hashlib.sha1(body).hexdigest(), len(body), None), b"mine", level=0)
    tail = op.member(op.record(2, "u", b"", hashlib.sha1(b"").hexdigest(), 0, None), b"mine")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(outer + b"\0garbage" + tail)
    size = path.stat().st_size
    for split in (50, 333, size):
        with path.open("rb") as file:
            rows = [
                op.row_of(raw)
                for start in range(0, size, split)
                for raw in op.records_in(op.Window(file, size), start, min(size, start + split))
            ]
        assert [(r[0], r[4]) for r in rows] == [(1, len(body)), (2, 0)]


def test_empty_table(spark, tmp_path):
    files = op.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert op.read_archives(files).count() == 0


def test_damaged_record_is_an_error(tmp_path):
    """One flipped byte behind the header of the third of five members."""
    rng = random.Random(8)
    bodies = [rng.randbytes(6000) for _ in range(5)]
    members = [op.member(op.record(i, "u", b, hashlib.sha1(b).hexdigest(), len(b), None), b"mine") for i, b in enumerate(bodies)]
    hurt = bytearray(members[2])
    hurt[4000] ^= 64
    path = tmp_path / "a.warc.gz"
    for third, fails in ((members[2], False), (bytes(hurt), True), (members[2][:-4] + b"\0\0\0\0", True)):
        path.write_bytes(b"".join([*members[:2], third, *members[3:]]))
        size = path.stat().st_size
        with path.open("rb") as file:
            read = lambda: list(op.records_in(op.Window(file, size), 0, size))  # noqa: B023, E731
            if fails:
                with pytest.raises(op.DamagedRecord, match=f"byte {sum(map(len, members[:2]))} "):
                    read()
            else:
                assert len(read()) == 5
