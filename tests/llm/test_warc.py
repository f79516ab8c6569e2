import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from peerglyph.llm import warc as w

PAGE = "page_id long, url string, html string"


def record(payload, digest=None, kind="response", version=b"WARC/1.1"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = digest or base64.b32encode(hashlib.sha1(payload).digest())
    return version + b"\r\nWARC-Type: " + kind.encode() + b"\r\nWARC-Payload-Digest: sha1:" + digest + b"\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def good(data):
    return [p.payload() for p in w.salvage(data) if p.reason is None]


def gaps(data):
    return [(p.offset, p.length) for p in w.salvage(data) if p.reason]


A, B, C = record(b"first"), record(b"second WARC/1.1\r\n not a record"), record(b"third")


def test_whole_archives():
    assert good(A + B + C) == [b"first", b"second WARC/1.1\r\n not a record", b"third"] and gaps(A + B + C) == []
    assert good(b"") == [] and gaps(b"") == []
    zipped = b"".join(map(gzip.compress, (A, B, C)))
    assert good(zipped) == good(A + B + C) and gaps(zipped) == []
    assert good(gzip.compress(A + B + C)) == good(A + B + C)


def test_damage_is_a_gap_and_later_records_are_recovered():
    noise = b"\x00garbage\r\n" * 5
    assert good(A + noise + C) == [b"first", b"third"] and gaps(A + noise + C) == [(len(A), len(noise))]
    cut = B[:-30]
    assert good(A + cut + C) == [b"first", b"third"] and gaps(A + cut + C) == [(len(A), len(cut))]
    wrong = record(b"second", digest=b"A" * 32)
    assert good(A + wrong + C) == [b"first", b"third"] and gaps(A + wrong + C) == [(len(A), len(wrong))]
    for bad in (b"Content-Length: x", b"Content-Length: 999999", b"no colon here"):
        broken = B.replace(b"Content-Length: " + str(len(b"HTTP/1.1 200 OK\r\n\r\nsecond WARC/1.1\r\n not a record")).encode(), bad)
        assert good(A + broken + C) == [b"first", b"third"]
    assert good(A + B[:40]) == [b"first"] and gaps(A + B[:40]) == [(len(A), 40)]


def test_damaged_gzip_members():
    a, b, c = map(gzip.compress, (A, B * 50, C))
    hurt = bytearray(b)
    hurt[len(b) // 2] ^= 0xFF
    assert good(a + bytes(hurt) + c)[0] == b"first" and good(a + bytes(hurt) + c)[-1] == b"third"
    assert gaps(a + bytes(hurt) + c)[-1] == (len(a), len(b))
    assert good(a + b[:-20] + c)[-1] == b"third"
    assert good(b"\x1f\x8b\x08" + c) == [b"third"]


def test_records_before_the_damage_of_a_member_come_back():
    import random

    rng = random.Random(5)
    records = [record(rng.randbytes(20).hex().encode()) for _ in range(400)]
    whole = good(b"".join(records))
    member = gzip.compress(b"".join(records))
    assert len(whole) == 400 and len(member) < 65536
    wrong = bytearray(member)
    wrong[-8] ^= 0xFF  # the CRC
    assert good(bytes(wrong)) == whole
    hurt = bytearray(member)
    hurt[len(member) // 2 : len(member) // 2 + 40] = bytes(40)
    found = good(bytes(hurt) + gzip.compress(C))
    assert len(found) > 100 and found[-1] == b"third" and found[:100] == whole[:100]


def test_lengths_cover_the_file():
    data = A + b"junk" + B + C[:-3]
    assert sum(p.length for p in w.salvage(data)) == len(data)


ROWS = [(1, "http://a", "<p>é</p>"), (2, None, None), (3, "http://c\r\nInjected: x", ""), (4, "http://d", "<p>é</p>"), (5, "e", "WARC/1.1\r\nx\r\n\r\n"), (6, "f", "y" * 100_000), (None, "g", "<p>é</p>"), (7, "h", "once"), (7, "h", "once")]


def expect(rows, least=0):
    def digest(h):
        return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()

    low = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            low[h or ""] = min(low.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        first = low.get(h or "") if len((h or "").encode()) >= least else None
        again = first is not None and i != first
        out.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip_of_awkward_pages(spark):
    pages = spark.createDataFrame(ROWS, PAGE).withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1))
    assert sorted((tuple(r) for r in w.round_trip(pages).collect()), key=str) == expect(ROWS)
    assert sorted((tuple(r) for r in w.round_trip(pages, 5).collect()), key=str) == expect(ROWS, 5)
    assert w.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_archives_hold_the_pages_and_damage_is_logged(spark, tmp_path):
    w.write_archive(spark.createDataFrame(ROWS, PAGE).coalesce(1), f"file://{tmp_path}/w", records_per_file=4)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) == 3
    found = w.read_archive(spark, f"file://{tmp_path}/w")
    assert found.where("reason is not null").count() == 0
    assert {r.page_id: bytes(r.payload) for r in found.where("type = 'response'").collect()}[5] == b"WARC/1.1\r\nx\r\n\r\n"
    data = bytearray(files[0].read_bytes())
    at = data.index(b"Content-Length")
    data[at : at + 7] = b"xxxxxxx"
    (tmp_path / "hurt.warc").write_bytes(bytes(data))
    hurt = w.read_archive(spark, f"file://{tmp_path}/hurt.warc")
    assert hurt.where("reason is null").count() == 3
    gap = hurt.where("reason is not null").first()
    assert gap.offset == 0 and gap.length > 0 and gap.payload is None


def test_page_ids_of_the_whole_range_come_back(spark):
    rows = [(2**63 - 1, "a", "same"), (-(2**63), "b", "same"), (10**18, "c", "other")]
    assert sorted((tuple(r) for r in w.round_trip(spark.createDataFrame(rows, PAGE)).collect()), key=str) == expect(rows)


def test_valid_records_with_other_digests_and_folded_headers():
    import time

    sha = hashlib.sha1(b"payload").digest()
    for digest in (base64.b32encode(sha).lower(), sha.hex().encode(), sha.hex().upper().encode()):
        assert good(record(b"payload", digest=digest)) == [b"payload"]
    assert good(record(b"payload", digest=b"0" * 40)) == []
    assert good(record(b"payload").replace(b"sha1:", b"sha512:")) == [b"payload"]
    folded = record(b"payload").replace(b"WARC-Type: response", b"WARC-Type: response\r\nX-Note: one\r\n\ttwo\r\n  three")
    assert next(w.salvage(folded)).headers["x-note"] == "one two three"
    start = time.time()
    assert good(A + b"WARC/1.1\r\n" * 100_000 + C) == [b"first", b"third"]
    assert good(A + b"WARC/1.1\r\nx: y\r\n" * 60_000 + C) == [b"first", b"third"]
    assert good(A + b"WARC/1.1\r\nContent-Length: 9\r\n\r\n" * 30_000 + C) == [b"first", b"third"]
    assert time.time() - start < 10


def test_members_in_members_and_members_that_unpack_to_much():
    import time
    import tracemalloc

    data = A
    for _ in range(1500):
        data = gzip.compress(data)
    assert good(data + C) == [b"third"] and [r for _, r in gaps(data + C)] == [len(data)]
    start = time.time()
    bomb = gzip.compress(bytes(300 << 20), 9)
    tracemalloc.start()
    assert good(A + bomb + C) == [b"first", b"third"] and gaps(A + bomb + C) == [(len(A), len(bomb))]
    assert tracemalloc.get_traced_memory()[1] < 64 << 20 and time.time() - start < 10
    tracemalloc.stop()


def hurt_archive(rng, zipped):
    """Records, some of which hold records, with noise, cuts and changed bytes between and in them."""
    parts = []
    for k in range(60):
        body = b"page %d " % k + rng.randbytes(rng.randrange(0, 400)).hex().encode()
        if k % 5 == 0:
            body += record(b"inside %d" % k) + record(b"and %d" % k) + b"WARC/1.1\r\n"
        one = record(body)
        one = gzip.compress(one) if zipped else one
        fate = rng.random()
        if fate < 0.1:
            one = one[: rng.randrange(len(one))]
        elif fate < 0.2:
            at = rng.randrange(len(one))
            one = one[:at] + bytes([one[at] ^ 0x15]) + one[at + 1 :]
        elif fate < 0.3:
            one += rng.randbytes(rng.randrange(1, 300))
        parts.append(one)
    return b"".join(parts)


def test_units_of_a_file_give_what_one_walk_gives(spark, tmp_path):
    import random

    rng = random.Random(11)
    want = {}
    (tmp_path / "w").mkdir()
    for k in range(8):
        data = hurt_archive(rng, k % 2)
        (tmp_path / "w" / f"{k}.warc").write_bytes(data)
        want[str(k)] = sorted((p.offset, p.length, p.reason or "", p.payload() if p.reason is None else b"") for p in w.salvage(data))
        assert sum(p[1] for p in want[str(k)]) == len(data)
    for unit in (900, 6000):
        found = w.read_archive(spark, f"file://{tmp_path}/w", unit)
        got = {}
        for r in found.collect():
            got.setdefault(r.path.rsplit("/", 1)[1][:-5], []).append((r.offset, r.length, r.reason or "", bytes(r.payload or b"")))
        assert {k: sorted(v) for k, v in got.items()} == want
    logged = w.gaps(w.read_archive(spark, f"file://{tmp_path}/w", 5000))
    assert logged.count() == sum(1 for v in want.values() for p in v if p[2])


def test_a_large_archive_is_read_by_several_tasks(spark, tmp_path):
    pages = spark.range(3000).selectExpr("id as page_id", "'http://a' as url", "repeat(concat('text ', id, ' '), 40) as html").coalesce(1)
    w.write_archive(pages, f"file://{tmp_path}/w", records_per_file=100_000)
    found = w.read_archive(spark, f"file://{tmp_path}/w", 64 << 10)
    assert found.selectExpr("spark_partition_id() as p").distinct().count() > 4
    assert found.where("reason is not null").count() == 0 and found.select("page_id").distinct().count() == found.count() == 3000


def test_a_gap_stops_a_round_trip(spark, monkeypatch):
    import pytest

    real = w.write_archive

    def hurt(pages, path, *rest):
        real(pages.withColumn("url", F.lit("a")), path, *rest)
        for file in __import__("pathlib").Path(path[len("file://") :]).glob("part-*"):
            file.write_bytes(file.read_bytes().replace(b"Content-Length", b"Content-Lengt\xff", 1))

    monkeypatch.setattr(w, "write_archive", hurt)
    with pytest.raises(Exception, match="a gap in an archive just written"):
        w.round_trip(spark.createDataFrame(ROWS, PAGE)).collect()


def test_archives_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    w.write_archive(spark.createDataFrame(ROWS, PAGE), f"file://{tmp_path}/w")
    monkeypatch.setattr(w, "readable", lambda listed: False)
    assert w.read_archive(spark, f"file://{tmp_path}/w").where("reason is null").count() == len(ROWS)
