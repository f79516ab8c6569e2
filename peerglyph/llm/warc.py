"""WARC: an archive writer with revisit records, and a reader that salvages damaged archives.

The writer builds records with SQL functions and Spark's text sink, whose line separator is the record
separator, so archives land in any store that Spark can write. The reader walks from record to record, plain
or in gzip members. Where one fails its checks, it searches for the next member or version line that passes
them, goes on there, and reports the bytes between as a quarantined gap.

Files are read in units of ``UNIT_BYTES``. Where a file has several, each finds in a first pass the first
record that begins in it, and where a walk from there leaves it; these places are then strung together from
the file's beginning, so that a unit starts where the walk of the unit before really ends. That differs only
where a payload holds records itself, or damage ends there; such units are walked once more.

Defined results: a null payload counts as empty; equal payloads (of at least ``min_payload`` bytes) share
one response, the record with the smallest page_id, and repeated rows of that page_id are responses each;
among rows that all lack a page_id each is a response; a null URL leaves out the target header; an empty
table gives an empty archive; other columns are ignored. Headers may be folded; a SHA-1 may be in base32 or
hex, in either case; other digests aren't checked. A header block over ``MOST_HEADERS`` bytes, or a record
over ``MOST_RECORD`` (a row holds no more), is quarantined. A member of a gzip file isn't unpacked twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import View, deal, files, map_files, map_units, readable, units
from .storage import drop, materialise, new_path

CRLF = "\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
SIGN_BYTES = 10  # of the longest thing that VERSION or NEXT find
UNIT_BYTES, MOST_HEADERS, MOST_RECORD = 64 << 20, 1 << 20, 1 << 30
GZIP_STEP, GZIP_OUT = 1 << 16, 1 << 20  # bytes unpacked at once, and got out of it


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each ten hex digits are eight base32 digits."""
    digest = F.sha1(payload)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31))), HEX32, BASE32)


def records(pages: DataFrame, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and the record (value), without the separator after it, of each row of ``pages`` (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n"), sha1_base32(payload).alias("digest"))
    # of payloads that occur twice or more, the first page; small, and written so that a hot payload's join can be split
    shared = rows.where(F.col("n") >= min_payload).groupBy(F.col("digest").alias("s_digest")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("times")).where("times > 1 and first_page is not null").drop("times")
    firsts, _ = materialise(shared, "warc-firsts")
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    uri = F.translate("url", CRLF, "")
    name = lambda page: F.regexp_replace(F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("none")))), "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit(CRLF)), F.lit(""))  # noqa: E731  a null value leaves the header out
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Target-URI", uri), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("WARC-Refers-To", F.when(revisit, name(F.col("first_page")))), line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-Id", F.when(revisit, F.col("first_page").cast("string"))), line("X-Payload-Length", F.col("n").cast("string")),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF),
    )
    marked = rows.join(firsts, (rows.digest == firsts.s_digest) & (rows.n >= min_payload), "left")
    return marked.select("page_id", F.concat(head, block).alias("value"))


def write_records(rows: DataFrame, path: str, records_per_file: int = 1000) -> None:
    """Records (value) as uncompressed WARC files under ``path``."""
    rows.select("value").write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def write_archive(pages: DataFrame, path: str, min_payload: int = 0, records_per_file: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) as uncompressed WARC files under ``path``."""
    write_records(records(pages, min_payload, date), path, records_per_file)


@dataclass
class Piece:
    """A record (reason is None) or a quarantined gap; offsets are those of the archive's bytes."""

    offset: int
    length: int
    reason: str | None = None
    headers: dict[str, str] | None = None
    block: bytes = b""

    def payload(self) -> bytes:
        """The block without its HTTP headers."""
        if self.block.startswith(b"HTTP/"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


class Member:
    """What a gzip member holds, by place like a ``View``; unpacked as far as it is asked for.

    Where the member is damaged its content ends, with the last byte that could be read.
    """

    def __init__(self, view: View, at: int):
        self.view, self.at = view, at
        self.base, self.held = 0, bytearray()
        self.unzip, self.step = zlib.decompressobj(31), GZIP_STEP
        self.ended = self.whole = False

    def _fill(self, upto: int) -> None:
        while not self.ended and self.base + len(self.held) < upto:
            part = self.view.get(self.at, self.step)
            if not part:
                self.ended = True
                break
            before = self.unzip.copy()
            try:
                out = self.unzip.decompress(part, GZIP_OUT)
            except zlib.error:  # a call that raises gives nothing: the bytes before the damage, in smaller steps
                self.unzip, self.ended, self.step = before, self.step == 1, max(1, self.step // 2)
                continue
            self.held += out
            self.ended = self.whole = self.unzip.eof
            self.at += len(part) - len(self.unzip.unused_data if self.whole else self.unzip.unconsumed_tail)

    def get(self, at: int, n: int) -> bytes:
        self._fill(at + n)
        return bytes(self.held[at - self.base : at - self.base + n])

    def find(self, sign: re.Pattern[bytes], at: int, stop: int | None, longest: int) -> int | None:
        while True:
            self.release(at)
            part = self.get(at, GZIP_OUT)
            if m := sign.search(part):
                return at + m.start()
            if len(part) < GZIP_OUT:
                return None
            at += len(part) - longest + 1

    def release(self, at: int) -> None:
        """Nothing before ``at`` is asked for again."""
        if at - self.base >= GZIP_OUT // 2:
            del self.held[: at - self.base]
            self.base = at


def _headers(view: View | Member, at: int) -> tuple[dict[str, str] | None, int, str]:
    """The headers of the record at ``at`` and where its block begins; else None and why."""
    asked = 4096
    text = view.get(at, asked)
    version = VERSION.match(text)
    if not version:
        return None, at, "no version line"
    found: dict[str, str] = {}
    last, pos = "", version.end()
    while True:
        while (stop := text.find(b"\r\n", pos)) < 0:
            if len(text) < asked:
                return None, at, "headers don't end"
            if asked >= MOST_HEADERS:
                return None, at, "headers too long"
            asked *= 4
            text = view.get(at, asked)
        line, pos = text[pos:stop], stop + 2
        if not line:
            return found, at + pos, ""
        if line[:1] in b" \t" and last:  # a folded line
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad header line"
        last = key.strip().decode("utf-8", "replace").lower()
        found[last] = value.strip().decode("utf-8", "replace")


def _differs(stated: str, payload: bytes) -> bool:
    """Whether a stated SHA-1, in base32 or hex, isn't the payload's."""
    kind, _, digest = stated.partition(":")
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return False
    real, digest = hashlib.sha1(payload).digest(), digest.strip()
    return digest.lower() != real.hex() if len(digest) == 40 else digest.upper() != base64.b32encode(real).decode()


def _record(view: View | Member, at: int) -> tuple[Piece | None, int, str]:
    """The record that starts at ``at`` and where it ends; else None and why."""
    headers, body, reason = _headers(view, at)
    if headers is None:
        return None, at, reason
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None, at, "bad content length"
    if int(size) > MOST_RECORD:
        return None, at, "record too large"
    end = body + int(size)
    if view.get(end, 4) != CRLF.encode() * 2:
        return None, at, "block isn't followed by the record separator"
    piece = Piece(at, end + 4 - at, None, headers, view.get(body, int(size)))
    if headers.get("warc-type") == "response" and "warc-payload-digest" in headers and _differs(headers["warc-payload-digest"], piece.payload()):
        return None, at, "payload digest differs"
    return piece, end + 4, ""


def _member(view: View, at: int) -> Generator[Piece, None, tuple[int, bool]]:
    """The pieces that the gzip member at ``at`` holds; returns where it ends and whether it is whole.

    A damaged member's gaps aren't given: the member itself is one.
    """
    inner = Member(view, at)
    found, gaps = 0, []
    while inner.get(found, 1):
        piece, end, reason = _record(inner, found)
        if piece:
            yield Piece(at, 0, None, piece.headers, piece.block)
        else:
            go = found + 1
            while (sign := inner.find(VERSION, go, None, SIGN_BYTES)) is not None and not _record(inner, sign)[0]:
                go = sign + 1
            end = sign if sign is not None else max(inner.base + len(inner.held), go)
            gaps.append(Piece(at, 0, reason))
        inner.release(end)
        found = end
    if inner.whole:
        yield from gaps
    return inner.at, inner.whole


def _next(view: View, at: int, stop: int) -> int | None:
    """Where the next valid record, or member that begins with a version line, starts in [at, stop)."""
    while (sign := view.find(NEXT, at, stop, SIGN_BYTES)) is not None:
        if view.get(sign, 1) == b"\x1f":
            if VERSION.match(Member(view, sign).get(0, SIGN_BYTES)):
                return sign
        elif _record(view, sign)[0]:
            return sign
        at = sign + 1
    return None


def walk(view: View, at: int, stop: int) -> Generator[Piece, None, int | None]:
    """All pieces that start in [at, stop), in order; returns where the last one ends.

    If that is a gap for which no end was found before ``stop``, it is given with a length of -1, and the
    walk returns None.
    """
    while at < min(stop, view.size):
        if view.get(at, 3) == b"\x1f\x8b\x08":
            end, whole = yield from _sized(view, at)
            if whole:
                at = end
                continue
            reason = "damaged gzip member"
        else:
            piece, end, reason = _record(view, at)
            if piece:
                yield piece
                at = end
                continue
        go = _next(view, at + 1, stop)
        yield Piece(at, -1 if go is None else go - at, reason)
        if go is None:
            return None
        at = go
    return at


def _sized(view: View, at: int) -> Generator[Piece, None, tuple[int, bool]]:
    """``_member``; the first piece of a whole member has the member's length, so that lengths add up."""
    pieces, held = _member(view, at), None
    try:
        while True:
            piece = next(pieces)
            if held is not None:
                yield held
            held = piece
    except StopIteration as stop:
        end, whole = stop.value
    if held is not None:
        held.length = end - at if whole else 0
        yield held
    elif whole:
        yield Piece(at, end - at, "nothing in a gzip member")
    return end, whole


def salvage(data: bytes) -> Iterator[Piece]:
    """All records of an archive, plain or in gzip members, and the gaps between them, in order."""
    for piece in walk(View(pa.BufferReader(data), len(data)), 0, len(data)):
        if piece.length < 0:
            piece.length = len(data) - piece.offset
        yield piece


def _leaves(view: View, at: int | None, stop: int) -> int | None:
    """Where a walk from ``at`` leaves [at, stop): the next place, or -1 - the place of a gap that is open."""
    if at is None:
        return None
    pieces = walk(view, at, stop)
    last = at
    while True:
        try:
            piece = next(pieces)
            last = piece.offset
        except StopIteration as end:
            return -1 - last if end.value is None else end.value


def _string(rows: list[dict]) -> list[dict]:
    """A file's units in order: where each begins (``entry``) and where a gap open at its end ends (``until``).

    ``walks`` has the known walks of a unit, from place to where they leave it. The first unit whose walk
    isn't known gets a ``want``, and those after it nothing.
    """
    place, opened = 0, None  # the next piece's place, or else the unit with a gap that is open
    for k, row in enumerate(rows):
        row |= {"entry": None, "until": None, "want": None}
        if opened is None and place >= row["high"]:
            continue
        entry = place if opened is None else row["sync"]
        if entry is None:
            continue
        if opened is not None:
            opened["until"], opened = entry, None
        if entry not in row["walks"]:
            row["want"] = entry
            for later in rows[k + 1 :]:
                later |= {"entry": None, "until": None, "want": None}
            return rows
        row["entry"], left = entry, row["walks"][entry]
        if left < 0:
            opened = row
        else:
            place = left
    if opened is not None:
        opened["until"] = rows[-1]["size"]
    return rows


PLAN = "path string, size long, low long, high long, sync long, walks map<long,long>, entry long, until long, want long"
_PLAN_TYPES = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("size", "low", "high", "sync")), ("walks", pa.map_(pa.int64(), pa.int64())), *((n, pa.int64()) for n in ("entry", "until", "want"))])


def _entries(spark: SparkSession, cut: DataFrame) -> DataFrame:
    """Units of files that have several, each with its ``entry`` and ``until``."""

    def first(view: View, unit: dict) -> Iterator[pa.RecordBatch]:
        sync = 0 if unit["low"] == 0 else _next(view, unit["low"], unit["high"])
        yield rows_of([unit | {"sync": sync, "walks": [] if sync is None else [(sync, _leaves(view, sync, unit["high"]))]}])

    def again(view: View, unit: dict) -> Iterator[pa.RecordBatch]:
        yield rows_of([unit | {"walks": [*unit["walks"], (unit["want"], _leaves(view, unit["want"], unit["high"]))]}])

    def rows_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in _PLAN_TYPES.names} for r in rows], _PLAN_TYPES)

    def string(table: pa.Table) -> pa.Table:  # a file's units: a few numbers for each 64 MB of it
        rows = sorted(table.to_pylist(), key=lambda r: r["low"])
        for row in rows:
            row["walks"] = dict(row["walks"])
        found = _string(rows)
        return pa.Table.from_pylist([r | {"walks": list(r["walks"].items())} for r in found], _PLAN_TYPES)

    n = cut.count()
    now, path = materialise(map_units(spark, deal(cut, n), first, PLAN), "warc-units")
    while True:
        strung, new = materialise(now.groupBy("path").applyInArrow(string, PLAN), "warc-units")
        drop(spark, path)
        want = strung.where("want is not null")
        if want.isEmpty():
            return strung.where("entry is not null").select("path", "size", "low", "high", "entry", "until")
        walked = map_units(spark, deal(want, want.count()), again, PLAN)
        now, path = materialise(strung.where("want is null").unionByName(walked), "warc-units")
        drop(spark, new)


RECORD_SCHEMA = "path string, offset long, length long, reason string, type string, uri string, record_id string, refers_to string, page_id long, refers_to_page long, stated_length long, stated_digest string, payload binary"


def read_archive(spark: SparkSession, path: str, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Every record and gap of the archives under ``path``. A gap has a reason and nothing but its place.

    ``unit_bytes`` of a file are the unit of work; a task holds one record at a time and a few more to be
    sent on. Lengths of a gzip member's pieces stand with the last of them.
    """

    def number(x: str | None) -> int | None:
        found = int(x) if x and re.fullmatch(r"-?[0-9]{1,19}", x) else None
        return found if found is not None and -(2**63) <= found < 2**63 else None

    def work(view: View, unit: dict) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for p in walk(view, unit.get("entry") or 0, unit["high"]):
            h, payload = p.headers or {}, p.payload() if p.reason is None else None
            length = p.length if p.length >= 0 else (unit["size"] if unit.get("until") is None else unit["until"]) - p.offset
            rows.append((unit["path"], p.offset, length, p.reason, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-record-id"), h.get("warc-refers-to"), number(h.get("x-page-id")), number(h.get("x-refers-to-page-id")), number(h.get("x-payload-length")), h.get("warc-payload-digest"), payload))
            held += len(payload or b"")
            if held > 4 << 20 or len(rows) >= 10_000:
                yield table(rows)
                rows, held = [], 0
        yield table(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, *[pa.int64()] * 3, pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    listed = files(spark, path)
    if not readable(listed):
        return map_files(spark, path, work, RECORD_SCHEMA)
    whole = units(listed.where(F.col("size") <= unit_bytes), unit_bytes)
    found = map_units(spark, deal(whole, whole.count()), work, RECORD_SCHEMA)
    parts = units(listed.where(F.col("size") > unit_bytes), unit_bytes)
    if parts.isEmpty():
        return found
    entries = _entries(spark, parts)
    return found.unionByName(map_units(spark, deal(entries, entries.count()), work, RECORD_SCHEMA))


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes: path, offset, length and reason of each gap in what ``read_archive`` found."""
    return found.where("reason is not null").select("path", "offset", "length", "reason")


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back: a digest row for each record.

    A gap in these archives would be a page that is lost; it stops the query.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, min_payload)
    found = read_archive(spark, path)
    whole = F.col("type") == "response"
    said = F.concat(F.lit("a gap in an archive just written: "), F.concat_ws(" ", "reason", "path", F.col("offset").cast("string")))
    page = F.when(F.col("reason").isNotNull(), F.raise_error(said).cast("long")).otherwise(F.col("page_id"))
    return found.select(page.alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("stated_length")).alias("payload_bytes"), F.when(whole, sha1_base32(F.col("payload"))).otherwise(F.substring("stated_digest", 6, 32)).alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
