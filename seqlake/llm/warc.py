"""WARC archives with revisit records, and the merge of their indexes.

Writing is a DataFrame plan: a record is one string, and Spark's text writer lays the records
down byte for byte, so archives go wherever Spark writes. Of equal payloads one record holds
the bytes and the others are revisits of it. Reading parses whole archives (bounded by their
number of records) in Python. Each archive gives a run of captures sorted by URL key and time;
runs are cut at common splitters into blocks, only blocks are shuffled, and each range of the
key space is merged from its runs by a loser tree, so that ranges one after another are the
capture histories of all archives in order.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

#: Bytes from which equal payloads are stored once; records of an archive.
LEAST_REVISIT, ARCHIVE_RECORDS = 1000, 1000
#: Captures of a merged range on average, and ranges at most (beyond, ranges grow).
RANGE_CAPTURES, MAX_RANGES = 5000, 50_000
#: Keys that splitters are chosen from, about, for each range.
KEYS_PER_RANGE = 16

_CAPTURE = "url_key string, captured string, id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
_FIELDS = [f.split()[0] for f in _CAPTURE.split(", ")]


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the right, then path and query; no scheme or fragment."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:] or "/")


def _revisits(pages: DataFrame, least: int) -> DataFrame:
    """``id, digest, refers_to`` of the rows whose payload another row holds."""
    keys = materialize(pages.select("id", F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("check"), F.octet_length("payload").alias("size")).where(F.col("size") >= least), "warc-keys")
    same = ["digest", "check", "size"]
    holders = keys.groupBy(*same).agg(F.max("id").alias("holder"), F.count("*").alias("n")).where("n > 1 and holder is not null").drop("n")
    rows = keys.join(materialize(holders, "warc-holders"), same).where(~F.col("id").eqNullSafe(F.col("holder")))
    return materialize(rows.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("holder").alias("refers_to")).distinct(), "warc-revisits")


def _record(captured: Column) -> Column:
    """The record of a row ``id, url, payload, digest, refers_to``, less its last line feed."""
    end = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(end + end))
    block = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.octet_length("payload"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.0{end}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{end}WARC-Record-ID: "), name("id"),
        F.lit(f"{end}WARC-Target-URI: "), uri,
        F.lit(f"{end}WARC-Date: "), captured,
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{end}WARC-Refers-To: "), name("refers_to"))).otherwise(""),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "), block.cast("string"),
        F.lit(end + end), http, F.when(revisit, "").otherwise(F.col("payload")), F.lit(end + "\r"),
    )


def default_time(id_: Column) -> Column:
    """Capture times for rows that have none: a second per id from 2024 on."""
    return F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.pmod(id_, F.lit(10**9)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured: Column | None = None, least_revisit: int = LEAST_REVISIT, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write a record per row as archives (``part-*`` files of WARC 1.0) in folder ``path``.

    The payload is the text in UTF-8; null is empty. Of rows with equal payloads of at least
    ``least_revisit`` bytes, that with the largest id is the response and the others are its
    revisits; rows that repeat its id as well are responses too. Null ids sort below all. A
    line break in a URL is percent-encoded. No rows give archives without records.
    """
    given = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), (default_time(F.col(id_col)) if captured is None else captured).alias("captured"))
    known = _revisits(given, least_revisit)
    rows = given.withColumn("digest", F.sha1("payload"))
    joined = rows.join(known, rows["id"].eqNullSafe(known["_id"]) & (rows["digest"] == known["_digest"]) & (F.octet_length("payload") >= least_revisit), "left")
    joined.select(_record(F.coalesce("captured", F.lit("1970-01-01T00:00:00Z"))).alias("value")).write.option("maxRecordsPerFile", archive_records).option("lineSep", "\n").text(path)


def parse_archive(data: bytes, archive: str = "") -> Iterator[tuple]:
    """Captures of one archive in the order of the file, as tuples of ``_FIELDS``."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at} of {archive}")
        fields = dict(line.split(b": ", 1) for line in lines[1:])
        start, size = head + 4, int(fields[b"Content-Length"])
        stop = start + size
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} of {archive} doesn't end where it should")
        body = data.index(b"\r\n\r\n", start, stop) + 4
        digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        kind = fields[b"WARC-Type"].decode()
        if kind == "response":
            length = stop - body
            if hashlib.sha1(memoryview(data)[body:stop]).hexdigest() != digest:
                raise ValueError(f"payload at byte {body} of {archive} is damaged")
        else:
            length = int(dict(line.split(b": ", 1) for line in data[start : body - 4].split(b"\r\n")[1:])[b"Content-Length"])
        url = fields[b"WARC-Target-URI"].decode("utf-8", "replace")
        yield url_key(url), fields[b"WARC-Date"].decode(), _page(fields[b"WARC-Record-ID"]), url, kind, _page(fields.get(b"WARC-Refers-To", b"")), length, digest, archive, at, stop + 4 - at
        at = stop + 4


def _page(urn: bytes) -> int | None:
    number = urn.removeprefix(b"<urn:x-page:").removesuffix(b">")
    return int(number) if number else None


def _order(capture: tuple) -> tuple:
    """URL key, time, then id (null first) and place, so that no two captures are equal."""
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[8], capture[9]


class LoserTree:
    """Merge of sorted runs: each step replays one path of matches, log2(runs) comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = max(1, len(runs))
        self.keys = [_order(r[0]) if r else None for r in runs] or [None]
        self.losers = [-1] * self.leaves
        for run in range(self.leaves):
            self._play(run, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and x <= y)

    def _play(self, run: int, building: bool = False) -> None:
        winner, node = run, (run + self.leaves) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.keys[run := self.losers[0]] is not None:
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            own = self.runs[run]
            self.keys[run] = _order(own[self.at[run]]) if self.at[run] < len(own) else None
            self._play(run)


def _runs(splitters: list[tuple]):
    """Archives -> blocks (range, archive, captures): each archive's sorted run, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                captures = sorted(parse_archive(content.as_py(), path), key=_order)
                cuts = [0, *(bisect.bisect_left(captures, s, key=lambda c: _order(c)[:4]) for s in splitters), len(captures)]
                rows = [(i, captures[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                if rows:
                    blobs = [_to_blob(part) for _, part in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([path] * len(rows)), pa.array(blobs, pa.binary())], ["range", "archive", "captures"])

    return run


_TYPES = {"string": pa.string(), "long": pa.int64()}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _CAPTURE.split(", ")])


def _to_blob(captures: list[tuple]) -> bytes:
    columns = [pa.array(c, t) for c, t in zip(zip(*captures, strict=True), _SCHEMA.types, strict=True)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=_SCHEMA))
    return sink.getvalue().to_pybytes()


def _from_blob(blob: bytes) -> list[tuple]:
    found = pa.ipc.open_stream(blob).read_all()
    return list(zip(*(found[n].to_pylist() for n in _FIELDS), strict=True))


def _merge(blocks: pd.DataFrame) -> pd.DataFrame:
    order = blocks.sort_values("archive")
    merged = list(LoserTree([_from_blob(b) for b in order["captures"]]))
    columns = {n: pd.array([c[i] for c in merged], dtype="Int64" if _SCHEMA.field(n).type == pa.int64() else object) for i, n in enumerate(_FIELDS)}
    return pd.DataFrame({"range": int(blocks["range"].iloc[0]), "position": range(len(merged)), **columns})


def capture_index(archives: DataFrame, keys: DataFrame, captures: int) -> DataFrame:
    """The captures of all archives in order of URL key and time, by ``range, position``.

    ``archives`` has ``path, content``; ``keys`` (``url, captured, id``) is a sample that the
    splitters of the ranges come from, and ``captures`` their number, about. Splitters have
    the id as well, so that captures of one URL, or of one URL and time, can be cut too. They
    decide how even the ranges are, not what they hold.
    """
    ranges = min(MAX_RANGES, -(-captures // RANGE_CAPTURES))
    chosen = sorted((url_key(u or ""), t or "", i is not None, i or 0) for u, t, i in keys.select("url", "captured", "id").collect()) if ranges > 1 else []
    splitters = sorted({chosen[len(chosen) * k // ranges] for k in range(1, ranges)}) if chosen else []
    blocks = archives.select("path", "content").mapInArrow(_runs(splitters), "range int, archive string, captures binary")
    return blocks.groupBy("range").applyInPandas(_merge, f"range int, position long, {_CAPTURE}")


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives, read them back, and return the merged capture index.

    One row per row of ``pages`` with the columns of a capture (``id``, ``record_type``, ...).
    Without ``path`` the archives go to the shared folder.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    archives = spark.read.format("binaryFile").load(path)
    total = pages.count()
    share = min(1.0, KEYS_PER_RANGE * min(MAX_RANGES, -(-total // RANGE_CAPTURES)) / max(1, total))
    keys = pages.select(F.col(url_col).alias("url"), default_time(F.col(id_col)).alias("captured"), F.col(id_col).cast("long").alias("id"))
    sampled = keys.where(F.pmod(F.xxhash64("url", "id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return capture_index(archives, sampled, total)
