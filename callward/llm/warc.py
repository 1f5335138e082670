"""WARC archives with a two-level capture index.

`write_archives` writes one gzip member per record.  `build_index` sorts captures by reversed-host
URL key (`com,example,blog)/path?query`) and packs them into compressed blocks, with one
directory row per block.  `lookup` finds a URL by binary search in the directory, then in the
block, then reads the record's own byte range.  `read_back` walks the whole index and reads every
record, neighbouring ranges of an archive in one read.

Equal payloads: the largest page_id holds the response, the others are revisit records that refer
to it; payloads below `min_revisit_bytes` are always responses.

Nulls: a null html is an empty payload; a null page_id is written as an empty id, is never referred
to when its payload has another holder, and comes back null; a null or unparsable url has the key
")" with its own text.  Repeated rows each get a record; rows that repeat the holder's page_id are
responses as well.  An empty table gives an empty index.

Files are written and read through pyarrow's file systems, by the URI of the folder.  Each task
attempt writes files of its own name and only files of committed attempts are ever referred to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callward.operators.cut import materialize, scratch

BLOCK_ENTRIES = 2000
READ_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
CAPTURES = "page_id long, key string, file string, offset long, length long"
RECORDS = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
           "refers_to long, payload binary")


def surt(url: str | None) -> str:
    """Key that sorts the captures of a host, and of its domain, next to each other."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").split(".")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return f"){url}"
    return f"{','.join(reversed(host))}{port}){parts.path}{'?' + parts.query if parts.query else ''}"


def store(where: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    return pafs.FileSystem.from_uri(where if ":" in where else f"file://{where}")


# --- records ---------------------------------------------------------------------------


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: WARC head, HTTP head, and the payload of a response."""
    name = "" if page is None else str(page)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url}')}>", f"X-Page-ID: {name}",
            "WARC-Date: " + DATE, f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        plain = quote(url, safe="%:/?#[]@!$&'()*+,;=~")
        head += [f"WARC-Target-URI: {plain}"] + [f"X-Page-URL: {base64.b64encode(url.encode()).decode()}"] * (plain != url)
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> dict:
    """The record in one gzip member; the digest of a response is computed from its payload."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    size = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and size != len(payload):
        raise ValueError(f"record of page {fields['X-Page-ID']}: {len(payload)} bytes of {size}")
    digest = sha1(payload) if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if digest != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"record of page {fields['X-Page-ID']}: digest differs")
    to = fields.get("X-Refers-To-Page")
    return {"page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None,
            "url": base64.b64decode(fields["X-Page-URL"]).decode() if "X-Page-URL" in fields else fields.get("WARC-Target-URI"),
            "record_type": kind, "payload_digest": digest, "payload_bytes": size,
            "refers_to": int(to) if to else None, "payload": payload if kind == "response" else None}


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ---------------------------------------------------------------------------


def holders(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, sha, holder of the pages whose payload another page holds."""
    keyed = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("p")).select(
        "page_id", F.sha2("p", 256).alias("sha"), F.length("p").alias("size")).where(F.col("size") >= min_revisit_bytes)
    shared = keyed.groupBy("sha").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 and holder is not null")
    return keyed.join(shared, "sha").where(~F.col("page_id").eqNullSafe(F.col("holder"))) \
        .select("page_id", "sha", "holder").distinct()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the records of (page_id, url, html) and return the captures' places, materialized."""
    revisits = holders(pages, min_revisit_bytes).select(
        F.col("page_id").alias("r_page"), F.col("sha").alias("r_sha"), "holder")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("p")) \
        .withColumn("sha", F.sha2("p", 256))
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["r_page"]) & (rows["sha"] == revisits["r_sha"]), "left") \
        .select("page_id", "url", "p", "holder", F.col("r_sha").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = system = None
        try:
            for batch in batches:
                if out is None:
                    system, root = store(folder)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(path, compression=None)
                found: tuple[list, ...] = ([], [], [], [], [])
                for page, url, payload, holder, revisit in zip(*(c for c in batch.columns), strict=True):
                    page, url, payload = page.as_py(), url.as_py(), payload.as_py()
                    raw = record(page, url, payload, sha1(payload), holder.as_py(), revisit.as_py())
                    for to, v in zip(found, (page, surt(url), path, out.tell(), len(raw)), strict=True):
                        to.append(v)
                    out.write(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                    names=["page_id", "key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, CAPTURES), "captures")


# --- the index -------------------------------------------------------------------------


def _pack(rows: list[tuple]) -> bytes:
    return zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode(), 6)


def _unpack(raw: bytes) -> list[tuple[str, int | None, str, int, int]]:
    lines = (x.rsplit("\t", 4) for x in zlib.decompress(raw).decode().split("\n"))
    return [(k, None if p == "None" else int(p), f, int(o), int(n)) for k, p, f, o, n in lines]


def build_index(captures: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Write the blocks; the directory has (part, block, first_key, last_key, index_file, at, size, entries).

    Captures are dealt to ranges of (key, page, place), so that a key with many captures is
    spread over as many blocks and parts as it needs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out = path = None
        rows: list[tuple] = []
        n = 0

        def block() -> dict:
            nonlocal n
            raw, at = _pack(rows), out.tell()
            out.write(raw)
            n += 1
            return {"part": part, "block": n - 1, "first_key": rows[0][0], "last_key": rows[-1][0],
                    "index_file": path, "at": at, "size": len(raw), "entries": len(rows)}

        def batch_of(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=_DIRECTORY_SCHEMA)

        try:
            for batch in batches:
                if out is None:
                    system, root = store(folder)
                    path = f"{root}/{uuid.uuid4().hex}.cdx"
                    out = system.open_output_stream(path, compression=None)
                done = []
                columns = [batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")]
                for row in zip(*columns, strict=True):
                    rows.append(row)
                    if len(rows) == block_entries:
                        done.append(block())
                        rows = []
                if done:
                    yield batch_of(done)
            if rows:
                yield batch_of([block()])
        finally:
            if out is not None:
                out.close()

    order = ["key", "page_id", "file", "offset"]
    # line breaks and tabs would end an entry
    clean = captures.withColumn("key", F.translate("key", "\t\n\r", "   "))
    sorted_ = clean.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(sorted_.mapInArrow(run, DIRECTORY), "directory")


DIRECTORY = ("part int, block int, first_key string, last_key string, index_file string, at long, size long, entries int")
_DIRECTORY_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()),
                               ("last_key", pa.string()), ("index_file", pa.string()), ("at", pa.int64()),
                               ("size", pa.int64()), ("entries", pa.int32())])


def _read(system: pafs.FileSystem, path: str, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """Byte ranges of one file in order of place; neighbours come in one read."""
    with system.open_input_file(path) as file:
        k = 0
        while k < len(spans):
            begin, end, last = spans[k][0], sum(spans[k]), k
            while last + 1 < len(spans) and spans[last + 1][0] <= end + 4096 and sum(spans[last + 1]) - begin <= READ_BYTES:
                last += 1
                end = max(end, sum(spans[last]))
            raw = file.read_at(end - begin, begin)
            for at, size in spans[k:last + 1]:
                yield raw[at - begin:at - begin + size]
            k = last + 1


def entries(directory: DataFrame, folder: str) -> DataFrame:
    """Every capture of the index, from its blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = store(folder)
        for batch in batches:
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("index_file", "at", "size")), strict=True):
                found = _unpack(next(_read(system, path, [(at, size)])))
                key, page, file, offset, length = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(key), pa.array(file), pa.array(offset), pa.array(length)],
                    names=["page_id", "key", "file", "offset", "length"])

    # a few blocks a task: the directory is small, what it points to isn't
    return directory.repartition("index_file", "block").mapInArrow(run, CAPTURES)


def read_back(directory: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record that the index knows, read from the archives by byte ranges."""
    fields = RECORDS if payloads else RECORDS.removesuffix(", payload binary")
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = store(folder)
        for batch in batches:
            for path, own in batch.groupby("file", sort=False):
                spans = list(zip(own["offset"].tolist(), own["length"].tolist(), strict=True))
                found: list[dict] = []
                size = 0
                for raw in _read(system, path, spans):
                    found.append({k: v for k, v in parse(raw).items() if k in names})
                    size += found[-1]["payload_bytes"] if payloads else 1
                    if size > READ_BYTES:
                        yield _frame(found, names)
                        found, size = [], 0
                yield _frame(found, names)

    spread = entries(directory, folder).withColumn("__run", F.floor(F.col("offset") / (4 * READ_BYTES)))
    return spread.repartition("file", "__run").sortWithinPartitions("file", "offset").drop("__run") \
        .mapInPandas(run, fields)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array(out[c], dtype="Int64")
    return out


def lookup(urls: DataFrame, directory: DataFrame, folder: str, max_parts: int = 100_000) -> DataFrame:
    """Records of the URLs in column `url`: (asked, record...).

    The driver holds one line per index part, which are bounded by `max_parts`.  A task
    binary-searches these, then the directory of the parts it needs, then the block, and reads the
    records' ranges.
    """
    parts = directory.groupBy("part").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).orderBy("part").limit(max_parts + 1).collect()
    if len(parts) > max_parts:
        raise ValueError(f"the index has over {max_parts} parts: build it with fewer")
    firsts, lasts, numbers = [r["a"] for r in parts], [r["b"] for r in parts], [r["part"] for r in parts]

    def near(keys: pd.Series) -> pd.Series:
        return pd.Series([numbers[bisect.bisect_left(lasts, k):bisect.bisect_right(firsts, k)] for k in keys])

    key_of = F.pandas_udf(lambda s: s.map(surt), "string")
    part_of = F.pandas_udf(near, "array<int>")
    asked = urls.select(F.col("url").alias("asked")).distinct().withColumn("__key", F.translate(key_of("asked"), "\t\n\r", "   "))
    asked = asked.withColumn("part", F.explode(part_of("__key")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        system, _ = store(folder)
        right = right.sort_values("block")
        low, high = right["first_key"].tolist(), right["last_key"].tolist()
        spans = list(zip(right["index_file"], right["at"], right["size"], strict=True))
        found: list[dict] = []
        for url, key in zip(left["asked"], left["__key"], strict=True):
            for k in range(bisect.bisect_left(high, key), bisect.bisect_right(low, key)):
                block = _unpack(next(_read(system, spans[k][0], [(spans[k][1], spans[k][2])])))
                keys = [x[0] for x in block]
                for _, _, file, offset, length in block[bisect.bisect_left(keys, key):bisect.bisect_right(keys, key)]:
                    got = parse(next(_read(system, file, [(offset, length)])))
                    if got["url"] == url:
                        found.append({"asked": url, **got})
        return _frame(found, ["asked", *[x.split()[0] for x in RECORDS.split(", ")]])

    return asked.groupBy("part").cogroup(directory.groupBy("part")).applyInPandas(run, "asked string, " + RECORDS)


def archive(pages: DataFrame, min_revisit_bytes: int = 0) -> tuple[DataFrame, str]:
    """Archives and index in a scratch folder of the session: (directory, folder)."""
    folder = scratch(pages.sparkSession, "warc")
    return build_index(write_archives(pages, folder, min_revisit_bytes), folder), folder
