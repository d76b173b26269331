"""WARC archives: written from pages, read back, and assembled into captures through concurrent-to identifiers."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, Scratch, arrow_map, arrow_map_all

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20
_SPACE = uuid.UUID("b1e4c3a2-5f0d-4c58-9a77-2d6f1e8c9b30")
FIELDS = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string, metadata map<string,string>, payload binary, file string, offset long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {page} {digest}')}>"


def record(kind: str, ident: str, uri: str, content_type: str, block: bytes, **more: str) -> bytes:
    """One record, as a gzip member of its own."""
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Target-URI": uri, "WARC-Date": DATE, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Type": content_type, "Content-Length": str(len(block))}
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(pages: DataFrame, folder: str, at_least: int = 0) -> DataFrame:
    """Writes three records per page (page_id, url, html) to files in the folder: request, response or revisit, metadata. Returns
    the files' names, a table of one row per file that counts: a task that runs again writes a new file, and only the file of
    the attempt that succeeded is in the table.

    Of pages with equal payloads of at least `at_least` bytes, that with the smallest page_id is the response."""
    p = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(LAST)).alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = p.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.first(F.length("payload")).alias("size"))
    firsts = firsts.filter((F.col("first") < F.col("last")) & (F.col("size") >= at_least)).select("sha", "first")
    scratch = Scratch(pages.sparkSession, "warc")
    # Only digests that occur twice; as a table, its size decides whether it goes to every task or both sides are shuffled.
    p = p.join(scratch.save(firsts, "firsts"), "sha", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        n = 0
        with where.open_output_stream(name, compression=None) as out:
            out.write(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", "", "application/warc-fields", b"format: WARC File Format 1.1\r\n"))
            for batch in batches:
                for page, url, payload, first in zip(*(batch[k].to_pylist() for k in ("page_id", "url", "payload", "first"))):
                    digest = digest32(payload)
                    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page}"
                    ident, again = record_id("response", page, digest), first is not None and first < page
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    more = {"WARC_Payload_Digest": f"sha1:{digest}"}
                    if again:
                        more |= {"WARC_Profile": PROFILE, "WARC_Refers_To": record_id("response", first, digest)}
                    asked = f"GET {uri} HTTP/1.1\r\n\r\n".encode()
                    fields = (f"page_id: {page}\r\n" if page != LAST else "").encode() + b"charset: utf-8\r\n"
                    request = record_id("request", page, digest)
                    out.write(record("request", request, uri, "application/http; msgtype=request", asked, WARC_Concurrent_To=ident))
                    out.write(record("revisit" if again else "response", ident, uri, "application/http; msgtype=response", http if again else http + payload, **more))
                    # Metadata names the request, as crawlers may do: assembly follows the chain.
                    out.write(record("metadata", record_id("metadata", page, digest), uri, "application/warc-fields", fields, WARC_Concurrent_To=request))
                    n += 1
        yield {"file": [name], "records": [3 * n]}

    return scratch.save(arrow_map_all(p, run, "file string, records long"), "files")


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member, or of a whole file that isn't compressed."""
    data, offset, z, parts_ = stream.read(READ), 0, None, []
    if data[:2] != b"\x1f\x8b":
        rest = [data]
        while data := stream.read(READ):
            rest.append(data)
        yield 0, b"".join(rest)
        return
    begin = 0
    while data:
        z = z or zlib.decompressobj(31)
        parts_.append(z.decompress(data))
        used = len(data) - len(z.unused_data)
        offset += used
        data = z.unused_data
        if z.eof:
            yield begin, b"".join(parts_)
            begin, z, parts_ = offset, None, []
        if not data:
            data = stream.read(READ)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record in the bytes. Values of a repeated
    WARC-Concurrent-To, the one field that may be, are joined by spaces."""
    while raw := raw.lstrip(b"\r\n"):
        head, _, rest = raw.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        last = ""
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and last:
                fields[last] += " " + line.strip()
            else:
                last, _, value = line.partition(":")
                last = last.strip().lower()
                fields[last] = f"{fields[last]} {value.strip()}" if last == "warc-concurrent-to" and last in fields else value.strip()
        n = int(fields.get("content-length", 0))
        if len(rest) < n:
            raise ValueError("a WARC record is cut short")
        yield fields, rest[:n]
        raw = rest[n:]


def _unchunked(body: bytes) -> bytes:
    out = []
    while body:
        size, _, body = body.partition(b"\r\n")
        n = int(size.split(b";")[0] or b"0", 16)
        if not n:
            break
        out.append(body[:n])
        body = body[n + 2 :]
    return b"".join(out)


def read(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records of archives (files: one column, file), gzip member by gzip member: see FIELDS. Payload bytes and digest are computed
    from the payload, but for revisits, which have none: their bytes are the HTTP header's, their digest the record's. A file is
    one task's work and is streamed; a record must fit in memory. A damaged record ends its file with an error."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        from pyarrow import fs

        names = [x.split(" ")[0] for x in FIELDS.split(", ")]
        for file in batch["file"].to_pylist():
            where, path = fs.FileSystem.from_uri(file) if ":" in file else (fs.LocalFileSystem(), file)
            out, size = {k: [] for k in names}, 0
            with where.open_input_stream(path, compression=None) as stream:
                for offset, raw in _members(stream):
                    for f, block in parse(raw):
                        body, n, digest, meta = block, len(block), None, None
                        kind = f.get("warc-type")
                        if f.get("content-type", "").startswith("application/http"):
                            head, _, body = block.partition(b"\r\n\r\n")
                            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
                            if http.get("transfer-encoding", "").lower() == "chunked":
                                body = _unchunked(body)
                            n = int(http.get("content-length", 0)) if kind == "revisit" else len(body)
                        elif kind == "metadata":
                            meta = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
                        if kind in ("response", "resource"):
                            digest = digest32(body)
                        elif kind == "revisit":
                            digest = f.get("warc-payload-digest", "").rpartition(":")[2].upper() or None
                        row = (f.get("warc-record-id"), kind, re.findall(r"<[^>]*>|[^\s<]+", f.get("warc-concurrent-to", "")), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), n, digest, meta, body if payload and kind != "revisit" else None, file, offset)
                        for k, v in zip(names, row):
                            out[k].append(v)
                        size += len(body) if payload else 200
                        if size > 1 << 22:
                            yield out
                            out, size = {k: [] for k in names}, 0
            yield out

    return arrow_map(files.select("file").repartition(max(1, min(files.count(), 10_000)), "file"), run, FIELDS)


def captures_of(r: DataFrame) -> DataFrame:
    """record_id and capture_id of every request and metadata record; one that several captures share has a row for each.

    A link counts from both its ends. The nearest captures win: those that a record is linked with, then those of records it is
    linked with; captures that are there before those only named. Without any, metadata goes to its request."""
    one = r.groupBy("record_id").agg(F.min("type").alias("type"))
    side = F.col("type").isin("request", "metadata")
    named = r.select("record_id", F.explode("concurrent_to").alias("other"))
    links = named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).filter("record_id <> other").distinct()
    links = links.join(one.filter(side).select("record_id"), "record_id").join(one.select(F.col("record_id").alias("other"), F.col("type").alias("kind")), "other", "left")
    rank = lambda there, gone, request, metadata: F.when(F.col("kind").isNull(), gone).when(F.col("kind") == "request", request).when(F.col("kind") == "metadata", metadata).otherwise(there).alias("rank")
    near = links.select("record_id", F.col("other").alias("capture_id"), rank(1, 3, 6, 8))
    via = links.filter(F.col("kind").isin("request", "metadata")).select("record_id", F.col("other").alias("mid"))
    far = via.join(links.withColumnRenamed("record_id", "mid"), "mid").filter("record_id <> other").select("record_id", F.col("other").alias("capture_id"), rank(2, 4, 7, 9))
    own = one.filter(side).select("record_id", F.col("record_id").alias("capture_id"), F.when(F.col("type") == "request", 5).otherwise(8).alias("rank"))
    found = near.unionByName(far).unionByName(own).groupBy("record_id").agg(F.min("rank").alias("best"), F.collect_set(F.struct("rank", "capture_id")).alias("all"))
    of_best = F.transform(F.filter("all", lambda x: x["rank"] == F.col("best")), lambda x: x["capture_id"])
    return found.select("record_id", F.explode(F.when(F.col("best") < 5, of_best).otherwise(F.array(F.array_min(of_best)))).alias("capture_id"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit (also a resource), and all its request and metadata records.

    Concurrent-to identifiers are followed from either end for up to two steps: metadata may name the request that names the response,
    or that the response names. Records that occur twice (by identifier) count once. Request and metadata records whose capture
    isn't there make a row with a null response. Returns capture_id, response (a struct), request, metadata (arrays of structs by
    record_id, empty if there are none; the payload only in response). Records are scanned several times: save those of `read`."""
    r = records.filter(F.col("type").isin("request", "response", "revisit", "resource", "metadata") & F.col("record_id").isNotNull())
    side = r.filter(F.col("type").isin("request", "metadata")).drop("payload").dropDuplicates(["record_id"])
    main = r.filter(~F.col("type").isin("request", "metadata")).dropDuplicates(["record_id"])
    by_id = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    sides = side.select("record_id", "type", F.struct(*side.columns).alias("s")).join(captures_of(r.select("record_id", "type", "concurrent_to")), "record_id")
    sides = sides.groupBy("capture_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("type") == k, F.col("s"))), by_id).alias(k) for k in ("request", "metadata")))
    out = main.select(F.col("record_id").alias("capture_id"), F.struct(*main.columns).alias("response")).join(sides, "capture_id", "full")
    none = F.array().cast(sides.schema["request"].dataType)
    return out.select("capture_id", "response", *(F.coalesce(k, none).alias(k) for k in ("request", "metadata")))


def round_trip(pages: DataFrame, folder: str | None = None, at_least: int = 0) -> DataFrame:
    """Writes the pages as archives, reads them back and assembles captures; a row per page, from the archives alone.

    pages: page_id, url, html; other columns are ignored. Returns page_id, payload_bytes, payload_digest (bare base32 SHA-1),
    record_type, refers_to (page_id of the response). A null html is an empty payload; a null url gets a URN; a null page_id
    counts as the largest. Rows equal in page_id and html are one capture, whose records stand in the archives as often as there are
    such rows, and come back as many rows. An empty table gives no rows."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    files = write(pages, folder or f"{scratch.root}/warc", at_least)
    records = scratch.save(read(files, payload=False), "records")
    captures = assemble(records)
    # Of captures that several rows share; a table, as few or many as they are.
    times = records.filter(F.col("type").isin("response", "revisit")).groupBy(F.col("record_id").alias("capture_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    pages_ = F.transform("metadata", lambda m: F.try_element_at(m["metadata"], F.lit("page_id")))
    page = F.get(F.filter(pages_, lambda x: x.isNotNull()), F.lit(0)).cast("long")
    r = scratch.save(captures.filter("response is not null").select("capture_id", page.alias("page_id"), "response.*"), "captures")
    back = r.filter("type = 'revisit'").select("capture_id", "refers_to")
    back = back.join(r.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first")), "refers_to").select("capture_id", "first")
    out = r.join(scratch.save(back, "back"), "capture_id", "left").join(scratch.save(times, "times"), "capture_id", "left")
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1).cast("long")))))
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("first").alias("refers_to"))
