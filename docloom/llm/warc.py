r"""WARC archives of pages: written with one gzip member per record, read back sequentially.

Writing: of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id
is a response, the others are revisits that name it and carry no payload; smaller ones are all responses.  Each task writes archives of
about ARCHIVE_BYTES under a shared folder, under names no other attempt uses; the manifest, a table
written from what the tasks return, lists the archives that count, so a lost or repeated task leaves at
most files that nobody reads.

Reading: members are inflated piece by piece with zlib, records framed by content-length, block and
payload digests verified; a mismatch or a cut file raises an error.

Archives are dealt to tasks by their number and bytes, as the manifest has them.

A null html is an empty payload; an empty table gives no archive and no rows.  Repeated rows (one page_id, one payload) are records of one kind: both are
the response, or both revisit it, under one record id.  A null page_id comes after all others and is given back as null; if a payload has
no other, its records are responses.  Page ids of any type come back in that type.  Payloads of any length are written whole.
Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._scratch import Scratch

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 18
#: bytes of archives that a task reads, where there are more of them than tasks
TASK_BYTES = 128 << 20


def _uri(page_id: str | None, digest: str, kind: str) -> str:
    """The record's id: its page's, quoted, and what it holds."""
    return f"<urn:docloom:{'none' if page_id is None else 'page:' + quote(page_id, safe='')}:{kind}:{digest}>"


def _page_of(uri: str) -> str | None:
    parts = uri.strip("<>").split(":")
    return unquote(parts[3]) if parts[2] == "page" else None


def record(page_id: str | None, url, payload: bytes, kind: str, refers: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The bytes of one record, before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    digest = hashlib.sha256(payload).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page_id, digest, kind)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers, digest, 'response')}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class WarcError(ValueError):
    pass


def _inflated(stream):
    """The bytes of each gzip member, as a generator per member of pieces."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(READ_BYTES)
            if not rest:
                return
        inflate = zlib.decompressobj(31)

        def pieces(inflate=inflate):
            nonlocal rest
            while not inflate.eof:
                if not rest:
                    rest = stream.read(READ_BYTES)
                    if not rest:
                        raise WarcError("the archive ends within a member")
                out = inflate.decompress(rest, READ_BYTES)
                rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out

        yield pieces()


def read_records(stream):
    """(headers, block) of each record of an archive; digests are verified."""
    for pieces in _inflated(stream):
        try:
            held = b""
            while b"\r\n\r\n" not in held:
                held += next(pieces)
            head, _, held = held.partition(b"\r\n\r\n")
            first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
            if not first.startswith("WARC/1."):
                raise WarcError(f"not a record: {first[:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            want, got = int(headers["content-length"]) + 4, [held]
            have = len(held)
            for x in pieces:
                got.append(x)
                have += len(x)
            block = b"".join(got)
        except (StopIteration, zlib.error, KeyError) as e:
            raise WarcError(f"broken member: {e!r}") from e
        if have != want or not block.endswith(b"\r\n\r\n"):
            raise WarcError(f"content-length says {want - 4} bytes, the member has {have - 4}")
        block = block[:-4]
        algorithm, _, digest = headers["warc-block-digest"].partition(":")
        if algorithm != "sha256" or hashlib.sha256(block).hexdigest() != digest:
            raise WarcError("block digest differs")
        if headers["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if hashlib.sha256(payload).hexdigest() != headers["warc-payload-digest"].partition(":")[2]:
                raise WarcError("payload digest differs")
        yield headers, block


def _fs(root: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root)


def write_archives(spark: SparkSession, pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The manifest of the archives written under root: path, n_records, n_bytes.  It runs on action; cut it once."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.when(F.octet_length("html") >= MIN_REVISIT, F.sha2("html", 256)))
    groups = base.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    marked = base.join(groups, "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("first").cast("string").alias("refers"), revisit.alias("revisit"))

    def write(batches):
        fs, top = _fs(root)
        out, done, name, size, count = None, [], "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, count, size))
                out = None

        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page, url, html, refers, revisit = (c[i].as_py() for c in cols)
                data = member(record(page, url, html.encode(), "revisit" if revisit else "response", refers))
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(top, recursive=True)
                    out, size, count = fs.open_output_stream(f"{top}/{name}"), 0, 0
                out.write(data)
                size += len(data)
                count += 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "n_records", "n_bytes"])

    return marked.mapInArrow(write, "path string, n_records long, n_bytes long")


def read_archives(manifest: DataFrame, root: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the archives listed."""
    archives, size = manifest.agg(F.count("*"), F.sum("n_bytes")).first()
    parallel = manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(archives, max(4 * parallel, (size or 0) // TASK_BYTES)))

    def read(batches):
        fs, top = _fs(root)
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_stream(f"{top}/{path}") as stream:
                    for h, block in read_records(stream):
                        http = block.partition(b"\r\n\r\n")[0].decode("latin-1").lower()
                        size = int(http.rpartition("content-length:")[2].split("\r\n")[0])
                        refers = h.get("warc-refers-to")
                        rows.append((_page_of(h["warc-record-id"]), size, h["warc-payload-digest"].partition(":")[2], h["warc-type"], None if refers is None else _page_of(refers)))
                if len(rows) != n:
                    raise WarcError(f"{path} has {len(rows)} records; the manifest says {n}")
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = manifest.select("path", "n_records").repartition(tasks)  # a number that is given isn't merged into fewer
    got = dealt.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return got.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    scratch = Scratch(spark)
    root = f"{scratch.root}/archives"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    manifest = scratch.cut(write_archives(spark, pages, root), "manifest")
    return read_archives(manifest, root, pages.schema["page_id"].dataType.simpleString())
