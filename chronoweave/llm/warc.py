"""WARC archives with the index first: records are written with offset, length, URL and digest, and read back by
coalesced byte ranges in offset order.

A record is a gzip member of its own. Records with equal payloads of ``min_revisit`` bytes or more become revisits of
the one with the largest id; ids and digests are shuffled to find those, not payloads, unless more digests repeat than
may be broadcast: then rows are joined by id and digest, so that copies of one payload are dealt apart. Every task writes one
archive under a name of its own to the shared folder, and the index table, itself written there, names only archives of
tasks that ended well; an archive of a lost or repeated task is never read.

Defined results: a null payload is empty; a null URL is an empty field and read back as null, and line ends in a URL
are written percent-encoded; a null id is written but never the target of a revisit and reads back as null; rows that
repeat an id are records of their own; of several rows with the largest id of an equal payload, one (the first by URL) is
the response and the others revisit it; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, store

INDEX = "page_id long, url string, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "1970-01-01T00:00:00Z"


def _uuid(page: int | None) -> str:
    h = f"{(page if page is not None else -1) & (1 << 64) - 1:016x}"
    return f"{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}0{'0' if page is not None else '1'}-000000000000"


def _page(uuid: str) -> int | None:
    h = uuid.replace("-", "")
    if h[19] == "1":
        return None
    v = int(h[:12] + h[13:16] + h[17], 16)
    return v - (1 << 64) if v >> 63 else v


def _line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record, compressed; a revisit has no payload of its own."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{_uuid(page)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:uuid:{_uuid(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> dict:
    """Fields of one record in its compressed form."""
    plain = zlib.decompress(data, 31)
    head, body = plain.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    if version != "WARC/1.1" or int(field["Content-Length"]) != len(body) - 4:
        raise ValueError("not a whole record")
    to = field.get("WARC-Refers-To")
    return {
        "page_id": _page(field["WARC-Record-ID"][10:-1]),
        "url": field["WARC-Target-URI"] or None,
        "payload_bytes": int(field["X-Payload-Length"]),
        "payload_digest": base64.b32decode(field["WARC-Payload-Digest"][5:]).hex(),
        "record_type": field["WARC-Type"],
        "refers_to": None if to is None else _page(to[10:-1]),
        "payload": body[:-4] if field["WARC-Type"] == "response" else None,
    }


def _tagged(rows: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, html, sha1 and refers_to, the id of the response that a row revisits."""
    ids = rows.where(F.col("bytes") >= min_revisit).groupBy("sha1", "page_id").agg(F.count("*").alias("n"))
    twice = ids.groupBy(F.col("sha1").alias("digest")).agg(F.max("page_id").alias("original"), F.sum("n").alias("all"), F.max_by("n", "page_id").alias("ties"))
    twice = store.written(twice.where("`all` > 1 and original is not null").select("digest", "original", "ties"), "warc-digests")
    if twice.count() <= store.BROADCAST_KEYS:
        side, on = F.broadcast(twice), (rows["sha1"] == twice["digest"]) & (rows["bytes"] >= min_revisit)
    else:
        side = ids.join(twice, ids["sha1"] == twice["digest"]).select(F.col("page_id").alias("id"), "digest", "original", "ties")
        on = rows["page_id"].eqNullSafe(side["id"]) & (rows["sha1"] == side["digest"])
    joined = rows.join(side, on, "left").select("page_id", "url", "html", "sha1", "original", "ties")
    is_original = F.col("page_id").eqNullSafe(F.col("original"))
    tagged = joined.select("page_id", "url", "html", "sha1", F.when(~is_original, F.col("original")).alias("refers_to"), F.coalesce(is_original & (F.col("ties") > 1), F.lit(False)).alias("tied"))
    if not twice.where("ties > 1").limit(1).count():
        return tagged.drop("tied")
    # Rows that share the largest id: equal rows are counted as one, so that no group of them is gathered.
    tied = tagged.where("tied").groupBy("page_id", "sha1", "url").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    first = tied.groupBy("page_id", "sha1").agg(F.min(F.struct(F.col("url").isNotNull().alias("has_url"), "url")).alias("first"))
    tied = tied.join(first, ["page_id", "sha1"]).withColumn("k", F.explode(F.expr("sequence(1L, n)")))
    tied = tied.select("page_id", "url", "html", "sha1", F.when(~(F.col("url").eqNullSafe(F.col("first.url")) & (F.col("k") == 1)), F.col("page_id")).alias("refers_to"))
    return tagged.where("not tied").drop("tied").unionByName(tied)


def write(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """The index of archives written to the shared folder; its columns are INDEX."""
    spark = pages.sparkSession
    kernel.small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    tagged = _tagged(rows, min_revisit)
    root = store.new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pfs.FileSystem.from_uri(root)
        context, out, at = TaskContext.get(), None, 0
        name = f"{base}/{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        try:
            for batch in batches:
                index = []
                for page, url, html, sha1, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(name, compression=None)
                    payload = html.encode()
                    data = record(page, url, payload, sha1, refers)
                    out.write(data)
                    index.append({"page_id": page, "url": url, "archive": name, "offset": at, "length": len(data), "payload_bytes": len(payload), "payload_digest": sha1, "record_type": "response" if refers is None else "revisit", "refers_to": refers})
                    at += len(data)
                if index:
                    yield pa.RecordBatch.from_pylist(index, schema=_schema(INDEX))
        finally:
            if out is not None:
                out.close()

    index = store.written(tagged.mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("archive", F.concat(F.lit(root.split("://", 1)[0] + "://" if "://" in root else ""), "archive"))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def read(index: DataFrame, gap: int = 64 << 10, span: int = 4 << 20, block: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The selected records: rows of the index are dealt by archive and block of offsets, sorted, and ranges with at most
    ``gap`` unused bytes between them are read at once, ``span`` bytes at most.

    A task gets about ``task_bytes`` of records (less while there are fewer tasks than cores); their number follows from the
    sum of the lengths, as the index itself is too small to tell.
    """
    spark = index.sparkSession
    kernel.small_batches(spark)
    wanted = index.select("archive", "offset", "length").withColumn("block", F.expr(f"offset div {block}"))
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // task_bytes), min(spark.sparkContext.defaultParallelism, -(-total // block)), 1)
    wanted = wanted.repartition(tasks, "archive", "block").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None

        def load(archive: str, want: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal opened, source
            if archive != opened:
                fs, path = pfs.FileSystem.from_uri(archive)
                opened, source = archive, fs.open_input_file(path)
            first = want[0][0]
            source.seek(first)
            data = source.read(want[-1][0] + want[-1][1] - first)
            return pa.RecordBatch.from_pylist([checked(parse(data[o - first : o - first + n])) for o, n in want], schema=_schema(READ))

        held: list[tuple[int, int]] = []
        at = ""
        for batch in batches:
            for archive, offset, length in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if held and (archive != at or offset - held[-1][0] - held[-1][1] > gap or offset + length - held[0][0] > span):
                    yield load(at, held)
                    held = []
                at = archive
                held.append((offset, length))
        if held:
            yield load(at, held)

    return wanted.mapInArrow(run, READ)


def checked(found: dict) -> dict:
    """A response whose payload doesn't have its digest is an error."""
    if found["payload"] is not None and (hashlib.sha1(found["payload"]).hexdigest() != found["payload_digest"] or len(found["payload"]) != found["payload_bytes"]):
        raise ValueError(f"record of page {found['page_id']} is damaged")
    return found
