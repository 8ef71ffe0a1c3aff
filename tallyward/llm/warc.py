"""WARC archives through a chunked record table.

Pages become rows (record, chunk number, chunk): a payload is cut into chunks of bounded size, each with the
digest of the payload up to its end. Every chunk is one WARC/1.1 record: the first a ``response``, further ones
``continuation`` records with segment numbers, as the standard has it for segmented payloads; a page whose
payload another page already has is a ``revisit`` without payload. Spark's text writer joins records with the
empty line that ends a WARC record, its text reader splits archives at the version line, so archives lie in any
store that Spark reaches and are read in parallel.

On the way back a payload of one chunk is hashed where it lies. The chunks of longer ones are sorted by record and
number and stream through a task that carries the digest: no task holds a whole payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.storage import map_arrow, scratch

CHUNK_BYTES = 64 * 1024
SHARED_FROM_BYTES = 100
RECORDS_PER_FILE = 20_000
WRITTEN_AT = "2001-12-31T06:00:00Z"
VERSION = "WARC/1.1"
_BATCH_BYTES = 4 * 1024**2
_END = "\r\n\r\n"

_CHUNKS = pa.schema([("row_no", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("n_chunks", pa.int64()),
                     ("chunk", pa.string()), ("digest_so_far", pa.string())])
_CHUNK_DDL = ("row_no BIGINT, page_id BIGINT, url STRING, payload_bytes BIGINT, payload_digest STRING, refers_to BIGINT, "
              "chunk_no BIGINT, n_chunks BIGINT, chunk STRING, digest_so_far STRING")


def cuts(payload: memoryview, most: int) -> list[int]:
    """Ends of chunks of at most ``most`` bytes: between characters, and inside each version mark so that none is left whole."""
    ends, at = [], 0
    mark = VERSION.encode()
    while at < len(payload):
        end = min(at + most, len(payload))
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        inside = bytes(payload[at:end]).find(mark)
        at = at + inside + 4 if inside >= 0 else end
        ends.append(at)
    return ends or [0]


def _chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        fixed = batch.drop_columns(["payload"]).to_pylist()
        for row, payload in zip(fixed, batch.column("payload")):
            view = memoryview(payload.as_buffer() or b"") if row["refers_to"] is None else memoryview(b"")
            digest, start, ends = hashlib.sha256(), 0, cuts(view, most)
            for number, end in enumerate(ends, 1):
                digest.update(view[start:end])
                rows.append(row | {"chunk_no": number, "n_chunks": len(ends), "chunk": bytes(view[start:end]).decode(),
                                   "digest_so_far": digest.hexdigest()})
                held += end - start
                start = end
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _CHUNKS)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _CHUNKS)


def page_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of ``pages`` (page_id, url, html): see ``write_archives`` for the record types."""
    if chunk_bytes < 16:
        raise ValueError("a chunk must hold at least 16 bytes")
    payload = F.coalesce("html", F.lit(""))
    records = pages.select(
        F.monotonically_increasing_id().alias("row_no"), "page_id", F.regexp_replace("url", r"[\r\n]|WARC/", " ").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    # Only payloads that several pages have need a leader; ids of equal payloads are combined before the shuffle.
    sizes = pages.select("page_id", F.sha2(payload, 256).alias("leader_digest"), F.octet_length(payload).alias("size"))
    leaders = (sizes.where(F.col("size") >= SHARED_FROM_BYTES).groupBy("leader_digest")
               .agg(F.min("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1 and leader is not null").drop("n"))
    led = records.join(leaders, F.col("payload_digest") == F.col("leader_digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader")).alias("refers_to")
    return led.select("row_no", "page_id", "url", "payload_bytes", "payload_digest", refers, "payload").transform(
        map_arrow,
        lambda batches: _chunked(batches, chunk_bytes), _CHUNK_DDL)


def record_id(page_id, digest, number):
    """A UUID made from what identifies the record."""
    h = F.md5(F.concat_ws("/", page_id.cast("string"), digest, number.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes gzip-compressed WARC files below ``path``.

    Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is the response (all of them, if that
    row repeats), the others revisit it; shorter payloads are all responses. A null html is an empty payload, a page with
    a null page_id never is what others revisit. Payloads of any length go through in chunks. An empty table gives files without
    records; columns besides page_id, url and html are not read.
    """
    chunks = page_chunks(pages, chunk_bytes)
    first = F.col("chunk_no") == 1
    revisit = F.col("refers_to").isNotNull()
    http = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                  F.col("payload_bytes").cast("string"), F.lit(_END))).otherwise("")
    block = F.concat(http, "chunk")
    own = record_id(F.col("page_id"), F.col("payload_digest"), F.col("chunk_no"))
    origin = record_id(F.col("page_id"), F.col("payload_digest"), F.lit(1))
    field = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))
    some = lambda condition, value: F.when(condition, value).otherwise("")
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(~first, "continuation").when(revisit, "revisit").otherwise("response"),
        field("WARC-Record-ID", own), field("WARC-Date", F.lit(WRITTEN_AT)), field("Row-Number", F.col("row_no")),
        some(F.col("page_id").isNotNull(), field("Page-ID", F.col("page_id"))), some(F.col("url").isNotNull(), field("WARC-Target-URI", F.col("url"))),
        some(first, field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest"))),
        some(revisit, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                               field("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"), F.lit(1))))),
        some(F.col("n_chunks") > 1, field("WARC-Segment-Number", F.col("chunk_no"))),
        some(~first, field("WARC-Segment-Origin-ID", origin)),
        some((F.col("n_chunks") > 1) & (F.col("chunk_no") == F.col("n_chunks")), field("WARC-Segment-Total-Length", F.col("payload_bytes"))),
        field("Digest-So-Far", F.concat(F.lit("sha256:"), "digest_so_far")), field("Content-Length", F.octet_length(block)),
        F.lit(_END), block)
    (chunks.select(F.coalesce(record, F.lit("")).alias("value")).write.mode("overwrite").option("lineSep", _END)
     .option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives that ``write_archives`` wrote: one row per WARC record."""
    raw = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).where("value <> ''")
    head = F.substring_index("value", _END, 1)
    split = raw.select(head.alias("head"), F.col("value").cast("binary").alias("bytes"))
    field = lambda name: F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    known = lambda name: F.when(field(name) != "", field(name))
    body = F.expr("substring(bytes, octet_length(head) + 5, size)")
    fields = split.select(
        "head", "bytes", field("Content-Length").cast("int").alias("size"), field("WARC-Type").alias("type"), field("Row-Number").cast("long").alias("row_no"),
        known("Page-ID").cast("long").alias("page_id"), field("WARC-Record-ID").alias("record_id"), known("WARC-Refers-To").alias("refers_id"),
        known("WARC-Segment-Origin-ID").alias("origin_id"), F.coalesce(known("WARC-Segment-Number").cast("long"), F.lit(1)).alias("chunk_no"),
        known("WARC-Segment-Number").isNotNull().alias("segmented"), F.substring(field("WARC-Payload-Digest"), 8, 64).alias("declared"),
        F.substring(field("Digest-So-Far"), 8, 64).alias("digest_so_far")).withColumn("block", body)
    # The HTTP head of a first segment is ASCII and ends with the first empty line.
    http = F.when(F.col("type") == "continuation", 0).otherwise(F.length(F.substring_index(F.decode(F.substring("block", 1, 256), "iso-8859-1"), _END, 1)) + 4)
    return fields.withColumn("http_size", http).select(
        "row_no", F.coalesce("origin_id", "record_id").alias("record_id"), "type", "page_id", "refers_id", "chunk_no", "segmented", "declared",
        "digest_so_far", F.expr("substring(block, http_size + 1, size)").alias("chunk"))


_DIGESTS = pa.schema([("row_no", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("declared", pa.string()),
                      ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record from its chunks in order: size and digest grow chunk by chunk."""
    now, done = None, []
    for batch in batches:
        for row, chunk in zip(batch.drop_columns(["chunk"]).to_pylist(), batch.column("chunk")):
            if now is None or now["row_no"] != row["row_no"]:
                done += [now] if now else []
                now = row | {"hash": hashlib.sha256(), "payload_bytes": 0, "intact": True, "next": 1}
            view = memoryview(chunk.as_buffer())
            now["hash"].update(view)
            now["payload_bytes"] += len(view)
            now["payload_digest"] = now["hash"].hexdigest()
            now["intact"] &= row["chunk_no"] == now["next"] and row["digest_so_far"] == now["payload_digest"]
            now["next"] += 1
            if row["chunk_no"] == 1:
                now["page_id"], now["declared"] = row["page_id"], row["declared"]
        if done:
            yield _finished(done)
            done = []
    if now:
        yield _finished([now])


def _finished(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{k: r[k] for k in _DIGESTS.names} | {"intact": r["intact"] and r["declared"] == r["payload_digest"]} for r in rows], _DIGESTS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Sizes and digests are computed from the archived payloads; those of a revisit are its response's. ``intact``
    tells whether chunks are complete and agree with the digests that the archive declares.
    """
    chunks = read_chunks(spark, path)
    whole = chunks.where("type = 'response' and not segmented").select(
        "row_no", "record_id", "page_id", "declared", F.octet_length("chunk").cast("long").alias("payload_bytes"),
        F.sha2("chunk", 256).alias("payload_digest")).withColumn("intact", F.col("declared") == F.col("payload_digest"))
    parts = chunks.where("type <> 'revisit' and segmented").select("row_no", "record_id", "page_id", "declared", "chunk_no", "digest_so_far", "chunk")
    carried = map_arrow(
        parts.repartition("row_no").sortWithinPartitions("row_no", "chunk_no"), _carried, "row_no BIGINT, record_id STRING, page_id BIGINT, declared STRING, payload_bytes BIGINT, payload_digest STRING, intact BOOLEAN")
    responses = whole.unionAll(carried)
    named = responses.groupBy("record_id").agg(
        F.min("page_id").alias("to"), F.min("payload_bytes").alias("to_bytes"), F.min("payload_digest").alias("to_digest"), F.min("intact").alias("to_intact"))
    revisits = chunks.where("type = 'revisit'").select("page_id", "refers_id", "declared").join(named, F.col("refers_id") == F.col("record_id"), "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                            F.lit(None).cast("long").alias("refers_to"), "intact").unionAll(revisits.select(
                                "page_id", F.col("to_bytes"), F.col("to_digest"), F.lit("revisit"), F.col("to"),
                                F.coalesce(F.col("to_intact") & (F.col("declared") == F.col("to_digest")), F.lit(False))))


def archive_round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: the rows of ``read_records``."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, chunk_bytes)
    return read_records(pages.sparkSession, path)
