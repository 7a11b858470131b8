"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record."""
import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pick
from plumbline.session import shared_folder

DICTIONARY_MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
RECORD = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, error string")


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                 min_bytes: int = 0) -> DataFrame:
    """Records to write: of equal payloads of at least ``min_bytes`` the one with the largest page_id is the response,
    the others revisit it.  Smaller payloads are all responses.  A null html is an empty payload; repeated rows of the
    response's page_id are responses too; rows without a page_id are responses unless another row holds the payload.

    Only digests are aggregated.  Skewed digests (copies of one page) are split by Spark's skew join.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pick(pages, page_id=page_id, url=url, html=html).select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("_sha1"))
    first = (pick(pages, page_id=page_id, html=html)
             .select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload"))
             .where(F.octet_length("payload") >= min_bytes).select("page_id", F.sha1("payload").alias("_sha1"))
             .groupBy("_sha1").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(first, "_sha1", "left").select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("_sha1").alias("sha1_hex"), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(r: dict) -> bytes:
    """Header lines, an empty line, the content block and two line ends.  Values are cut of control characters."""
    block = r["payload"] if r["payload"] is not None else b""
    digest = base64.b32encode(bytes.fromhex(r["sha1_hex"])).decode()
    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", _urn(r["page_id"])), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
              ("X-Payload-Length", str(r["payload_bytes"])), ("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    if r["url"] is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in r["url"] if c >= " " and c != "\x7f")))
    if r["refers_to"] is not None:
        fields += [("WARC-Refers-To", _urn(r["refers_to"])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Read one record back and check version, length, digests and the closing line ends.  ``error`` says what is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out: dict = {"page_id": None, "url": fields.get("warc-target-uri"), "payload": None, "payload_bytes": None,
                 "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                 "record_type": fields.get("warc-type"), "refers_to": None, "error": None}
    try:
        page, refers = (fields.get(k, "<urn:page:>")[len("<urn:page:"):-1] for k in ("warc-record-id", "warc-refers-to"))
        out["page_id"], out["refers_to"] = int(page) if page else None, int(refers) if refers else None
        length, out["payload_bytes"] = int(fields["content-length"]), int(fields["x-payload-length"])
    except (KeyError, ValueError) as e:
        return out | {"error": f"header field: {e}"}
    block = rest[:length]
    if not gap or lines[0] != "WARC/1.1":
        return out | {"error": "not a WARC/1.1 record"}
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        return out | {"error": "length differs from Content-Length"}
    found = base64.b32encode(hashlib.sha1(block).digest()).decode()
    if fields.get("warc-block-digest") != f"sha1:{found}":
        return out | {"error": "block digest differs"}
    if out["record_type"] == "response" and (length != out["payload_bytes"] or found != out["payload_digest"]):
        return out | {"error": "payload digest or length differs"}
    return out | {"payload": block if out["record_type"] == "response" else None}


def trained(samples: list[bytes], size: int) -> bytes:
    """Dictionary trained on the archive's first records; empty when they are too few or too short to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(records: DataFrame, path: str, archive_bytes: int = 128 << 20, dictionary_bytes: int = 32 << 10,
                   sample_bytes: int = 2 << 20, level: int = 6) -> DataFrame:
    """Write archives below ``path`` (local, HDFS or object store URI) and return (archive, records, bytes).

    A task rolls to a new archive at ``archive_bytes``.  Names are unique per attempt: those of failed or repeated
    attempts are not in the returned rows, which must be stored before reading (a row is a committed archive).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        sink = packer = None
        name, count, size, waiting, held = "", 0, 0, [], 0

        def close() -> dict | None:
            nonlocal sink, count, size
            if sink is None:
                return None
            sink.close()
            done, sink, count, size = {"archive": name, "records": count, "bytes": size}, None, 0, 0
            return done

        def put(data: bytes) -> None:
            nonlocal count, size
            frame = packer.compress(data)
            sink.write(frame)
            count, size = count + 1, size + len(frame)

        def open_new() -> None:
            nonlocal sink, packer, name, size, waiting, held
            name = f"{path.rstrip('/')}/pages-{uuid.uuid4().hex}.warc.zst"
            sink = fs.open_output_stream(f"{root.rstrip('/')}/{name.rsplit('/', 1)[1]}", compression=None)
            raw = trained(waiting, dictionary_bytes)
            packed = zstandard.ZstdCompressor(level=19).compress(raw)
            sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            size = 8 + len(packed)
            packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
            for data in waiting:
                put(data)
            waiting, held = [], 0

        done = []
        for batch in batches:
            for r in batch.to_pylist():
                data = record_bytes(r)
                if sink is None:
                    waiting.append(data)
                    held += len(data)
                    if held >= sample_bytes:
                        open_new()
                else:
                    put(data)
                if sink is not None and size >= archive_bytes:
                    done.append(close())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=MANIFEST)
                done = []
        if waiting:
            open_new()
        if last := close():
            yield pa.RecordBatch.from_pylist([last], schema=MANIFEST)

    return records.mapInArrow(run, "archive string, records long, bytes long")


MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())])


def _exactly(source, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError("archive ends inside a frame")
    return data


def read_frames(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an open archive, one per frame.  Only one chunk and one record are in memory."""
    magic, size = struct.unpack("<II", _exactly(source, 8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start")
    raw = zstandard.ZstdDecompressor().decompress(_exactly(source, size))
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    frame, parts, pending = unpacker.decompressobj(), [], source.read(chunk)
    started = False
    while pending:
        started = True
        parts.append(frame.decompress(pending))
        if frame.eof:
            yield b"".join(parts)
            pending, frame, parts, started = frame.unused_data, unpacker.decompressobj(), [], False
            if pending:
                continue
        pending = source.read(chunk)
    if started:
        raise ValueError("archive ends inside a frame")


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records of the archives named in column ``archive``, with ``error`` set on a record that fails a check.  A damaged
    archive yields the records before the damage and one row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(name)
                with fs.open_input_stream(at, compression=None) as source:
                    try:
                        for data in read_frames(source):
                            r = parse_record(data)
                            if not keep_payload:
                                r["payload"] = None
                            rows.append(r)
                            held += len(data) if keep_payload else 200
                            if held >= 4 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)
                                rows, held = [], 0
                    except (ValueError, zstandard.ZstdError) as e:
                        rows.append({"error": f"{name}: {e}"})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)

    return archives.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, keep_payload: bool = False, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write the pages as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = "file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
    manifest = f"{folder}-manifest"
    write_archives(plan_records(pages, min_bytes=min_bytes, **columns), uri).write.parquet(manifest)
    archives = spark.read.parquet(manifest)
    # a task per archive: adaptive execution would merge the short rows of the manifest into one
    return read_archives(archives.repartition(max(1, archives.count())), keep_payload)
