"""WARC archives with a Zstandard dictionary: written by tasks, one archive each, and read back.

An archive starts with a skippable frame that holds its dictionary (built from a bounded sample of
the archive's own records, spread over its first SAMPLE_BYTES); every record follows as a Zstandard
frame of its own, so each can be read alone. Of equal payloads of at least `min_bytes` the record with
the smallest id is a response and the others are revisit records without payload.

Duplicates are found by digest: ids are reduced to the smallest for each digest before the shuffle, and
the rows are joined with the written table of digests that occur more than once, a join that Spark
can split on a hot digest. A task then streams its rows into a file in `folder`, which all machines
must reach (any store that pyarrow knows); the file gets its name only when it is complete, so a
task that is run again replaces it.

Defined results: a null payload is empty; payloads below `min_bytes` are always responses; a record
without id ranks last, and if no equal record has an id it is a response; rows that share the
smallest id are all responses; repeated rows give a record each; an empty table gives no archive and
an empty result; other columns are not carried (url is, null: empty).
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

MIN_BYTES, LEVEL, DICT_BYTES, SAMPLE_BYTES = 100, 3, 32_768, 3_000_000
#: Magic number of the skippable frame with the dictionary.
SKIPPABLE = 0x184D2A5D
CRLF = b"\r\n"


def with_record_types(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.octet_length("payload") >= min_bytes)
    several = long.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").select("digest", "original")
    out = rows.join(cut_lineage(several), "digest", "left")
    revisit = F.col("original").isNotNull() & ((F.col("page_id") != F.col("original")) | F.col("page_id").isNull())
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("original")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record: a response holds the payload, a revisit the headers of the response alone."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http + payload if refers_to is None else http
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to, digest)
        head["X-Refers-To-Page-Id"] = str(refers_to)
    return CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in head.items()), b""]) + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> dict:
    """Headers of a record, and its payload: bytes, or None for a revisit."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    size = next(int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    return fields | {"size": size, "payload": payload if fields["WARC-Type"] == "response" else None}


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES):
    """A trained dictionary; where the samples are too few for training, their own bytes."""
    import zstandard

    if not samples:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(typed: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Writes one archive for each partition: (archive, records, bytes)."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        def records():
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    yield record(*r)

        source, first, total = records(), [], 0
        for r in source:
            first.append(r)
            total += len(r)
            if total >= SAMPLE_BYTES:
                break
        if not first:
            return
        context = TaskContext.get()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():06d}.warc.zst"
        part = f"{root}/.{name}-{context.taskAttemptId()}"
        dictionary = build_dictionary([r[:20_000] for r in first])
        packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
        n = written = 0
        with store.open_output_stream(part, compression=None) as f:
            raw = dictionary.as_bytes()
            written += f.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
            for chunk in (first, source):
                for r in chunk:
                    written += f.write(packer.compress(r))
                    n += 1
        store.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([written], pa.int64())], ["archive", "records", "bytes"])

    return typed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, records long, bytes long")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Reads archives record by record and checks every response against its digest."""

    def run(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                out: list[tuple] = []
                for fields in records_of(folder, name):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload = fields["payload"]
                    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != fields["size"]):
                        raise ValueError(f"{name}: a payload does not match its digest")
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                    out.append((number("X-Page-Id"), fields["WARC-Target-URI"], fields["WARC-Type"], fields["size"], digest, number("X-Refers-To-Page-Id")))
                    if len(out) == 1000:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return archives.select("archive").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))


def records_of(folder: str, name: str, step: int = 65_536):
    """The parsed records of one archive, as a stream."""
    import zstandard

    store, root = _store(folder)
    with store.open_input_stream(f"{root}/{name}", compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{name}: no dictionary frame")
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        data = b""
        while True:
            if not data:
                data = f.read(step)
                if not data:
                    return
            frame, parts = unpacker.decompressobj(), []
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                data = f.read(step)
                if not data:
                    raise ValueError(f"{name}: the last record is cut off")
            yield parse(b"".join(parts))


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives of all pages: (archive, records, bytes), written as a table so that it runs once."""
    return cut_lineage(write(with_record_types(pages, id_col, url_col, payload_col, min_bytes), folder))
