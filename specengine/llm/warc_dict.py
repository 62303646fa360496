"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Every task writes archives of about ARCHIVE_BYTES.  It trains a dictionary on the first records of an
archive (SAMPLE_BYTES of them at most), writes it in a leading skippable frame (magic 0x184D2A5D), and
then each record as a frame of its own, so that a reader needs nothing but the file and can start at
any record.  The manifest has one row per archive.

Of records with equal payloads of MIN_REVISIT bytes or more that with the smallest page id is the
response, the others are revisits without payload that name it.  Only payloads that occur twice are
joined back, by their SHA-256; that table is broadcast if it is counted and small.

Archives go to the shared folder under names with the partition and the attempt; only those that the
manifest lists count, so that a repeated or lost task leaves no record twice.

Defined cases: null html is an empty payload; null url is written as an empty target; null ids are no
candidates for a response unless all ids of a payload are null, and then all of its records are
responses; rows that repeat the smallest id are responses too; no rows, no archives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specengine.llm.common import small_or_shuffled
from specengine.session import checkpoint, scratch_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 256_000_000
SAMPLE_BYTES, DICTIONARY_BYTES, LEAST_SAMPLES = 4_000_000, 112_640, 16
LEVEL = 6
MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "path string, records long, payload_bytes long, file_bytes long, dictionary_bytes long"
RECORD = ("page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to {id}, payload binary")


def with_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set for revisits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    twice = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1").select(
        F.col("digest").alias("of"), "first")
    joined = rows.join(small_or_shuffled(twice), F.col("digest") == F.col("of"), "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisits, F.col("first")).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a line break in a header value becomes a blank."""
    def clean(value) -> str:
        return " ".join(str(value).splitlines())

    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    key = hashlib.sha256(f"{page_id}|{digest}".encode()).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{key[:8]}-{key[8:12]}-{key[12:16]}-{key[16:20]}-{key[20:32]}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url) if url is not None else ''}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {clean(page_id)}")
    if refers_to is not None:
        head += [f"X-Refers-To-Page-ID: {clean(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or nothing where there is too little to train on."""
    import zstandard

    if len(samples) < LEAST_SAMPLES:
        return b""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(typed: DataFrame, folder: str) -> DataFrame:
    """Write the rows of `with_types` below the folder; the manifest."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        number, rows = 0, _records(batches)
        first = next(rows, None)
        while first is not None:
            path = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{number:03d}.warc.zst"
            held, size = [first], len(first[0])
            while size < SAMPLE_BYTES and (row := next(rows, None)) is not None:
                held.append(row)
                size += len(row[0])
            # Single samples may be long; the trainer looks at their beginnings.
            dictionary = _dictionary([r[0][:131_072] for r in held])
            packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(
                dictionary) if dictionary else None)
            written = records = payloads = 0
            with store.open_output_stream(path, compression=None) as out:
                written += out.write(MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
                first = None
                for row in _chain(held, rows):
                    if written >= ARCHIVE_BYTES:
                        first = row
                        break
                    written += out.write(packer.compress(row[0]))
                    records += 1
                    payloads += row[1]
            number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (path, records, payloads, written, len(dictionary))],
                [c.split()[0] for c in MANIFEST.split(", ")])

    return typed.mapInArrow(step, MANIFEST)


def _chain(held: list, rows: Iterator) -> Iterator:
    held.reverse()
    while held:
        yield held.pop()
    yield from rows


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
            yield record(page_id, url, payload, digest, refers_to), len(payload)


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of every record of an archive, from a binary stream."""
    import zstandard

    magic, size = int.from_bytes(stream.read(4), "little"), int.from_bytes(stream.read(4), "little")
    if magic != MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    dictionary = stream.read(size)
    reader = zstandard.ZstdDecompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).stream_reader(
        stream, read_across_frames=True)
    rest = b""

    def more(n: int) -> bool:
        nonlocal rest
        while len(rest) < n:
            got = reader.read(max(n - len(rest), 1 << 16))
            if not got:
                return False
            rest += got
        return True

    while more(1):
        while (end := rest.find(b"\r\n\r\n")) < 0:
            if not more(len(rest) + 1):
                raise ValueError("a record is cut off")
        lines = rest[:end].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        length = int(headers["Content-Length"])
        if not more(end + 4 + length + 4):
            raise ValueError("a record is cut off")
        body, rest = rest[end + 4:end + 4 + length], rest[end + 4 + length + 4:]
        yield headers, body


def read(manifest: DataFrame, folder: str, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """Records of the archives that a manifest lists; a response's length and digest come from its payload."""
    number = id_type in ("long", "bigint", "int", "integer", "short", "byte")
    columns = RECORD.format(id=id_type) if payloads else RECORD.format(id=id_type).removesuffix(", payload binary")
    arrow = {"string": pa.string(), "int": pa.int32(), "integer": pa.int32()}.get(id_type, pa.int64())
    kinds = [arrow, pa.string(), pa.int64(), pa.string(), pa.string(), arrow, pa.binary()][:None if payloads else -1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in columns.split(", ")])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for head, body in read_archive(stream):
                        ids = [head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")]
                        ids = [int(x) if number and x is not None else x for x in ids]
                        kind = head["WARC-Type"]
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        length = int(head["X-Payload-Length"])
                        if kind == "response":
                            found = hashlib.sha256(body).hexdigest()
                            if found != digest or len(body) != length:
                                raise ValueError(f"{path}: the payload of page {ids[0]} is damaged")
                        rows.append((ids[0], head["WARC-Target-URI"], length, digest, kind, ids[1], body)[:len(kinds)])
                        size += len(body)
                        if size > 8_000_000 or len(rows) >= 5000:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    paths = manifest.select("path")
    n = max(1, paths.count())
    return paths.repartition(n).mapInArrow(step, columns)


def archive(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write all pages, then read all archives back: one row per record."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = checkpoint(write(with_types(pages), folder))  # written once, whatever reads the manifest
    return read(manifest, folder, pages.schema["page_id"].dataType.simpleString().replace("bigint", "long"), payloads)
