"""Zstandard WARC archives: a dictionary in a leading skippable frame, then one frame a record.

Writing: each task rolls archives of bounded size in the shared folder; an archive's dictionary is trained on the
records at its head. A task writes to a name of its own and renames at the end, so a task that is run again replaces its
file by an equal one, and a manifest names the archives that count. Reading goes frame by frame; magic numbers, headers,
lengths and digests are checked, and a record that fails raises ValueError.

Nulls, ties and odd input: null html is an empty payload; a null page_id is written as "null" and read back as null, and
is never the smallest; rows that repeat the smallest page_id of their payload are responses too; urls may be null or
hold line ends (they are percent-encoded); an empty table writes no archive and reads back no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, salted, scratch, stored

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
SALTS = 64


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex) and refers_to: the smallest page_id with an equal payload, null for responses."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = salted(groups.where("n > 1").drop("n"), SALTS)
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    found = rows.withColumn("salt", salt).join(repeated, ["sha256", "salt"], "left")
    return found.select("page_id", "url", F.sha1("payload").alias("sha1"), F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"), "payload")


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record: an HTTP response with its payload, or a revisit with the response's head alone."""
    payload, name = row["payload"], lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    block = head if revisit else head + payload
    digest = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(row["page_id"])), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", quote(row["url"], safe=":/?#[]@!$&'()*+,;=%-._~")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()))
    fields.append(("WARC-Block-Digest", "sha1:" + digest(block)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(row["refers_to"]))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_for(samples: list[bytes], size: int):
    """A dictionary trained on the samples; their bytes themselves if they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_writer(folder: str, archive_bytes: int, dictionary_bytes: int, sample_bytes: int):
    """A mapInArrow function that writes its rows as archives and returns their manifest."""

    def write(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        done, pending, held, out, compressor, number = [], [], 0, None, None, 0

        def start():
            nonlocal out, compressor, held
            dictionary = dictionary_for([x[:sample_bytes] for x in pending], dictionary_bytes)
            compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
            packed = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
            name = f"{base}/.{task.partitionId()}-{number}-{task.taskAttemptId()}"
            out = [fs.open_output_stream(name), name, 0, 0]
            put(struct.pack("<II", SKIPPABLE, len(packed)) + packed, 0)
            for x in pending:
                put(compressor.compress(x), 1)
            pending.clear()
            held = 0

        def put(data, records):
            out[0].write(data)
            out[2] += records
            out[3] += len(data)

        def finish():
            nonlocal out, number
            if out is None and pending:
                start()
            if out is not None:
                out[0].close()
                final = f"{base}/part-{task.partitionId():05d}-{number:05d}.warc.zst"
                fs.move(out[1], final)
                done.append((f"{folder}/{final.rsplit('/', 1)[1]}", out[2], out[3]))
                out, number = None, number + 1

        for batch in batches:
            for at in range(batch.num_rows):
                record = record_bytes(batch.slice(at, 1).to_pylist()[0])
                if out is None:
                    pending.append(record)
                    held += len(record)
                    if held >= sample_bytes * 8:
                        start()
                else:
                    put(compressor.compress(record), 1)
                if out is not None and out[3] >= archive_bytes:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = 16 << 20, dictionary_bytes: int = 1 << 14, sample_bytes: int = 1 << 17) -> DataFrame:
    """Writes the pages as archives and returns the stored manifest: path, records, bytes."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return stored(roles(pages, min_bytes).mapInArrow(archive_writer(folder, archive_bytes, dictionary_bytes, sample_bytes), MANIFEST), "warc-manifest")


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstd frame that begins at `at` ends, from its block headers."""
    import zstandard

    flags = data[at + 4]
    pos = at + zstandard.frame_header_size(data[at : at + 18])
    last = 0
    while not last:
        head = int.from_bytes(data[pos : pos + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3 or pos + 3 > len(data):
            raise ValueError(f"bad block at byte {pos}")
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise ValueError("the archive ends inside a frame")
    return pos


def records_of(content: bytes):
    """The records of one archive, each a (headers, block) pair of checked lengths."""
    import zstandard

    data, at, reader = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError(f"{len(data) - at} stray bytes at the end")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            body = bytes(data[at + 8 : at + 8 + size])
            if len(body) != size:
                raise ValueError("the archive ends inside a skippable frame")
            if at == 0 and magic == SKIPPABLE:
                if body[:4] == struct.pack("<I", FRAME):
                    body = zstandard.ZstdDecompressor().decompress(body)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        end = frame_end(data, at)
        yield parse_record(reader.decompressobj().decompress(bytes(data[at:end])))
        at = end


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"missing headers: {sorted(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"content length {fields['content-length']} where the frame has {len(rest) - 4}")
    return fields, rest[:-4]


def page_of(fields: dict, block: bytes) -> dict:
    """One row of RECORDS from a record, with its digests verified."""
    identity = lambda x: None if x == "<urn:page:null>" else int(re.fullmatch(r"<urn:page:(-?\d+)>", x)[1])
    digest = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    if fields.get("warc-block-digest", "") != "sha1:" + digest(block):
        raise ValueError(f"block digest of {fields['warc-record-id']} differs")
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    stated, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its headers")
    url = fields.get("warc-target-uri")
    return {
        "page_id": identity(fields["warc-record-id"]), "url": None if url is None else unquote(url), "payload_bytes": length, "payload_digest": stated,
        "record_type": fields["warc-type"], "refers_to": identity(fields["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
    }


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest names; without payloads on demand."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = {c.split()[0]: c for c in RECORDS.split(", ")}

    def read(batches):
        import pyarrow as pa

        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [pa.field(n, types[kinds[n].split()[1]]) for n in names]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in fields], schema=pa.schema(fields))

        for given in batches:
            for path, records in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as f:
                    content = f.read()
                rows, held, seen = [], 0, 0
                for fields_, block in records_of(content):
                    rows.append(page_of(fields_, block))
                    held, seen = held + len(block) * payloads, seen + 1
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{path} has {seen} records, its manifest {records}")
                yield batch(rows)

    spark = manifest.sparkSession
    spread = manifest.select("path", "records").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(read, ", ".join(kinds[n] for n in names))
