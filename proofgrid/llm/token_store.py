"""Token files: ids bit-packed at the vocabulary's fixed width in blocks, with block offsets and a document index.

A file holds magic and sizes, byte-aligned blocks of BLOCK ids, then a footer with the documents (id, first token in the
file, tokens) and the byte offset of each block, so any run of ids is read from its own blocks alone. Files follow each
other in ascending doc_id; a manifest names them and gives the ids before each.

Nulls, ties and odd input: a null text is empty and encodes to the end id alone; null ids come first; rows with equal
ids are in order of their text; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, filesystem, scratch, stored, text_or_empty
from .tokens import END_ID, VOCABULARY, shared_tokenizer

MAGIC = b"PGTOKENS"
BLOCK = 4096


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits == 16:
        return ids.astype(">u2").tobytes()
    rows = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(rows[:, 32 - bits :]).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    rows = np.zeros((n, 32), np.uint8)
    rows[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(rows, axis=1).view(">u4").ravel().astype(np.uint32)


class TokenFileWriter:
    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.at, self.held, self.offsets, self.docs, self.tokens = 0, np.zeros(0, np.uint32), [], [], 0
        self.put(MAGIC + struct.pack("<II", bits, block))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.held = np.concatenate([self.held, ids])
        while len(self.held) >= self.block:
            self.flush()

    def flush(self) -> None:
        self.offsets.append(self.at)
        self.put(pack(self.held[: self.block], self.bits))
        self.held = self.held[self.block :]

    def close(self) -> None:
        if len(self.held):
            self.flush()
        footer = np.array(self.docs, "<i8").reshape(-1, 4).tobytes() + np.array(self.offsets, "<i8").tobytes()
        self.put(footer + struct.pack("<QQQ", len(self.docs), len(self.offsets), self.tokens) + MAGIC)
        self.out.close()


class TokenFile:
    """Random access to a token file through any file object that can seek."""

    def __init__(self, file, size: int):
        self.file = file
        if (head := self.read(0, 16))[:8] != MAGIC or (tail := self.read(size - 32, 32))[24:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block = struct.unpack("<II", head[8:])
        n_docs, n_blocks, self.tokens = struct.unpack("<QQQ", tail[:24])
        footer = self.read(size - 32 - 8 * (4 * n_docs + n_blocks), 8 * (4 * n_docs + n_blocks))
        numbers = np.frombuffer(footer, "<i8")
        self.docs, self.offsets = numbers[: 4 * n_docs].reshape(-1, 4), numbers[4 * n_docs :]

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids [start, stop), from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        of = lambda k: min(self.block, self.tokens - k * self.block)
        end = int(self.offsets[last]) + (of(last) * self.bits + 7) // 8
        data, out = self.read(int(self.offsets[first]), end - int(self.offsets[first])), []
        for k in range(first, last + 1):
            out.append(unpack(data[int(self.offsets[k] - self.offsets[first]) :][: (of(k) * self.bits + 7) // 8], self.bits, of(k)))
        ids = np.concatenate(out)
        return ids[start - first * self.block : stop - first * self.block]


def write_tokens(docs: DataFrame, tokenizer_path: str | None = None, vocabulary: int = VOCABULARY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id; the stored manifest: path, base, docs, tokens, bytes."""
    spark = docs.sparkSession
    folder, bits = scratch(spark, "tokens"), bits_for(vocabulary)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, writer, name, n = TaskContext.get(), None, None, 0
        fs, base = filesystem(folder)
        tokenizer = shared_tokenizer(tokenizer_path)
        for rows in chunks(batches):
            if writer is None:
                fs.create_dir(base, recursive=True)
                name = f"{base}/.{task.partitionId()}-{task.taskAttemptId()}"
                writer = TokenFileWriter(fs.open_output_stream(name), bits, block)
            for row in rows:
                writer.add(row["doc_id"], tokenizer.encode(row["text"], end_id))
            n += len(rows)
        if writer is not None:
            writer.close()
            final = f"part-{task.partitionId():06d}.tokens"
            fs.move(name, f"{base}/{final}")
            made = [[task.partitionId()], [f"{folder}/{final}"], [n], [writer.tokens], [writer.at]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == 1 else pa.int64()) for k, v in enumerate(made)], ["part", "path", "docs", "tokens", "bytes"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(many, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = stored(ordered.mapInArrow(write, "part long, path string, docs long, tokens long, bytes long"), "tokens-manifest")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), "docs", "tokens", "bytes")


def read_tokens(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids on demand) of every document in the files of a manifest."""

    def read(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]
        for given in batches:
            for row in given.to_pylist():
                fs, inner = filesystem(row["path"])
                with fs.open_input_file(inner) as f:
                    tokens = TokenFile(f, row["bytes"])
                    for at in range(0, len(tokens.docs), 512):
                        some, out = tokens.docs[at : at + 512], []
                        for known, doc_id, start, n in some.tolist():
                            own = tokens.span(start, start + n)
                            out.append((doc_id if known else None, row["base"] + start, n, zlib.crc32(own.astype("<u4").tobytes()), *[own] * ids))
                        columns = [pa.array([x[k] for x in out], pa.int64() if k < 4 else pa.list_(pa.int64())) for k in range(len(names))]
                        yield pa.RecordBatch.from_arrays(columns, names)

    many = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "base", "bytes").repartition(many).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
