"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first.  Level k holds the k-th chunk
of every id that has one, a bitmap that says which of them go on to the next level,
and a directory with the number of set bits before each block of 512.  The place of
an id's next chunk is the rank of its bit, so any token is read in as many steps as
it has chunks, without decoding its neighbours.

File layout (little endian): magic ``DAC1``, uint32 levels, uint64 documents,
uint64 tokens; doc ids (int64, and a byte each that marks null); starts
(uint64, one more than documents); then for each level: uint64 chunks, the chunk
bytes, the bitmap padded to whole 64 bytes, the directory (uint64).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.store import fresh_path, settle, table
from corpuslens.llm.tokens import encoder

MAGIC = b"DAC1"
BLOCK = 512
#: A task starts a new file beyond so many tokens, which bounds its memory.
FILE_TOKENS = 4_000_000
#: Tokens (of one document at least) and documents read at once.
WINDOW, WINDOW_DOCUMENTS = 1 << 18, 4096
#: Bytes read from a file at once, and how many such blocks are kept.
READ_BLOCK, READ_BLOCKS = 1 << 18, 64


def dac_encode(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """One file's bytes; ``ids`` holds the documents' tokens one after another."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1).astype(np.uint64)
        directory = np.cumsum(ones) - ones
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8), bits, directory.astype(np.uint64)))
        rest = rest[more] >> 8
        if not len(rest):
            break
    starts = np.append(0, np.cumsum(counts)).astype(np.uint64)
    out = [MAGIC, struct.pack("<IQQ", len(levels), len(doc_ids), len(ids))]
    out.append(np.array([d if d is not None else 0 for d in doc_ids], np.int64).tobytes())
    out.append(bytes(d is None for d in doc_ids))
    out.append(starts.tobytes())
    for n, chunks, bits, directory in levels:
        out += [struct.pack("<Q", n), chunks.tobytes(), bits.tobytes(), directory.tobytes()]
    return b"".join(out)


class DacFile:
    """A file's contents, addressable token by token through ranged reads.

    ``read(size, at)`` gives bytes of the file; only the head is read at once."""

    def __init__(self, read):
        self.read = read
        head = read(24, 0)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        n_levels, self.documents, self.tokens = struct.unpack_from("<IQQ", head, 4)
        at = 24 + 17 * self.documents + 8
        self.levels = []  # where chunks, bitmap and directory of each level begin
        for _ in range(n_levels):
            n = struct.unpack("<Q", read(8, at))[0]
            blocks = -(-n // BLOCK)
            self.levels.append((at + 8, at + 8 + n, at + 8 + n + blocks * BLOCK // 8, n))
            at += 8 + n + blocks * (BLOCK // 8 + 8)

    @classmethod
    def of(cls, data: bytes) -> DacFile:
        return cls(lambda size, at: data[at : at + size])

    def _array(self, kind, count: int, at: int) -> np.ndarray:
        return np.frombuffer(self.read(count * np.dtype(kind).itemsize, at), kind)

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """Ids of some documents."""
        ids = self._array(np.int64, last - first, 24 + 8 * first)
        null = self._array(np.uint8, last - first, 24 + 8 * self.documents + first)
        return [None if z else int(i) for i, z in zip(ids, null, strict=True)]

    def starts(self, first: int, last: int) -> np.ndarray:
        """First tokens of some documents, and where the last of them ends."""
        return self._array(np.uint64, last - first + 1, 24 + 9 * self.documents + 8 * first).astype(np.int64)

    def rank(self, level: int, i: int) -> int:
        """Set bits before place i of a level: an entry of its directory and part of one block."""
        _, bits, directory, n = self.levels[level]
        block, inside = divmod(i, BLOCK)
        if i == n and not inside:  # the end of a full last block has no entry
            return self.levels[level + 1][3] if level + 1 < len(self.levels) else 0
        known = struct.unpack("<Q", self.read(8, directory + 8 * block))[0]
        head = int.from_bytes(self.read((inside + 7) // 8, bits + block * BLOCK // 8), "little")
        return known + (head & ((1 << inside) - 1)).bit_count()

    def token(self, i: int) -> int:
        """Token i alone: in each level one chunk, its bit, and a rank."""
        value = 0
        for level, (chunks, bits, _, _) in enumerate(self.levels):
            value |= self.read(1, chunks + i)[0] << (8 * level)
            if not self.read(1, bits + (i >> 3))[0] >> (i & 7) & 1:
                break
            i = self.rank(level, i)
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b: in each level one run of chunks and bits, found by rank."""
        out = np.zeros(b - a, np.uint32)
        at = np.arange(b - a)
        for level, (chunks, bits, _, _) in enumerate(self.levels):
            if a == b:
                break
            out[at] |= self._array(np.uint8, b - a, chunks + a).astype(np.uint32) << np.uint32(8 * level)
            low = a & ~7
            more = np.unpackbits(self._array(np.uint8, (b - low + 7) // 8, bits + low // 8), bitorder="little")[a - low : b - low].view(bool)
            at = at[more]
            a = self.rank(level, a)
            b = a + len(at)
        return out


def buffered(read, size: int, block: int = READ_BLOCK, held: int = READ_BLOCKS):
    """``read`` (count, offset) by way of whole blocks of a file, of which the last used are kept.

    Small reads near each other, as of bits and directory entries, become few large ones, which a remote store needs."""

    @lru_cache(held)
    def blocked(i: int) -> bytes:
        return bytes(read(min(block, size - i * block), i * block))

    def small(count: int, offset: int) -> bytes:
        if count > block:
            return bytes(read(count, offset))
        if not count or offset >= size:
            return b""
        first, last = offset // block, (min(offset + count, size) - 1) // block
        raw = blocked(first) if first == last else blocked(first) + blocked(last)
        return raw[offset - first * block :][:count]

    return small


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order below ``folder``.

    Returns the settled manifest: part, file_no, path, tokens, base (tokens in all files
    before).  A repeated task writes files under other names; only those in the
    manifest count.  ``folder`` is any URI that pyarrow's file systems open.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, held, names, counts, size, number = TaskContext.get().partitionId(), [], [], [], 0, 0

        def flush():
            nonlocal held, names, counts, size, number
            name = f"part-{part:05d}-{number:04d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(dac_encode(np.concatenate(held), names, np.concatenate(counts)))
            row = {"part": [part], "file_no": [number], "path": [name], "tokens": [size]}
            held, names, counts, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("path", pa.string()), ("tokens", pa.int64())]))

        for batch in batches:
            step = 256  # rows encoded at once
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                ids, n = enc.encode(rows.column(1))
                ends = np.cumsum(n + 1)
                flat = np.full(int(ends[-1]), end_id, np.uint32)
                keep = np.ones(len(flat), bool)
                keep[ends - 1] = False
                flat[keep] = ids
                held.append(flat)
                counts.append(n + 1)
                names += rows.column(0).to_pylist()
                size += len(flat)
                if size >= file_tokens:
                    yield flush()
        if names:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    manifest = settle(ordered.mapInArrow(write, "part int, file_no int, path string, tokens long"), "token-manifest")
    # tokens before a part (one row a part), and before a file within its part
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    per_part = manifest.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("ahead", F.coalesce(F.sum("all").over(before("part")), F.lit(0)))
    inner = manifest.withColumn("inner", F.coalesce(F.sum("tokens").over(before("part", "file_no")), F.lit(0)))
    return inner.join(per_part, "part").select("part", "file_no", "path", "tokens", (F.col("ahead") + F.col("inner")).alias("base"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 over all their ids, probe_id, probe_agrees.

    Documents are read through their starts, some WINDOW tokens at a time, so memory does
    not depend on the size of a file.  probe_id is the token in a document's middle, read
    alone through the rank directories; probe_agrees tells whether it is the one read with
    the document."""

    def read(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for name, base in zip(pdf["path"], pdf["base"], strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    dac = DacFile(buffered(f.read_at, f.size()))
                    for first in range(0, dac.documents, WINDOW_DOCUMENTS):
                        last = min(first + WINDOW_DOCUMENTS, dac.documents)
                        s = dac.starts(first, last)
                        crc, probe, agrees = [], [], []
                        i = 0
                        while i < last - first:
                            j = max(i + 1, int(np.searchsorted(s, s[i] + WINDOW, "right")) - 1)
                            ids = dac.range(int(s[i]), int(s[j]))
                            view = memoryview(ids.view(np.uint8))
                            for a, b in zip((s[i:j] - s[i]).tolist(), (s[i + 1 : j + 1] - s[i]).tolist(), strict=True):
                                middle = (a + b) // 2
                                crc.append(zlib.crc32(view[4 * a : 4 * b]))
                                probe.append(dac.token(int(s[i]) + middle) if b > a else None)
                                agrees.append(probe[-1] == int(ids[middle]) if b > a else None)
                            i = j
                        yield pd.DataFrame(
                            {
                                "doc_id": pd.array(dac.doc_ids(first, last), "Int64"), "start": s[:-1] + base, "n_tokens": np.diff(s), "ids_crc32": crc,
                                "probe_id": pd.array(probe, "Int64"), "probe_agrees": pd.array(agrees, "boolean"),
                            }
                        )

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "base").repartition(parts, "path").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, probe_id long, probe_agrees boolean"
    )


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the files, read them back, and describe each document.

    A null text counts as empty and is its end id alone; documents with equal
    doc_id follow one another in the order of their text's hash, a null doc_id comes
    first; an empty table writes no files.  Other columns, whatever their names, are ignored.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder), folder)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` through the file format and back."""
    import public_tokenizers

    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
