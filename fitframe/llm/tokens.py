"""Token files: independent zstandard frames, a trailing seek table, checksums.

A file holds the token ids of many texts as little-endian 32-bit integers:

* data frames, each the ids of some whole texts, each a zstandard frame of its own;
* one more frame with the texts' ids and token counts;
* a skippable frame with the seek table in zstandard's public seekable layout:
  for every frame its compressed size, its plain size and the low half of the
  XXH64 of its content, then the number of frames, a flag byte and a magic number.

Any zstandard tool can expand the file; a reader that wants some texts fetches
the table, the index frame and the frames of these texts, and checks each.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, shared_path, staged, tasks, text_or_empty

#: Fixed values of the seekable layout.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: A frame is closed when it has so many ids.
FRAME_IDS = 1 << 16
END_ID = 1
#: Encoded words kept by a worker, and their bytes, before it starts anew.
CACHE_WORDS, CACHE_BYTES = 1 << 20, 1 << 25


def _low(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenWriter:
    """Writes (id or None, ids as bytes) in the order given."""

    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=3)
        self.table, self.ids, self.sizes, self.part, self.held = [], [], [], [], 0

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), _low(data)))

    def add(self, name: int | None, data: bytes) -> None:
        self.ids.append(name)
        self.sizes.append(len(data) // 4)
        self.part.append(data)
        self.held += len(data) // 4
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.part:
            self._frame(b"".join(self.part))
            self.part, self.held = [], 0

    def close(self) -> None:
        self.flush()
        null = np.array([v is None for v in self.ids], np.uint8)
        ids = np.array([v or 0 for v in self.ids], "<i8")
        self._frame(struct.pack("<Q", len(ids)) + ids.tobytes() + np.array(self.sizes, "<u8").tobytes() + null.tobytes())
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + len(footer)) + rows + footer)


class TokenReader:
    """Reads texts back from a file that can be sought in."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a token file")
        source.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = self.frame(frames - 1)
        n = struct.unpack_from("<Q", index)[0]
        ids = np.frombuffer(index, "<i8", n, 8)
        self.sizes = np.frombuffer(index, "<u8", n, 8 + 8 * n).astype(np.int64)
        null = np.frombuffer(index, np.uint8, n, 8 + 16 * n)
        self.ids = [None if z else int(v) for v, z in zip(ids, null, strict=True)]
        self.ends = np.cumsum(self.sizes)
        self.frame_ends = np.cumsum(self.table[:-1, 1].astype(np.int64) // 4)
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        """One frame's content, checked against the table."""
        import zstandard

        self.source.seek(int(self.starts[k]))
        data = zstandard.ZstdDecompressor().decompress(
            self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(data) != self.table[k, 1] or _low(data) != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def text(self, i: int) -> bytes:
        """The ids of the i-th text; only its own frame is expanded."""
        if not self.sizes[i]:
            return b""
        k = int(np.searchsorted(self.frame_ends, self.ends[i]))
        if self.held[0] != k:
            self.held = (k, self.frame(k))
        first = int(self.ends[i] - self.sizes[i] - (self.frame_ends[k - 1] if k else 0))
        return self.held[1][4 * first:4 * (first + int(self.sizes[i]))]


class _Numbers(dict):
    """Numbers words as they come, and lists those numbered since the list was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """A tokenizer file's encoding of whole texts, worked out once for each word.

    The tokenizers meant here split at white space and never look across it, so
    a text's ids are those of its words one after another.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        """Start without words: their numbers, and where the ids of each end among the ids of all."""
        self.numbers, self.bytes = _Numbers(), 0
        self.ids, self.ends = np.empty(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[bytes], first: int) -> None:
        """Ids of new words, numbered from ``first``: all are encoded as the lines of one text and
        told apart by their places in it."""
        whole = b"\n".join(words)
        text = whole.decode()
        sizes = map(len, words if len(text) == len(whole) else text.split("\n"))
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(words)) + 1)
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        places = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids))[::2]
        base = int(self.ends[first])
        if base + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(base + len(ids), "<u4")])
        if first + len(words) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(first + len(words), np.int64)])
        self.ids[base:base + len(ids)] = ids
        self.ends[first + 1:first + 1 + len(words)] = base + np.searchsorted(places, ends)
        self.bytes += len(whole)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.numbers) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self._forget()
        words = [t.split() for t in texts]
        upto = np.cumsum([0, *map(len, words)])
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(upto[-1]))
        new, self.numbers.new = self.numbers.new, []
        known = len(self.numbers) - len(new)
        for i in range(0, len(new), 1 << 14):
            self._learn(new[i:i + (1 << 14)], known + i)
        starts = self.ends[at]
        sizes = self.ends[at + 1] - starts
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], sizes)]
        edges = cuts[upto].tolist()
        return [flat[a:b].tobytes() for a, b in zip(edges, edges[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder of a tokenizer file: later tasks find the words of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open(path: str):
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts in ascending order of id; (shard, path, n_docs, n_tokens) of each file.

    Null texts are empty: only the end id.  Null ids come first; rows with one
    id are in order of their texts' hash; an empty table gives no file.  Each
    task writes a file of a new name and tells it only when it is whole, so a
    task that runs again leaves at most a file that nothing names.
    """
    end = np.array([end_id], "<u4").tobytes()
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    dealt = named.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files = writer = out = coder = None
        shard = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files, base = _open(folder)
                files.create_dir(base, recursive=True)
                name = f"part-{shard:05d}-{uuid.uuid4().hex}.tokens"
                out = files.open_output_stream(f"{base}/{name}")
                writer, coder = TokenWriter(out), encoder(tokenizer if "/" in tokenizer else _public(tokenizer))
            names, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for at in range(0, len(names), 256):
                for n, data in zip(names[at:at + 256], coder.encode(texts[at:at + 256].to_pylist()), strict=True):
                    writer.add(n, data + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.ids)], pa.int64()),
                 pa.array([sum(writer.sizes)], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    return staged(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): all texts of the files that ``write_tokens`` told of."""
    spark = shards.sparkSession
    base, rows = 0, []
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):  # one row a file
        rows.append((r["path"], base))
        base += r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, place = _open(path)
                with files.open_input_file(place) as source:
                    reader = TokenReader(source)
                    for at in range(0, len(reader.ids), 256):
                        upto = min(at + 256, len(reader.ids))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.ids[at:upto], pa.int64()),
                             pa.array(start + reader.ends[at:upto] - reader.sizes[at:upto]),
                             pa.array(reader.sizes[at:upto]), pa.array([reader.text(i) for i in range(at, upto)], pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"])

    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token files of ``documents``, written and read back."""
    found = read_tokens(write_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "tokens")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
