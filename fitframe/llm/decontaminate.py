"""Benchmark decontamination: SimHash windows of an item's size, Hamming blocks, exact check.

For every benchmark item a text is read in windows of as many words as the
item has.  A window is a hit if the weighted Jaccard similarity of its word
shingles (repeats counted) to the item's is at least the threshold.  The work
goes in steps that only ever leave out what cannot be a hit, but for the
fingerprint radius, which is a parameter:

* windows with fewer of the item's shingles than the threshold needs are
  passed over: their similarity is bounded by that count;
* the others get a 64-bit fingerprint.  It is cut into four blocks of 16 bits;
  a fingerprint within ``radius`` of an item's has a block within a fourth of
  the radius, so looking up near values block by block finds all such items;
* the shingles themselves decide.

The benchmark is a stated query set.  It is read in blocks of bounded size and
all texts are scanned against each block; no text is shuffled.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
#: Most items and text bytes of a block that is sent to the executors.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text) -> list[bytes]:
    return (text if isinstance(text, bytes) else (text or "").encode()).lower().split()


def _bits(words: list[bytes], width: int) -> np.ndarray:
    """For each shingle, its hash's 64 bits as +1 and -1."""
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42)
                       for i in range(len(words) - width + 1)], np.uint64)
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _print(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=-1).reshape(-1, 8).view(">u8").reshape(-1).astype(np.uint64)


class Index:
    """A block of items: their shingles by width, fingerprints and block values."""

    def __init__(self, items: list[tuple], shingle: int, similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        self.items = [(name, w, min(shingle, len(w))) for name, text in items if (w := _words(text))]
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(x for _, ws, _ in self.items for x in ws))}
        self.weights = [Counter(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) for _, ws, k in self.items]
        self.prints = np.array([_print(_bits(ws, k).sum(axis=0))[0] for _, ws, k in self.items], np.uint64)
        self.by_width: dict[int, tuple] = {}
        for width in sorted({k for _, _, k in self.items}):
            owners: dict[tuple, list[int]] = {}
            for j, (_, _, k) in enumerate(self.items):
                if k == width:
                    for s in self.weights[j]:
                        owners.setdefault(tuple(self.vocab[x] for x in s), []).append(j)
            rows = np.array(list(owners), np.int64)
            hashes = self.mixed(rows.T)
            sort = np.argsort(hashes)
            lists = list(owners.values())
            self.by_width[width] = (hashes[sort], rows[sort], [lists[i] for i in sort])
        self.near = lru_cache(1 << 16)(self._near)

    @staticmethod
    def mixed(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ c.astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(31)
        return out

    def _near(self, block: int, value: int) -> frozenset:
        """The items whose 16 bits of this block are within a fourth of the radius."""
        mine = (self.prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        return frozenset(np.flatnonzero(np.bitwise_count(mine ^ np.uint64(value)) <= self.radius // 4).tolist())

    def hits(self, text) -> list[tuple]:
        """(item number, similarity, distance, first word, words) of the best window of each item found."""
        words = _words(text)
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        out = []
        for width, (hashes, rows, owners) in self.by_width.items():
            if len(words) < width:
                continue
            known = np.concatenate([[0], np.cumsum(ids >= 0)])
            at = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(at):
                continue
            cols = [ids[at + i] for i in range(width)]
            k = np.minimum(np.searchsorted(hashes, mixed := self.mixed(cols)), len(hashes) - 1)
            same = hashes[k] == mixed
            for i in range(width):
                same &= rows[k, i] == cols[i]
            found: dict[int, list[int]] = {}
            for p, s in zip(at[same].tolist(), k[same].tolist(), strict=True):
                for j in owners[s]:
                    found.setdefault(j, []).append(p)
            for j, places in found.items():
                if best := self.best(words, j, width, np.array(places)):
                    out.append((j, *best))
        return out

    def best(self, words: list[bytes], j: int, width: int, places: np.ndarray) -> tuple | None:
        size = min(len(self.items[j][1]), len(words))
        mine, theirs = size - width + 1, sum(self.weights[j].values())
        # similarity s of a and b shingles needs s (a + b) / (1 + s) in common
        need = max(1, int(np.ceil(self.similarity * (mine + theirs) / (1 + self.similarity) - 1e-9)))
        if len(places) < need:
            return None
        low, high = places[need - 1:] - (mine - 1), places[:len(places) - need + 1]
        starts = sorted({p for a, b in zip(low.tolist(), high.tolist(), strict=True)
                         for p in range(max(0, a), min(b, len(words) - size) + 1)})
        best = None
        for a, b in _stretches(starts, size):
            part = words[a:b + size]
            votes = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_bits(part, width), axis=0)])
            here = [p for p in starts if a <= p <= b]
            first = np.array(here) - a
            prints = _print(votes[first + mine] - votes[first])
            for p, fp in zip(here, prints.tolist(), strict=True):
                far = (fp ^ int(self.prints[j])).bit_count()
                if far > self.radius or not any(j in self.near(k, fp >> 16 * k & 0xFFFF) for k in range(4)):
                    continue
                have = Counter(tuple(words[i:i + width]) for i in range(p, p + mine))
                common = sum((have & self.weights[j]).values())
                similarity = common / (mine + theirs - common)
                if similarity >= self.similarity and (best is None or similarity > best[0]):
                    best = (similarity, far, p, size)
        return best


def _stretches(starts: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Rising window starts in stretches of windows that overlap, each of bounded length."""
    a = b = None
    for p in starts:
        if a is None:
            a = b = p
        elif p - b > size or p - a > 4096:
            yield a, b
            a = b = p
        else:
            b = p
    if a is not None:
        yield a, b


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple]]:
    part, size = [], 0
    for row in items.select(item_id, item_text).toLocalIterator():
        part.append((row[0], row[1]))
        size += len(row[1] or "")
        if len(part) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _over_blocks(items: DataFrame, item_id: str, item_text: str, make: Callable, options: dict) -> Iterator:
    """What ``make`` does with each block's index, broadcast once."""
    settings = {"shingle": SHINGLE, "similarity": SIMILARITY, "radius": RADIUS, **options}
    for part in _blocks(items, item_id, item_text):
        yield make(items.sparkSession.sparkContext.broadcast((part, settings, uuid.uuid4().hex)))


_INDEXES: dict[str, Index] = {}


def _index(shared) -> Index:
    """The index of a broadcast block, made once in each Python worker."""
    part, settings, key = shared.value
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(part, **settings)
    return _INDEXES[key]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """(id, item, similarity, distance, first_word, n_words): for each text and item, the best window found.

    Words are split at ASCII white space and A-Z lower-cased.  An item with
    fewer words than a shingle is one shingle; a text shorter than the item is
    one window.  Null or blank texts and items have none; rows with null or
    repeated ids each give their rows; empty tables give an empty result.  Of
    windows equally similar the first is told.  Options: shingle, similarity, radius.
    """
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{item_id}` {kinds[1]}, similarity double, distance long, first_word long, n_words long"

    def make(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                texts = batch.column(1).cast(pa.binary())
                found = [(i, *h) for i, t in enumerate(texts) for h in index.hits(t.as_py())]
                if found:
                    rows, which, *rest = zip(*found)
                    names = pa.array([index.items[j][0] for j in which])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), names,
                         *(pa.array(c, t) for c, t in zip(rest, [pa.float64(), *[pa.int64()] * 3], strict=True))],
                        [id_col, item_id, "similarity", "distance", "first_word", "n_words"])

        return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for found in _over_blocks(items, item_id, item_text, make, options):
        out = out.union(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a window like an item."""
    place, out = docs.columns.index(text_col), docs

    def make(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                clean = [not index.hits(t.as_py()) for t in batch.column(place).cast(pa.binary())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for run in _over_blocks(items, item_id, item_text, make, options):
        out = out.mapInArrow(run, docs.schema)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ``documents`` like an item of ``benchmark``: five-word shingles, similarity 0.8."""
    return contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
