"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

The vocabulary is counted per text and added up.  Its words are split by length
and hash into shards of bounded size, each with a blocked Bloom filter: one
64-bit block a word, a few bits in it.  Shards are broadcast in rounds of a
bounded number of bytes.  In every round each word probes what it generates:

* itself less one code point, against the shards of the next smaller length;
* itself with one code point replaced by a greater one, against its own length.

(An insertion is a deletion seen from the longer word; a smaller code point is
a greater one seen from the other side.)  The hash of a word is a XOR of
numbers by place and code point, so that of an edit takes a few operations.
Only edits that a filter has are spelt out and shuffled to an exact join with
the vocabulary, which drops what the filters let through wrongly.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, staged, text_or_empty

#: Words to a shard, filter bits to a word, bits set in a word's block, and bytes of filters sent at once.
SHARD_WORDS, WORD_BITS, BLOCK_BITS, ROUND_BYTES = 1 << 20, 16, 5, 32 << 20
#: Distinct words a task counts before it passes the counts on; edits worked out at once.
HELD_WORDS, HELD_EDITS = 1 << 18, 1 << 20
#: The contract's letters; only A-Z are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint8)
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def misspelt(run: str, doc_id: object, every: int) -> str:
    """The run, less one code point if ``every`` divides the checksum of id and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def text_words(text: str, doc_id: object, least: int, every: int) -> Counter:
    """Counts of a text's words of at least ``least`` code points."""
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.translate(_LOWER))).items():
        if len(run) >= least and len(word := misspelt(run, doc_id, every)) >= least:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least: int, fewest: int, every: int) -> DataFrame:
    """(word, n): the words of all texts with at least ``fewest`` occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                               pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.update(text_words(t.as_py(), i, least, every))
                if len(held) >= HELD_WORDS:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    found = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    return found.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= fewest)


def _matrix(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points: every letter is below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def _numbers(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The number of a code point at a place."""
    return _mix((places.astype(np.uint64) << _U(8)) + letters.astype(np.uint64) + _U(0x9E3779B97F4A7C15))


def _hashes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for p in range(rows.shape[1]):
        out ^= _numbers(np.array(p), rows[:, p])
    return out


def _places(hashes: np.ndarray, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits) of hashes in a filter of so many blocks."""
    h = _mix(hashes)
    bits = np.zeros(len(h), np.uint64)
    for i in range(BLOCK_BITS):
        bits |= _U(1) << (h >> _U(6 * i) & _U(63))
    return ((h >> _U(32)) * np.asarray(blocks, np.uint64) >> _U(32)).astype(np.int64), bits


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((_mix(hashes ^ _U(0xD1B54A32D192ED03)) >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _filters(words: DataFrame, shards: dict[int, int], bits: int) -> DataFrame:
    """(length, shard, filter) of all words: each shard's filter is made in one task from its hashes."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[str]] = {}
            for w in batch.column(0).to_pylist():
                by.setdefault(len(w), []).append(w)
            for length, some in by.items():
                h = _hashes(_matrix(some, length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), length)), pa.array(_shard(h, shards[length])), pa.array(h.view(np.int64))],
                    ["length", "shard", "hash"])

    def built(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, shard = (k.as_py() for k in key)
        hashes = np.unique(np.concatenate([b.column(2).to_numpy().view(np.uint64) for b in batches]))
        block, mask = _places(hashes, max(1, len(hashes) * bits // 64))
        filter_ = np.zeros(max(1, len(hashes) * bits // 64), np.uint64)
        np.bitwise_or.at(filter_, block, mask)
        yield pa.RecordBatch.from_arrays([pa.array([length], pa.int64()), pa.array([shard], pa.int64()),
                                          pa.array([filter_.tobytes()], pa.binary())], ["length", "shard", "filter"])

    return words.select("word").mapInArrow(hashed, "length long, shard long, hash long").groupBy(
        "length", "shard").applyInArrow(built, "length long, shard long, filter binary")


def _probe(hashes: np.ndarray, length: int, filters: dict, shards: dict[int, int]) -> np.ndarray:
    """Which hashes the filters of a length at hand may have."""
    out = np.zeros(len(hashes), bool)
    shard = _shard(hashes, shards[length])
    for k in range(shards[length]):
        have = filters.get((length, k))
        if have is not None:
            mine = np.flatnonzero(shard == k) if shards[length] > 1 else np.arange(len(hashes))
            block, bits = _places(hashes[mine], len(have))
            out[mine] = have[block] & bits == bits
    return out


def edits(words: list[str], length: int, filters: dict, shards: dict[int, int]) -> Iterator[tuple[list[str], list[str]]]:
    """(words, edits) of words of one length: the generated edits that the filters may have."""
    rows = _matrix(words, length)
    whole = _hashes(rows)
    if any(k[0] == length for k in filters):
        step = max(1, HELD_EDITS // len(LETTERS))
        for p in range(length):
            for at in range(0, len(rows), step):
                old = rows[at:at + step, p]
                base = whole[at:at + step] ^ _numbers(np.array(p), old)
                new = base[:, None] ^ _numbers(np.array(p), LETTERS)[None, :]
                r, c = np.nonzero(LETTERS[None, :] > old[:, None])
                hit = _probe(new[r, c], length, filters, shards)
                r, c = r[hit] + at, c[hit]
                yield ([words[i] for i in r],
                       [words[i][:p] + chr(LETTERS[j]) + words[i][p + 1:] for i, j in zip(r.tolist(), c.tolist(), strict=True)])
    if any(k[0] == length - 1 for k in filters):
        left = np.zeros(len(rows), np.uint64)  # of the code points before p
        right = np.zeros(len(rows), np.uint64)  # of those after p, each a place further left
        for p in range(1, length):
            right ^= _numbers(np.array(p - 1), rows[:, p])
        for p in range(length):
            # deleting any of several equal neighbours gives one edit
            fresh = np.flatnonzero(rows[:, p] != rows[:, p - 1]) if p else np.arange(len(rows))
            r = fresh[_probe((left ^ right)[fresh], length - 1, filters, shards)]
            yield [words[i] for i in r], [words[i][:p] + words[i][p + 1:] for i in r]
            left ^= _numbers(np.array(p), rows[:, p])
            if p + 1 < length:
                right ^= _numbers(np.array(p), rows[:, p + 1])


def _rounds(sizes: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int]]]:
    """(length, shard, words) in rounds of bounded size, shards of a length together."""
    out: list[list[tuple[int, int]]] = []
    held = most
    for length, shard, size in sorted(sizes):
        if held + size > most:
            out.append([])
            held = 0
        out[-1].append((length, shard))
        held += size
    return out


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES,
               bits: int = WORD_BITS) -> DataFrame:
    """(a, b): all pairs of distinct ``word`` values one inserted, deleted or replaced code point apart, each once.

    Words are of the letters a-z and U+00C0 to U+00FF.  A broadcast holds at
    most ``round_bytes`` of filters or one shard, whatever the vocabulary.
    """
    spark = words.sparkSession
    # one row a word length: the shards are made small from the counts
    counts = {r["length"]: r["n"] for r in words.where(F.length("word") > 0).groupBy(
        F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    shards = {length: -(-n // shard_words) for length, n in counts.items()}
    made = staged(_filters(words.where(F.length("word") > 0), shards, bits), "filters")
    sizes = [tuple(r) for r in made.select("length", "shard", F.length("filter")).collect()]
    found = []
    for part in _rounds(sizes, round_bytes):
        first, last = part[0], part[-1]
        length, shard = F.col("length"), F.col("shard")
        rows = made.where((length > first[0]) | (length == first[0]) & (shard >= first[1])).where(
            (length < last[0]) | (length == last[0]) & (shard <= last[1])).collect()  # at most round_bytes
        sent = spark.sparkContext.broadcast({(r["length"], r["shard"]): bytes(r["filter"]) for r in rows})
        del rows

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            filters = {k: np.frombuffer(v, np.uint64) for k, v in sent.value.items()}
            for batch in batches:
                by: dict[int, list[str]] = {}
                for w in batch.column(0).to_pylist():
                    by.setdefault(len(w), []).append(w)
                for length, some in by.items():
                    for a, b in edits(some, length, filters, shards):
                        if a:
                            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

        some = words.where(F.length("word").between(first[0], last[0] + 1)).select("word")
        positives = some.mapInArrow(run, "a string, b string")
        found.append(staged(positives.join(words.select(F.col("word").alias("b")), "b", "left_semi").select("a", "b"), "near"))
        sent.destroy()
    if not found:
        return spark.createDataFrame([], "a string, b string")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word reached over forms, by doubling the way each round."""
    ways = staged(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = staged(ways.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        if far.where("moved").isEmpty():
            return far.select("word", "root")
        ways = far.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, fewest: int = 2,
                    ratio: int = 10, every: int = 31, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts' vocabulary.

    Words are maximal runs of letters, A-Z lower-cased, of at least ``least``
    code points and ``fewest`` occurrences; a run whose checksum with the row's
    id divides by ``every`` loses one code point first.  ``form`` is the near
    word (one code point inserted, deleted or replaced) of largest n, the
    smallest in code-point order on ties, if its n is at least ``ratio`` times
    the word's; ``root`` follows forms to the last.  Without a form, form and
    form_n are null and root is the word.  Null and blank texts have no words;
    a null id counts as empty text in the checksum; repeated rows count again.
    An empty table gives an empty result; other columns play no part.
    """
    words = staged(vocabulary(docs, id_col, text_col, least, fewest, every), "words")
    near = near_words(words, **options)
    both = near.union(near.select("b", "a")).toDF("word", "other")
    known = both.join(words.withColumnRenamed("word", "other").withColumnRenamed("n", "other_n"), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"),
                                     F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    formed = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")).select(
        "word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all whole texts of ``documents``: seven code points, twice, ten times as many."""
    return spelling_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
