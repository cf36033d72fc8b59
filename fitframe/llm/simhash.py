"""SimHash near-duplicates, blocked by Golay-code fuzzy keys.

A text's 64-bit fingerprint is the bitwise majority of its shingles' hashes.
To find fingerprints at most two bits apart without comparing all:

* the 64 bits are cut into segments of 22, 21 and 21 bits.  Two errors cannot
  touch all three, so one segment agrees exactly;
* the segment after it has at most two errors.  Read as a word of the (23, 12)
  Golay code it is decoded to the codewords near it: one if it has at most two
  errors, else the six at distance three and four.  Words at most two bits
  apart share one of these codewords;
* the exact segment and the codeword's 12-bit index form a key, so a
  fingerprint has 3 to 18 keys of 34 bits, and every link shares one.

Fingerprints with a common key are compared; links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import read, renamed, staged

#: Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
SEGMENTS = (22, 21, 21)
#: Keys shared by more fingerprints than this are compared by another exact way.
HOT = 128


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the three bytes of a word; and by remainder up to six
    patterns that turn a word into a codeword near it (-1: no more)."""
    parts = np.array([[_remainder(b << 8 * k) if b << 8 * k < 1 << 23 else 0 for b in range(256)] for k in range(3)])
    near = np.full((2048, 6), -1, np.int64)
    bits = [1 << i for i in range(23)]
    light = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])]
    for e in light:
        near[_remainder(e), 0] = e
    fours: dict[int, list[int]] = {}
    for i, a in enumerate(bits):
        for j, b in enumerate(bits[:i]):
            for k, c in enumerate(bits[:j]):
                near[_remainder(a | b | c), 0] = a | b | c
                for d in bits[:k]:
                    fours.setdefault(_remainder(a | b | c | d), []).append(a | b | c | d)
    for r, found in fours.items():
        if near[r, 0].item().bit_count() == 3:
            near[r, 1:1 + len(found)] = found
    return parts, near


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For uint64 fingerprints: (row numbers, int64 keys), each key once a row."""
    parts, near = golay_tables()
    shifts = np.cumsum((0, *SEGMENTS[:-1])).astype(np.uint64)
    seg = [((prints >> s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(shifts, SEGMENTS, strict=True)]
    rows, keys = [], []
    for i, exact in enumerate(seg):
        word = seg[(i + 1) % 3]
        rest = parts[0][word & 255] ^ parts[1][word >> 8 & 255] ^ parts[2][word >> 16]
        flips = near[rest]
        r, c = np.nonzero(flips >= 0)
        index = (word[r] ^ flips[r, c]) >> 11
        rows.append(r)
        keys.append(i << 34 | exact[r] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes, shingle: int) -> int:
    """The majority fingerprint of a text's lower-cased word shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[shingle - 1:] if len(words) > shingle else ends[-1:]
    first = np.concatenate([[0], ends + 1])[:len(last)]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(whole[a:b], 42) for a, b in zip(first.tolist(), last.tolist(), strict=True)),
                         np.uint64, len(last))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id_col, fingerprint long) of every row; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, fingerprint long")


def _keyed(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows, keys = golay_keys(have)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(have[rows].view(np.int64))], ["key", "a"])

    return prints.mapInArrow(run, "key long, a long")


def _bucket_links(buckets: DataFrame, max_bits: int) -> DataFrame:
    """Links of each small bucket: every member with the least of those it hangs together with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                have = np.sort(np.array(row.as_py(), np.int64))
                near = np.bitwise_count((have[:, None] ^ have[None, :]).view(np.uint64)) <= max_bits
                label = np.arange(len(have))
                while True:
                    new = np.where(near, label[None, :], len(have)).min(axis=1)
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                moved = np.nonzero(label != np.arange(len(have)))[0]
                a += have[moved].tolist()
                b += have[label[moved]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """Links (a, b) that join up all distinct fingerprints (column fingerprint) at most ``max_bits`` apart.

    Keys of two fingerprints are compared by their least and greatest; keys of
    up to ``hot`` in one task.  For those of more, each fingerprint is sent to
    the 65 values at most one bit from it.  Two fingerprints meet at such a
    value exactly if they are at most two bits apart, and no value has more
    than 65 of them, so nothing is dropped and no group is large.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("Golay keys of three segments cover up to two bits")
    keyed = _keyed(prints)
    shared = staged(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("x"), F.max("a").alias("y"))
                    .where("n > 1"), "keys")
    twos = shared.where((F.col("n") == 2) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits)) \
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    more = staged(keyed.join(shared.where("n > 2").select("key", "n"), "key"), "members")
    few = more.where(F.col("n") <= hot).groupBy("key").agg(F.collect_list("a").alias("members")).select("members")
    steps = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))] if max_bits > 0 else [0]
    near = more.where(F.col("n") > hot).select("a").distinct().select(
        "a", F.explode(F.transform(F.array(*map(F.lit, steps)), lambda v: F.col("a").bitwiseXOR(v))).alias("mid"))
    met = near.groupBy("mid").agg(F.collect_list("a").alias("all")).where(F.size("all") > 1)
    if max_bits == 1:  # members may be two bits apart, but a value that is a fingerprint is one bit from each
        met = met.where(F.array_contains("all", F.col("mid"))).select(F.explode("all").alias("a"), F.col("mid").alias("b"))
    else:
        met = met.select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
    return twos.union(_bucket_links(few, max_bits)).union(met)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the least id reachable over fingerprints at most
    ``max_bits`` apart, the row's own included.  Null and blank texts have
    fingerprint zero and are linked like any other.  A row with a null id is
    fingerprinted and links others; its component is the least non-null id
    (null if there is none).  Repeated rows each get their row; an empty table
    gives an empty result; other columns play no part.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = staged(prints.groupBy("fingerprint").agg(F.min(id_col).alias("first")), "classes")
    roots = staged(components(links(classes.select("fingerprint"), max_bits)), "roots")
    linked = staged(classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint"), "linked")
    ids = staged(linked.groupBy("root").agg(F.min("first").alias("least")), "ids")
    groups = staged(linked.join(ids, "root").select("fingerprint", "least"), "groups")
    known = staged(classes.join(groups, "fingerprint", "left").select(
        "fingerprint", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")),
        "known")
    return prints.join(known, "fingerprint").select(id_col, "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: that of the least id.

    Of rows that share the id of a kept one in the same group, the one with
    the least hash stays.  A group without any id keeps the row of the least hash.
    """
    x = renamed(docs, ["row", "own"])
    row, own = x["row"], x["own"]
    # a row's name: its id, and the hash of all its columns, which tells apart rows with one id
    every = F.xxhash64(*[F.col(f"`{c}`") if "map<" not in t else F.lit(0) for c, t in docs.dtypes])
    whole = docs.select(F.struct("*").alias(own), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), every).alias(row))
    names = whole.select(row, F.col(f"{own}.text").alias("text"))
    groups = staged(near_duplicates(names, id_col=row, **options).select("component_id").distinct()
                    .withColumnRenamed("component_id", row), "kept")
    kept = whole.join(groups, row, "left_semi")
    # rows alike in every column have one name: they are the only ones left to merge
    many = staged(names.groupBy(row).count().where("count > 1").select(row), "alike")
    single = kept.join(many, row, "left_anti").select(f"{own}.*")
    return single.union(kept.join(many, row, "left_semi").select(f"{own}.*").distinct())


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all whole texts of ``documents``: three-word shingles, two bits."""
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
