"""Best-fit packing under conflicts.

Texts are cut into pieces of at most the capacity and dealt by hash to
shards of bounded size, each packed by itself.  In a shard the pieces go from
the largest to the smallest.  Open bins are held in order of residual room;
the search starts at the least room that is enough and goes on to the next
bin until one is compatible: a bin's two bitmaps, of the sources and of the
duplicate clusters in it, must not hold the piece's own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, renamed, staged

CAPACITY = 2048
#: Pieces in a shard, on average.
SHARD = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """For each piece its bin and its offset there; a null source or cluster conflicts with none."""
    bits: list[dict] = [{}, {}]
    own = [[0 if v is None else 1 << bits[k].setdefault(v, len(bits[k])) for v in col]
           for k, col in enumerate((sources, clusters))]
    room: list[tuple[int, int]] = []  # (residual, bin), rising
    held: list[list[int]] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s, c = own[0][i], own[1][i]
        at = bisect_left(room, (sizes[i], -1))
        while at < len(room) and (held[room[at][1]][0] & s or held[room[at][1]][1] & c):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= s
        held[b][1] |= c
        out[i] = (b, capacity - left)
        insort(room, (left - sizes[i], b))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
         capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(id, piece, n_words, bin_id, bin_offset): where each piece of each text lies.

    Sizes are words; a text of more than ``capacity`` words is cut into pieces
    of that size and a rest, and an empty or null text is one piece of none.
    No bin holds two pieces of a source, nor of texts with the same words.
    Null sources conflict with none.  Rows with null or repeated ids are packed
    each by itself; an empty table gives an empty result.
    """
    x = renamed(docs, ["source"])
    kind = docs.schema[id_col].dataType.simpleString()
    source = F.lit(None).cast("string") if source_col is None else F.col(f"`{source_col}`").cast("string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            words, names = [], []
            for t in batch.column(2).cast(pa.binary()):
                w = (t.as_py() or b"").lower().split()
                words.append(len(w))
                names.append(xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63) if w else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(names, pa.int64())],
                [id_col, x["source"], "words", "cluster"])

    sized = docs.select(id_col, source.alias(x["source"]), F.col(text_col).cast("string")).mapInArrow(
        measure, f"`{id_col}` {kind}, `{x['source']}` string, words long, cluster long")
    pieces = sized.withColumn("row", F.monotonically_increasing_id()).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
            F.lit(0).cast("long"), F.ceil(F.col("words") / capacity).cast("long") - 1))).alias("piece"))
    pieces = staged(pieces.withColumn("n_words", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity)),
                    "pieces")
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        number = table.column("shard")[0].as_py()
        put = best_fit(*(table.column(c).to_pylist() for c in ("n_words", x["source"], "cluster")), capacity)
        bins, offsets = np.array(put, np.int64).reshape(-1, 2).T
        return pa.table([table.column(id_col), table.column("piece"), table.column("n_words"),
                         pa.array((number << 32) + bins), pa.array(offsets)],
                        names=[id_col, "piece", "n_words", "bin_id", "bin_offset"])

    return dealt.groupBy("shard").applyInArrow(
        solve, f"`{id_col}` {kind}, piece long, n_words long, bin_id long, bin_offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of ``documents`` in bins of 2,048 words."""
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
