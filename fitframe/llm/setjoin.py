"""Jaccard join of word n-gram sets by a partition of the token universe.

Two sets of a and b tokens with similarity p % differ in at most
H = (100 - p)(a + b) // (100 + p) tokens.  Sets are joined within size bands;
one that may have partners in the next band takes part there too.  In a band

* tokens are dealt by their hash to segments, more than H of them, so a similar
  pair agrees in one segment at least.  A set indexes the subset of segments
  that its own size asks for, and a few more as slack;
* every bucket of equal segments ties its members to the least one.  Ties that
  hold make components, and only buckets with several components stay open:
  pairs of different components are compared there, in small buckets at once;
* a segment in a large open bucket is passed over (allocation -1).  A set with
  more such segments than slack makes up for each of them with one more unit:
  the one-deletion neighbourhood of another segment (allocation 1), or the large
  bucket after all (0), whichever costs least by counted index entries;
* all candidates pass a proven bound, the distance of parity bitmaps, and are
  then verified exactly on the shingles of their texts.

Sets that are alike are one class from the start, so copies travel once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import read, staged, text_or_empty

#: Open buckets of more sets than this are passed over by the allocation.
HOT = 64
#: Each size band ends at this many times its start; one slack segment comes with so many needed ones.
BAND_GROWTH, SLACK_EVERY = 1.5, 16
#: Sets of a large bucket that are compared in one task at a time.
BLOCK = 256
#: Blocks with more candidate pairs a set give a forest first; one key in so many is compared before the others.
DENSE, FIRST_KEYS = 1, 16
_U = np.uint64
#: A factor for each place of a word in a shingle: the powers of an odd number.
_PLACE = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def shingles(text: bytes, width: int) -> list[bytes]:
    """The distinct shingles of a text's lower-cased words; fewer words than ``width`` are one shingle."""
    words = text.lower().split()
    if not words:
        return []
    return list({b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))})


def tokens(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, in rising order."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh64_intdigest
    h = np.fromiter(map(one, words), np.uint64, len(words))
    last = max(1, len(words) - width + 1)
    out = np.full(last, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(min(width, len(words))):
        out += h[i:i + last] * _U(pow(_PLACE, i + 1, 1 << 64))
    return np.unique(_mix(out))


def bitmap(have: np.ndarray) -> bytes:
    """A parity bitmap with at least a bit a token: each token flips the bit its hash names.

    Bitmaps travel with the rows of every open bucket.  More bits would rule out
    little more: at 85 %, one bit a token tells apart what is below 82 %.
    """
    size = max(64, 1 << max(0, len(have) - 1).bit_length())
    bits = np.bincount((_mix(have) & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _folded(bits: bytes, size: int) -> int:
    """A bitmap as a number, folded to ``size`` bytes."""
    have, wide = int.from_bytes(bits), len(bits)
    while wide > size:
        wide //= 2
        have = have >> 8 * wide ^ have & (1 << 8 * wide) - 1
    return have


def _may_be_near(na: int, a: bytes, nb: int, b: bytes, percent: int) -> bool:
    """False only for sets that differ in more tokens than the similarity allows."""
    most = (100 - percent) * (na + nb) // (100 + percent)
    if abs(na - nb) > most:
        return False
    size = min(len(a), len(b))
    return (_folded(a, size) ^ _folded(b, size)).bit_count() <= most


class Bands:
    """Size bands and the numbers of segments in them, from the similarity alone."""

    def __init__(self, percent: int, slack_every: int = SLACK_EVERY):
        self.percent, self.slack_every = percent, slack_every
        self.low, self.high = [], []
        lo = 1
        while lo < 1 << 40:
            self.low.append(lo)
            self.high.append(int(lo * BAND_GROWTH))
            lo = self.high[-1] + 1
        self.segments = [self._with_slack(self._most(2 * hi)) for hi in self.high]

    def _most(self, both: int) -> int:
        return (100 - self.percent) * both // (100 + self.percent)

    def _with_slack(self, most: int) -> int:
        return most + 2 + most // self.slack_every if most else 0

    def parts(self, n: int) -> list[tuple[int, int]]:
        """(band, indexed segments) of a set of ``n`` tokens, for its own band and those with greater partners."""
        out = []
        for band in range(int(np.searchsorted(self.low, n, "right")) - 1, len(self.low)):
            if self.low[band] * self.percent > 100 * n:
                break
            take = self._with_slack(self._most(n + min(self.high[band], 100 * n // self.percent)))
            if take:
                out.append((band, take))
        return out

    def slack(self, n: Column, band: Column) -> Column:
        """The slack segments of a set, as a column."""
        high = F.element_at(F.array(*[F.lit(h) for h in self.high]), band + 1)
        both = n + F.least(high, F.floor(100 * n / self.percent))
        most = F.floor((100 - self.percent) * both / (100 + self.percent))
        return 1 + F.floor(most / self.slack_every)


def _segments(have: np.ndarray, bands: Bands, band: int, take: int):
    """The first ``take`` segments of a band: (borders in the tokens, token weights, sums of weights, names)."""
    segment = ((have >> _U(32)) * _U(bands.segments[band])) >> _U(32)  # rises with the tokens
    at = np.searchsorted(segment, np.arange(take + 1, dtype=np.uint64))
    weights = _mix(have ^ _U(0xD1B54A32D192ED03))
    sums = np.zeros(len(have) + 1, np.uint64)
    np.cumsum(weights, out=sums[1:])
    names = _mix((np.arange(take, dtype=np.uint64) << _U(8)) + _U(band + 1))
    return at, weights, sums[at[1:]] - sums[at[:-1]], names


def _keys(have: np.ndarray, bands: Bands, band: int, take: int) -> np.ndarray:
    """A key for each indexed segment: equal for equal segments of one band."""
    _, _, sums, names = _segments(have, bands, band, take)
    return _mix(sums ^ names).view(np.int64)


def _deletions(have: np.ndarray, bands: Bands, band: int, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(segments, keys): the keys of all indexed segments less one token."""
    at, weights, sums, names = _segments(have, bands, band, take)
    segment = np.repeat(np.arange(take), np.diff(at))
    return segment, _mix((sums[segment] - weights[at[0]:at[-1]]) ^ names[segment]).view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, w1, w2, n, h1, h2, bits): every row's set size, the hash of its set and its bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, bits = [], [], [], []
            for t in batch.column(3).cast(pa.binary()):
                have = tokens(t.as_py(), width)
                n.append(len(have))
                h1.append(int(_mix(have + _U(11)).sum(dtype=np.uint64)))
                h2.append(int(_mix(have ^ _U(0xA24BAED4963EE407)).sum(dtype=np.uint64)))
                bits.append(bitmap(have))
            new = [pa.array(n, pa.int64()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)),
                   pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *new],
                                             ["id", "w1", "w2", "n", "h1", "h2", "bits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, w1 long, w2 long, n long, h1 long, h2 long, bits binary")


def _indexed(reps: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(key, band, cid): the indexed segments of every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for cid, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                have = tokens(t.as_py(), width)
                out += [(_keys(have, bands, band, take), band, cid) for band, take in bands.parts(len(have))]
            if out:
                sizes = [len(k) for k, _, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([k for k, _, _ in out])),
                     pa.array(np.repeat(np.array([b for _, b, _ in out], np.int32), sizes)),
                     pa.array(np.repeat(np.array([c for _, _, c in out], np.int64), sizes))], ["key", "band", "cid"])

    return reps.select("cid", "text").mapInArrow(run, "key long, band int, cid long")


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those of (a, b, na, sa, nb, sb) whose bitmaps allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            stay = pa.array([_may_be_near(*row, percent) for row in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(stay), batch.column(1).filter(stay)], ["a", "b"])

    return pairs.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose texts' shingle sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set] = {}
        for batch in batches:
            stay = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                  batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                held = {k: held[k] if k in held else set(shingles(t.as_py(), width)) for k, t in ((a, x), (b, y))}
                same = len(held[a] & held[b])
                stay.append(100 * same >= percent * (len(held[a]) + len(held[b]) - same))
            mask = pa.array(stay, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    some = staged(reps.select("cid", "text").join(ids, "cid", "left_semi"), "asked")  # the texts of pairs only
    left = some.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = some.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _small_bucket_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in buckets of bounded size, by their bitmaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                have = sorted((v["cid"], v["comp"], v["n"], v["bits"]) for v in row.as_py())
                for j, (y, cy, ny, sy) in enumerate(have):
                    for x, cx, nx, sx in have[:j]:
                        if cx != cy and _may_be_near(nx, sx, ny, sy, percent):
                            a.append(x)
                            b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def _neighbourhoods(wanted: DataFrame, width: int, bands: Bands) -> DataFrame:
    """Whole segments, and those less a token, of ``wanted`` (cid, band, units, gone, text).

    Returns (cid, band, units, segment, key, less, passed, size): whether the
    segment's key is in ``gone``, and the segment's number of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, band, units, gone, t in zip(*(batch.column(i).to_pylist() for i in range(4)),
                                                 batch.column(4).cast(pa.binary()), strict=True):
                have = tokens(t.as_py(), width)
                take = dict(bands.parts(len(have)))[band]
                segment, key = _deletions(have, bands, band, take)
                whole = _keys(have, bands, band, take)
                segment = np.concatenate([np.arange(take), segment])
                n = len(segment)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, cid)), pa.array(np.full(n, band, np.int32)), pa.array(np.full(n, units)),
                     pa.array(segment.astype(np.int32)), pa.array(np.concatenate([whole, key])),
                     pa.array(np.arange(n) >= take), pa.array(np.isin(whole, np.array(gone, np.int64))[segment]),
                     pa.array(np.bincount(segment, minlength=take)[segment])],
                    ["cid", "band", "units", "segment", "key", "less", "passed", "size"])

    return wanted.select("cid", "band", "units", "gone", "text").mapInArrow(
        run, "cid long, band int, units long, segment int, key long, less boolean, passed boolean, size long")


def _large_bucket_pairs(large: DataFrame, reps: DataFrame, width: int, percent: int, bands: Bands) -> DataFrame | None:
    """Verified links of pairs that agree only in segments passed over, or as many as join these up.

    ``large`` has (key, band, n, cid, comp) of large open buckets.
    """
    held = large.groupBy("cid", "band").agg(F.collect_list("key").alias("gone")).join(
        reps.select("cid", F.col("n").alias("size")), "cid")
    units = F.size("gone") - bands.slack(F.col("size"), F.col("band"))
    held = staged(held.withColumn("units", units.cast("long")), "held")
    if held.where("units > 0").isEmpty():  # every set has slack enough
        return None
    # A pair still unseen agrees in large buckets only, and in more of them than the slack of its side with
    # fewer segments.  So a possible partner passes over more than the slack of the least set near it.
    least = F.ceil(F.col("size") * percent / 100)
    around = held.where(F.size("gone") > bands.slack(least, F.col("band"))).drop("size")
    every = staged(_neighbourhoods(around.join(reps.select("cid", "text"), "cid"), width, bands), "around")
    hits = every.groupBy("key", "less").agg(F.count("*").alias("hits"))
    # a unit: the neighbourhood of a segment not passed over, or a passed one's bucket
    own = every.where("units > 0")
    free, whole = own.where("not passed"), own.where("passed and not less")
    cost = ["cid", "band", "segment", "units"]
    found = free.select(*cost, "key", (~F.col("less")).alias("less")).join(hits, ["key", "less"]).select(*cost, "hits")
    priced = free.where("not less").select(*cost, F.col("size").alias("cost")).union(found).groupBy(*cost).agg(
        F.sum("cost").alias("cost"))
    asked = priced.union(whole.join(large.select("key", F.col("n").alias("cost")).distinct(), "key").select(*cost, "cost"))
    by_cost = Window.partitionBy("cid", "band").orderBy("cost", "segment")  # a set's segments
    chosen = staged(asked.withColumn("at", F.row_number().over(by_cost)).where("at <= units").select(
        "cid", "band", "segment"), "chosen")
    facts = reps.select("cid", "n", "bits").join(large.select("cid", "comp").distinct(), "cid")
    probes = free.join(chosen, ["cid", "band", "segment"], "left_semi").select("key", (~F.col("less")).alias("less"), "cid")
    probes = staged(probes.union(whole.join(chosen, ["cid", "band", "segment"], "left_semi").select(
        "key", F.lit(False), "cid")), "probes")
    at = ["key", "less"]
    entries = staged(every.select(*at, "cid").join(probes.select(*at).distinct(), at, "left_semi"), "entries")
    asking = staged(probes.join(entries.select(*at).distinct(), at, "left_semi"), "asking")
    return _met(asking, entries, facts, reps, width, percent)


def _met(asking: DataFrame, entries: DataFrame, facts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links that join up all similar sets of which one asks for a (key, less) the other enters.

    A large group of sets near each other would give all its pairs.  So blocks
    with many candidates first give a forest over them, the likeliest pairs
    first, and where all of it holds its sets are one component and nothing
    stays to be compared; one key in ``FIRST_KEYS`` begins.  What is open after
    that gives all its pairs.
    """
    at, links, open_keys = ["key", "less"], None, None
    for first, whole in ((True, False), (False, False), (False, True)):
        rows = [t.where(F.pmod(F.xxhash64("key"), F.lit(FIRST_KEYS)) == 0) if first else
                t if open_keys is None else t.join(open_keys, at, "left_semi") for t in (asking, entries)]
        placed = rows[0].select(*at, "cid").union(rows[1].select(*at, "cid")).join(facts.select("cid", "comp"), "cid")
        live = staged(placed.groupBy(*at).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(
            "lo <> hi").select(*at), "live")
        some, others = (_blocks(t.join(live, at, "left_semi"), facts, name)
                        for t, name in zip(rows, ("some", "others"), strict=True))
        met = staged(_block_pairs(some.join(others, at), percent, whole), "met")
        held = staged(_verified(staged(met.select("a", "b").distinct(), "pairs"), reps, width, percent), "links")
        links = held if links is None else links.union(held)
        if not first:
            open_keys = staged(met.where("cut").select(*at).distinct(), "cut")
            if open_keys.isEmpty():
                break
        comp = facts.select("cid", "comp")
        ends = held.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b")
        roots = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        facts = staged(facts.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select(
            "cid", "n", "bits", F.coalesce("root", "comp").alias("comp")), "facts")
    return links


def _blocks(rows: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """(key, less, name): the sets of each key, with their facts, in blocks of bounded size."""
    counts = rows.groupBy("key", "less").agg(F.count("*").alias("rows"))
    dealt = rows.join(counts, ["key", "less"]).withColumn(
        "block", F.pmod(F.xxhash64("cid"), F.ceil(F.col("rows") / BLOCK)))
    return dealt.join(facts, "cid").groupBy("key", "less", "block").agg(
        F.collect_list(F.struct("cid", "comp", "n", "bits")).alias(name)).drop("block")


def _forest(ends: np.ndarray, cost: np.ndarray) -> list[int]:
    """Which of the links ``ends`` (two rows of nodes) join all that they join, links of least cost first."""
    nodes, ends = np.unique(ends, return_inverse=True)
    ends = ends.reshape(2, -1)
    above, out = list(range(len(nodes))), []
    for i in np.argsort(cost, kind="stable").tolist():
        x, y = int(ends[0, i]), int(ends[1, i])
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        if x != y:
            above[x] = y
            out.append(i)
            if len(out) == len(nodes) - 1:
                break
    return out


def _block_pairs(blocks: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(key, less, a, b, cut): of two blocks of sets, the pairs of different components whose bitmaps allow the similarity.

    Unless ``whole``, blocks with more than ``DENSE`` such pairs a set give a forest over them only: ``cut``.
    """
    def facts(row) -> dict[int, tuple]:
        """By bytes of bitmap: numbers, components, sizes and bitmaps."""
        by: dict[int, list] = {}
        for v in row.as_py():
            by.setdefault(len(v["bits"]), []).append((v["cid"], v["comp"], v["n"], v["bits"]))
        return {k: (*(np.array(c) for c in list(zip(*some))[:3]),
                    np.frombuffer(b"".join(v[3] for v in some), np.uint64).reshape(len(some), -1)) for k, some in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, less, some, others in zip(*batch.columns, strict=True):
                a, b, found = facts(some), facts(others), []
                for (x, cx, nx, sx), (y, cy, ny, sy) in ((u, v) for u in a.values() for v in b.values()):
                    wide = min(sx.shape[1], sy.shape[1])
                    sx, sy = _folded_rows(sx, wide), _folded_rows(sy, wide)
                    step = max(1, (1 << 20) // (len(y) * wide))
                    for i in range(0, len(x), step):
                        most = (100 - percent) * (nx[i:i + step, None] + ny[None, :]) // (100 + percent)
                        apart = np.bitwise_count(sx[i:i + step, None, :] ^ sy[None, :, :]).sum(axis=2, dtype=np.int64)
                        may = (apart <= most) & (np.abs(nx[i:i + step, None] - ny[None, :]) <= most)
                        r, c = np.nonzero(may & (cx[i:i + step, None] != cy[None, :]))
                        if len(r):
                            found.append((x[i:i + step][r], y[c], cx[i:i + step][r], cy[c], (apart / (most + 1))[r, c]))
                if not found:
                    continue
                u, v, cu, cv, cost = (np.concatenate(c) for c in zip(*found, strict=True))
                cut = not whole and len(u) > DENSE * (len(some) + len(others))
                if cut:
                    stay = _forest(np.stack([cu, cv]), cost)
                    u, v = u[stay], v[stay]
                n = len(u)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * n, pa.int64()), pa.array([less.as_py()] * n, pa.bool_()),
                     pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array([cut] * n, pa.bool_())],
                    ["key", "less", "a", "b", "cut"])

    return blocks.select("key", "less", "some", "others").mapInArrow(
        run, "key long, less boolean, a long, b long, cut boolean")


def _folded_rows(bits: np.ndarray, wide: int) -> np.ndarray:
    while bits.shape[1] > wide:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _links(reps: DataFrame, width: int, percent: int, hot: int, bands: Bands) -> DataFrame:
    """Verified links (a, b) that join up all similar classes."""
    facts = reps.select("cid", "n", "bits")
    keys = staged(_indexed(reps, width, bands), "keys")
    # most keys occur once: they travel as bare counts, and only the others are looked into
    shared = staged(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = staged(keys.join(shared, "key"), "met")
    least = met.groupBy("key").agg(F.min("cid").alias("least"))
    ties = met.join(least, "key").where("cid <> least").select(F.col("least").alias("a"), F.col("cid").alias("b")).distinct()
    members = met.where("n > 2")
    named = ties.join(facts.toDF("a", "na", "sa"), "a").join(facts.toDF("b", "nb", "sb"), "b")
    first = staged(_verified(staged(_near(named, percent), "ties"), reps, width, percent), "links")
    roots = components(first).select(F.col("node").alias("cid"), "root")
    placed = staged(members.join(roots, "cid", "left").select(
        "key", "band", "n", "cid", F.coalesce("root", "cid").alias("comp")), "placed")
    several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    still = staged(placed.join(several.select("key"), "key"), "open")
    small = still.where(F.col("n") <= hot).join(facts.withColumnRenamed("n", "size"), "cid").groupBy("key").agg(
        F.collect_list(F.struct("cid", "comp", F.col("size").alias("n"), "bits")).alias("all")).select("all")
    more = _small_bucket_pairs(small, percent)
    beyond = _large_bucket_pairs(still.where(F.col("n") > hot), reps, width, percent, bands)
    near = staged(_verified(staged(more.distinct(), "pairs"), reps, width, percent), "links")
    return first.union(near) if beyond is None else first.union(near).union(beyond)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85,
                   hot: int = HOT, slack_every: int = SLACK_EVERY) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of ``docs``.

    Two rows are linked when 100 * |common shingles| >= ``percent`` * |all
    shingles|; ``component_id`` is the least id reachable over links, the row's
    own included.  Null and blank texts have the empty set, are linked with
    nothing and keep their own id.  A row with a null id links others; its
    component is the least non-null id (null if there is none).  Repeated rows
    each get their row, and are linked like other copies; an empty table gives
    an empty result.  Other columns play no part; an id column of any name and
    orderable type will do.  Shingle counts and classes of equal sets go by 64
    and 128-bit hashes; links between classes are verified on the shingles.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent lies above 0 and up to 100")
    bands = Bands(percent, slack_every)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`")).alias("w1"),
                        F.xxhash64(text_or_empty(text_col)).alias("w2"), text_or_empty(text_col).alias("text"))
    sets = staged(_sets(named, width), "sets")
    classes = staged(sets.where("n > 0").groupBy("h1", "h2").agg(
        F.min("id").alias("first"), F.min(F.struct("w1", "w2", "n", "bits")).alias("w")).select(
        "h1", "h2", "first", "w.*"), "classes")
    texts = named.select("w1", "w2", "text").join(classes.select("w1", "w2", "n", "bits"), ["w1", "w2"])
    one = texts.groupBy("w1", "w2").agg(*[F.first(c).alias(c) for c in ("text", "n", "bits")])  # of rows alike, one
    reps = staged(one.withColumn("cid", F.monotonically_increasing_id()), "texts")
    roots = staged(components(_links(reps, width, percent, hot, bands)), "roots")
    numbered = classes.join(reps.select("w1", "w2", "cid"), ["w1", "w2"]).select("h1", "h2", "first", "cid")
    placed = staged(numbered.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "h1", "h2", "first", F.coalesce("root", "cid").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    groups = staged(placed.join(least, "root").select("h1", "h2", "least"), "groups")
    out = sets.join(groups, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all whole texts of ``documents``: four-word shingles, similarity 85 %."""
    return jaccard_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
