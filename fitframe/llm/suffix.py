"""Exact removal of repeated substrings by two-stage suffix sorting.

Every byte covered by a ``length``-byte string that also starts elsewhere
goes.  Texts are far too large for one suffix array, so the windows are first
dealt out such that equal ones meet:

* a window's anchor is its 64-byte piece of least hash (the last such), which
  depends on the window's bytes alone.  Windows starting one after another
  mostly share an anchor, so a text falls into a few runs of window starts;
* anchors that occur once in all texts cannot lie in a repeated window.  The
  others' runs travel, with the bytes of their windows, to the task of the
  anchor's hash;
* there the windows are suffix-sorted in two stages: suffixes smaller than
  their successors are sorted directly, the others are induced from these by
  scanning the buckets of first bytes.  Neighbours in that order with a common
  prefix of ``length`` bytes or more are repeated windows.

Identical texts travel once; all their windows are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, renamed, staged, tasks, text_or_empty

#: Bytes in an anchor.
PIECE = 64
#: Anchors in more than this many runs are counted window by window instead.
HOT = 256
#: Window bytes sorted at once, and text bytes hashed at once.
SORTED_BYTES, HASHED_BYTES = 1 << 20, 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POSITION = np.uint64((1 << 21) - 1)


def _powers(n: int, base: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


_INVERSE = pow(int(_MULTIPLIER), -1, 1 << 64)
_UP, _DOWN = _powers(2 * HASHED_BYTES + (1 << 12), int(_MULTIPLIER)), _powers(2 * HASHED_BYTES + (1 << 12), _INVERSE)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def rolling(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of every ``width`` bytes of ``data``."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * _UP[:n], out=sums[1:])
    out = (sums[width:] - sums[:-width]) * _DOWN[:n - width + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values."""
    have, out = 1, values
    while have < width:
        more = min(have, width - have)
        out = np.minimum(out[:-more], out[more:])
        have += more
    return out


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """The runs of window starts with a common anchor, over texts laid end to end.

    Returns arrays: the text's number, the anchor's hash, the anchor, and the
    first and last window start, as places in ``data``.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none, none
    hashes = rolling(data, PIECE)
    place = np.arange(len(hashes), dtype=np.uint64)
    best = _least((hashes & ~_POSITION) | (_POSITION - place), length - PIECE + 1)
    valid = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid)[:len(best)])
    if not len(at):
        return none, none.astype(np.uint64), none, none, none
    anchor = (_POSITION - (best[at] & _POSITION)).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor) != 0)
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
    return (np.searchsorted(starts, at[first], "right") - 1, hashes[anchor[first]], anchor[first], at[first],
            at[last])


def blocks(texts: list[bytes], length: int) -> Iterator[tuple]:
    """Texts laid end to end in bounded pieces: (bytes, text numbers, starts, ends, offset in the text).

    A text longer than a piece is cut into pieces that overlap by a window less a byte.
    """
    part, size = [], 0

    def out():
        sizes = np.array([len(t) for _, t, _ in part], np.int64)
        ends = np.cumsum(sizes)
        return (b"".join(t for _, t, _ in part), np.array([i for i, _, _ in part]), ends - sizes, ends,
                np.array([o for _, _, o in part]))

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for o in range(0, len(text) - length + 1, HASHED_BYTES):
            part.append((i, text[o:o + HASHED_BYTES + length - 1], o))
            size += len(part[-1][1])
            if size >= HASHED_BYTES:
                yield out()
                part, size = [], 0
    if part:
        yield out()


def _smaller_than_next(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than that at the next one, within its piece."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(data.astype(np.int16)))
    step[ends - 1] = -1  # the end is smaller than any byte
    known = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def two_stage(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """All places with ``length`` bytes left in their piece, in order of these bytes.

    Stage one sorts the places whose suffix is smaller than the next one; stage
    two scans the buckets of first bytes upwards, and puts the place before
    each scanned one, if its suffix is the greater, at its bucket's front.
    """
    s = np.frombuffer(data, np.uint8)
    small = _smaller_than_next(s, ends)
    # in each piece, take part: all windows, and on to the next directly sorted place
    direct = np.flatnonzero(small)
    last = ends - length
    at = np.searchsorted(direct, last)
    upto = np.where(at < len(direct), direct[np.minimum(at, len(direct) - 1)] if len(direct) else 0, len(s))
    open_end = upto >= ends
    upto = np.where(open_end, ends - 1, upto)
    mark = np.zeros(len(s) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, upto + 1, -1)
    member = np.cumsum(mark)[:-1] > 0
    induced = member & ~small
    first = np.zeros(len(s) + 1, bool)
    first[starts] = True
    picked = np.flatnonzero(member & small).tolist()
    rows = [data[i:i + length] for i in picked]
    order = sorted(range(len(picked)), key=rows.__getitem__)
    picked = np.array(picked, np.int64)[order] if picked else np.zeros(0, np.int64)
    del rows
    by_byte = np.searchsorted(s[picked], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def put(places: np.ndarray) -> None:
        """Places before the scanned ones go to their buckets, in scanning order."""
        before = places[~first[places]] - 1
        before = before[induced[before]]
        if len(before):
            byte = s[before]
            sort = np.argsort(byte, kind="stable")
            before, byte = before[sort], byte[sort]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(before, cuts):
                waiting[s[part[0]]].append(part)

    ended = ends[open_end]
    if len(ended):  # suffixes induced from the end itself, the smallest of all
        before = ended - 1
        before = before[induced[before]]
        sort = np.argsort(s[before], kind="stable")
        for i in before[sort]:
            waiting[s[i]].append(np.array([i]))
    for byte in range(256):
        while waiting[byte]:
            places = np.concatenate(waiting[byte])
            waiting[byte] = []
            out.append(places)
            put(places)
        places = picked[by_byte[byte]:by_byte[byte + 1]]
        if len(places):
            out.append(places)
            put(places)
    all_places = np.concatenate(out) if out else np.zeros(0, np.int64)
    window = np.zeros(len(s) + 1, np.int32)
    np.add.at(window, starts, 1)
    np.add.at(window, last + 1, -1)
    return all_places[np.cumsum(window)[all_places] > 0]


def repeated(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The places whose ``length`` bytes also start elsewhere, in rising order."""
    order = two_stage(data, starts, ends, length)
    if len(order) < 2:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    same = np.zeros(len(order) + 1, bool)
    for a in range(0, len(order) - 1, 1 << 15):
        part = order[a:a + (1 << 15) + 1]
        have = view[part]
        have = have.view(np.uint64) if length % 8 == 0 else have
        same[a + 1:a + len(part)] = (have[1:] == have[:-1]).all(axis=1)
    return np.sort(order[same[:-1] | same[1:]])


def _spans(places: np.ndarray) -> list[tuple[int, int]]:
    """Rising places as (first, last) of each run without a gap."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(),
                    places[np.concatenate([cut, [len(places) - 1]])].tolist(), strict=True))


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """(t1, t2, who, anchor, n): how many runs of each text have each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).cast(pa.binary()).to_pylist()
            for data, number, starts, ends, _ in blocks(raw, length):
                piece, anchor, *_ = runs(np.frombuffer(data, np.uint8), starts, ends, length)
                if len(piece):
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(pa.array(number[piece])) for i in range(3)),
                         pa.array(anchor.view(np.int64))], ["t1", "t2", "who", "anchor"])

    found = texts.select("t1", "t2", "who", "text").mapInArrow(run, "t1 long, t2 long, who long, anchor long")
    return found.groupBy("anchor", "t1", "t2", "who").count().groupBy("anchor", "t1", "t2").agg(
        F.max("count").alias("n"), F.min("who").alias("who"))


def _runs(texts: DataFrame, length: int) -> DataFrame:
    """The runs of the wanted anchors: (anchor, hot, t1, t2, start, ahead, data)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            want = [{v["anchor"]: v["hot"] for v in row} for row in batch.column(3).to_pylist()]
            t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for data, number, starts, ends, offset in blocks(raw, length):
                piece, anchor, at, a, b = runs(np.frombuffer(data, np.uint8), starts, ends, length)
                out = []
                for k, h, p, x, y in zip(piece.tolist(), anchor.view(np.int64).tolist(), at.tolist(), a.tolist(),
                                         b.tolist(), strict=True):
                    i = int(number[k])
                    hot = want[i].get(h)
                    if hot is not None:
                        out.append((h, hot, t1[i], t2[i], int(offset[k]) + x - int(starts[k]), p - x, data[x:y + length]))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names)

    names = ["anchor", "hot", "t1", "t2", "start", "ahead", "data"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return texts.select("t1", "t2", "text", "wanted").mapInArrow(
        run, "anchor long, hot boolean, t1 long, t2 long, start long, ahead long, data binary")


def _sorted_repeats(found: DataFrame, length: int) -> DataFrame:
    """(t1, t2, first, last): repeated window starts among runs grouped by anchor."""
    def solve(held: dict) -> list[tuple]:
        pieces = list(held)
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        places = repeated(b"".join(p[2] for p in pieces), starts, ends, length)
        cuts = np.searchsorted(places, starts)
        out = []
        for k, p in enumerate(pieces):
            who = held[p]
            mine = [(0, int(sizes[k]) - length)] if len(who) > 1 else \
                _spans(places[cuts[k]:cuts[k + 1] if k + 1 < len(pieces) else None] - starts[k])
            out += [(t1, t2, s + a, s + b) for t1, t2, s in who for a, b in mine]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, set] = {}
        size, last = 0, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                anchor, t1, t2, start, ahead, data = row
                if anchor != last and size >= SORTED_BYTES:
                    out += solve(held)
                    held, size = {}, 0
                last = anchor
                key = (anchor, ahead, data)
                if key not in held:
                    held[key] = set()
                    size += len(data)
                held[key].add((t1, t2, start))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
        if held and (out := solve(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    names = ["t1", "t2", "first", "last"]
    dealt = found.select("anchor", "t1", "t2", "start", "ahead", "data").repartition(tasks(found.sparkSession), "anchor")
    return dealt.sortWithinPartitions("anchor").mapInArrow(run, "t1 long, t2 long, first long, last long")


def windows_of(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, t1, t2, start) of all windows of a batch of runs (t1, t2, start, data), many runs hashed at once."""
    t1, t2, at = (batch.column(i).to_numpy() for i in range(3))
    for data, number, starts, ends, offset in blocks(batch.column(3).to_pylist(), length):
        s = np.frombuffer(data, np.uint8)
        sizes = ends - starts - length + 1
        piece = np.repeat(np.arange(len(starts)), sizes)
        ahead = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        a, b = (rolling(s, length, k)[starts[piece] + ahead].view(np.int64) for k in (0, 1))
        row = number[piece]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (a, b, t1[row], t2[row], at[row] + offset[piece] + ahead)],
            ["h1", "h2", "t1", "t2", "start"])


def _counted_repeats(found: DataFrame, length: int) -> DataFrame:
    """The same for runs of very frequent anchors: windows are counted by two hashes of their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from windows_of(batch, length)

    # dealt out evenly first: the frequent runs may come from few texts
    dealt = found.select("t1", "t2", "start", "data").repartition(tasks(found.sparkSession))
    windows = dealt.mapInArrow(
        run, "h1 long, h2 long, t1 long, t2 long, start long")
    # a row that is there twice repeats all its windows, as the classes say too
    more = staged(windows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "windows")
    return windows.join(more, ["h1", "h2"]).select("t1", "t2", F.col("start").alias("first"),
                                                   F.col("start").alias("last"))


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400, id_col: str = "doc_id",
                   hot: int = HOT) -> DataFrame:
    """``docs`` with ``kept`` (binary), ``kept_text``, ``n_bytes``, ``n_removed``, ``n_spans`` (long) added.

    ``kept`` is the text's UTF-8 bytes without those covered by a
    ``length``-byte string that starts anywhere else in the column; such
    strings are judged on the input and never cross texts.  ``kept_text`` has
    the same as text: a character of which only some bytes went goes whole.  Null texts count as
    empty, and shorter texts stay whole.  A repeated row repeats all its
    strings, as any exact copy does; null or repeated ids are no matter.  An
    empty table gives an empty result; columns of ``docs`` that bear an added
    column's name give way to it.
    """
    if length < 2 * PIECE:
        raise ValueError(f"length is to be at least {2 * PIECE}")
    added = ["kept", "kept_text", "n_bytes", "n_removed", "n_spans"]
    carry = [c for c in docs.columns if c.lower() not in added]
    x = renamed(docs, ["own"])
    text = text_or_empty(text_col)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias(x["own"]), text.alias("text"),
                        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
                        F.xxhash64(F.col(f"`{id_col}`")).alias("who"))
    classes = named.groupBy("t1", "t2").agg(F.count("*").alias("copies")).where("copies > 1")
    anchors = staged(_anchors(named, length), "anchors")
    often = staged(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "often")
    wanted = staged(
        anchors.drop("n").join(often, "anchor").groupBy("t1", "t2").agg(
            F.min("who").alias("who"),
            F.collect_set(F.struct("anchor", (F.col("n") > hot).alias("hot"))).alias("wanted")), "wanted")
    found = staged(_runs(named.select("t1", "t2", "who", "text").join(wanted, ["t1", "t2", "who"]), length), "runs")
    spans = _sorted_repeats(found.where("not hot"), length).union(_counted_repeats(found.where("hot"), length))
    known = staged(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
                   .join(classes, ["t1", "t2"], "full"), "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts, counts = [], [], []
            rows = zip(batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True)
            for data, found, copies in rows:
                data = data.as_py()
                n = len(data)
                if copies.as_py() and n >= length:
                    kept.append(b"")
                    texts.append("")
                    counts.append((n, n, 1))
                    continue
                out, at, removed, pieces, end = [], 0, 0, 0, -1
                for v in sorted(found.as_py() or [], key=lambda v: v["first"]):
                    a, b = v["first"], v["last"] + length
                    if a > end:
                        out.append(data[at:a])
                        pieces += 1
                        removed += b - a
                        at = end = b
                    elif b > end:
                        removed += b - end
                        at = end = b
                out.append(data[at:])
                kept.append(b"".join(out))
                texts.append("".join(v.decode("utf-8", "ignore") for v in out))
                counts.append((n, removed, pieces))
            n, removed, pieces = zip(*counts) if counts else ((), (), ())
            own = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(kept, pa.binary()), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (n, removed, pieces))],
                [x["own"], *added])

    both = named.drop("who").join(known, ["t1", "t2"], "left").select(x["own"], "text", "spans", "copies")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("o")).schema["o"].dataType.simpleString()
    done = both.mapInArrow(run, f"`{x['own']}` {own}, kept binary, kept_text string, n_bytes long, n_removed long, n_spans long")
    return done.select(f"{x['own']}.*", *added)


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated substrings taken out of ``text`` (and ``n_chars`` to match); null texts stay null."""
    x = renamed(docs, ["own"])
    cut = remove_repeats(docs.select(F.struct("*").alias(x["own"]), "text", "doc_id"), **options)
    text = F.when(F.col(f"{x['own']}.text").isNotNull(), F.col("kept_text"))
    return cut.select(*[
        text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars"
        else F.col(f"{x['own']}.`{c}`") for c in docs.columns])


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of all whole texts of ``documents``."""
    cut = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
