"""Language-model scoring by deleted interpolation of word bigrams.

The model is ``P(w | v) = a f(w | v) + b f(w) + c / (V + 1)`` with
maximum-likelihood estimates f and weights a, b, c by the bucket of the
context's frequency (0, 1, 2-3, 4-7, ...).  The weights are learned by
expectation-maximisation on counts of a part of the training texts that the
other part's estimates have not seen; the final estimates take both.

Counts are never gathered whole.  Texts are put in blocks, each with its own
small vocabulary.  A block sends every distinct word and word pair once, with
its counts, to the task of the key's hash, and gets the corpus counts back in
the same order: however frequent a word is, it travels once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import packed, read, renamed, staged, tasks, text_or_empty, unpacked

#: Text bytes in a block, steps an octave of probabilities in the held-out histogram, most EM rounds.
BLOCK_BYTES, STEPS, ROUNDS = 12 << 20, 4, 300
FOLDS, HELD_OUT, WEIGHING = 7, 2, 3
_END = b"\n"
_NEVER = -(1 << 12)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (b + _MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x94D049BB133111EB) ^ out >> np.uint64(29)


def _blocks(docs: DataFrame, id_col: str, id_type: str, block_bytes: int) -> DataFrame:
    """(block, weighing, ids, train, sizes, tokens, words): texts as numbers of the block's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        made = 0
        held = {w: ([], [], [], [], _Numbers(), [0]) for w in (False, True)}

        def out(weighing: bool) -> pa.RecordBatch:
            nonlocal made
            ids, train, sizes, tokens, numbers, _ = held[weighing]
            held[weighing] = ([], [], [], [], _Numbers(), [0])
            made += 1
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
            return pa.RecordBatch.from_arrays(
                [pa.array([part + made - 1]), pa.array([weighing]), pa.array([ids], pa.list_(id_kind)),
                 pa.array([np.packbits(train).tobytes()]), pa.array([packed(np.array(sizes, np.uint32))]),
                 pa.array([packed(np.concatenate(tokens))]), pa.array([packed(hashes)])],
                ["block", "weighing", "ids", "train", "sizes", "tokens", "words"])

        for batch in batches:
            id_kind = batch.column(0).type
            for name, fold, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                        batch.column(2).cast(pa.binary()), strict=True):
                data = data.as_py()
                ids, train, sizes, tokens, numbers, size = held[fold == WEIGHING]
                words = data.lower().split()
                words.append(_END)
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                ids.append(name)
                train.append(fold != HELD_OUT)
                sizes.append(len(words))
                size[0] += len(data) + 8
                if size[0] >= block_bytes:
                    yield out(fold == WEIGHING)
        for weighing in (False, True):
            if held[weighing][0]:
                yield out(weighing)

    return docs.mapInArrow(run, f"block long, weighing boolean, ids array<{id_type}>, train binary, sizes binary, "
                                "tokens binary, words binary")


class _Block:
    """A block's tokens, and its distinct words and pairs in order of their keys."""

    def __init__(self, sizes: bytes, tokens: bytes, words: bytes):
        self.sizes = unpacked(sizes, "u4").astype(np.int64)
        token, word = unpacked(tokens, "u4").astype(np.int64), unpacked(words, "u8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.starts] = token[self.starts + self.sizes - 1]  # a text follows an end
        order = np.argsort(word)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.word, self.context, self.words = rank[token], rank[before], word[order]
        pair, self.pair = np.unique(before * len(word) + token, return_inverse=True)
        keys = _mixed(word[pair // len(word)], word[pair % len(word)])
        order = np.argsort(keys)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.pairs, self.pair = keys[order], rank[self.pair]

    def of_texts(self, flags: np.ndarray) -> np.ndarray:
        return np.repeat(flags, self.sizes)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the 64 bits begins among rising keys."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _entries(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, kind, block, weighing, keys, n): for each block and range of keys, the keys and their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, weighing, train, sizes, tokens, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = _Block(sizes, tokens, words)
                taught = b.of_texts(np.unpackbits(np.frombuffer(train, np.uint8))[:len(b.sizes)].astype(bool))
                rows = []
                for kind, keys, at in ((0, b.words, b.word), (1, b.pairs, b.pair)):
                    n = np.bincount(at[taught], minlength=len(keys)).astype(np.uint32)
                    cuts = _cuts(keys, parts).tolist()
                    rows += [(p, kind, name, weighing, packed(np.diff(keys[x:y], prepend=np.uint64(0))), packed(n[x:y]))
                             for p, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)

    names = ["part", "kind", "block", "weighing", "keys", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return blocks.select("block", "weighing", "train", "sizes", "tokens", "words").mapInArrow(
        run, "part long, kind long, block long, weighing boolean, keys binary, n binary")


def _counted(entries: DataFrame) -> DataFrame:
    """(kind, part, block, kept, all, types, tokens, kept_tokens): corpus counts of each block's keys.

    ``kept`` leaves out the weighing blocks.  One more row a range has block -1 and its sums.
    """
    def solve(table: pa.Table) -> pa.Table:
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        blocks, w = table.column("block").to_pylist(), table.column("weighing").to_pylist()
        keys = [np.cumsum(unpacked(k.as_py(), "u8")) for k in table.column("keys")]
        counts = [unpacked(n.as_py(), "u4").astype(np.int64) for n in table.column("n")]
        cuts = np.cumsum([0, *map(len, keys)])
        one, at = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.zeros(len(one), np.int64)
        kept = np.zeros(len(one), np.int64)
        for i, n in enumerate(counts):
            mine = at[cuts[i]:cuts[i + 1]]  # keys of a block are distinct
            every[mine] += n
            if not w[i]:
                kept[mine] += n
        rows = [(kind, part, b, packed(kept[at[x:y]].astype(np.uint64)), packed(every[at[x:y]].astype(np.uint64)), 0, 0, 0)
                for b, x, y in zip(blocks, cuts, cuts[1:])]
        rows.append((kind, part, -1, b"", b"", int((every > 0).sum()), int(every.sum()), int(kept.sum())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

    names = ["kind", "part", "block", "kept", "all", "types", "tokens", "kept_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return entries.groupBy("kind", "part").applyInArrow(
        solve, "kind long, part long, block long, kept binary, all binary, types long, tokens long, kept_tokens long")


def _gathered(rows: list[dict], which: str) -> tuple[np.ndarray, np.ndarray]:
    """A block's counts of its words and of its pairs, in order of their keys."""
    out = []
    for kind in (0, 1):
        mine = sorted((r["part"], r[which]) for r in rows if r["kind"] == kind)
        out.append(np.concatenate([unpacked(v, "u8") for _, v in mine]).astype(np.int64))
    return out[0], out[1]


def _with_counts(blocks: DataFrame, counts: DataFrame, which: str, columns: list[str]) -> DataFrame:
    back = counts.where("block >= 0").groupBy("block").agg(
        F.collect_list(F.struct("kind", "part", which)).alias("back"))
    return blocks.join(back, "block").select(*columns, "sizes", "tokens", "words", "back")


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)


def _parts(b: _Block, words: np.ndarray, pairs: np.ndarray, total: int) -> tuple:
    """For every token: its context's bucket, f(w | v), f(w)."""
    context = words[b.context]
    return (_bucket(context), np.where(context > 0, pairs[b.pair] / np.maximum(context, 1), 0.0),
            words[b.word] / max(total, 1))


def learn_weights(events: list[tuple], floor: float, steps: int = STEPS) -> dict[int, tuple[float, float, float]]:
    """Weights by bucket from (bucket, step of f(w | v), step of f(w), count), by EM.

    One event is added to each weight, so none becomes zero; buckets without
    events have equal weights.
    """
    table: dict[int, list] = {}
    for b, q2, q1, n in events:
        table.setdefault(b, []).append((0.0 if q2 == _NEVER else 2.0 ** (q2 / steps),
                                        0.0 if q1 == _NEVER else 2.0 ** (q1 / steps), floor, n))
    out = {}
    for b, rows in sorted(table.items()):
        rows = np.array(rows)
        weights = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            shares = rows[:, :3] * weights
            new = 1 + (shares / shares.sum(axis=1, keepdims=True) * rows[:, 3:]).sum(axis=0)
            new /= new.sum()
            if np.abs(new - weights).max() < 1e-7:
                break
            weights = new
        out[b] = tuple(weights.tolist())
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words, A-Z lower-cased, and one end; texts whose
    ``crc32(id as text) mod 7`` is 2 teach nothing, and those where it is 3
    serve to learn the weights before they teach.  Null texts are empty (one
    token, the end), a null id counts as the empty text; repeated rows each
    teach and are each scored; an empty table gives an empty result.  With no
    training text every count is zero.  Probabilities of held-out events are
    rounded to quarter octaves for EM, which bounds the histogram that the
    driver receives; nothing else is rounded, and scores are not.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = staged(_blocks(docs.select(id_col, fold.alias(renamed(docs, ["fold"])["fold"]), text_or_empty(text_col)
                                        .alias(renamed(docs, ["text"])["text"])), id_col, id_type, block_bytes), "blocks")
    counts = staged(_counted(_entries(blocks, tasks(spark))), "counts")
    sums = counts.where("block = -1 and kind = 0").agg(
        F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), F.sum("kept_tokens").alias("kept")).first()
    types, total, kept = (int(v or 0) for v in sums)
    floor = 1 / (types + 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, tokens, words, back in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = _Block(sizes, tokens, words)
                bucket, two, one = _parts(b, *_gathered(back, "kept"), kept)
                steps = [np.where(p > 0, np.rint(np.log2(np.maximum(p, 1e-300)) * STEPS), _NEVER).astype(np.int64)
                         for p in (two, one)]
                rows, n = np.unique(np.stack([bucket, *steps]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(n)], ["b", "q2", "q1", "n"])

    events = _with_counts(blocks.where("weighing"), counts, "kept", []).mapInArrow(
        weigh, "b long, q2 long, q1 long, n long").groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))
    weights = np.full((65, 3), 1 / 3)
    for b, w in learn_weights([tuple(r) for r in events.collect()], floor).items():
        weights[b] = w

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, (train, sizes, tokens, words, back) in enumerate(
                    zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                b = _Block(sizes, tokens, words)
                word, pair = _gathered(back, "all")
                bucket, two, one = _parts(b, word, pair, total)
                w = weights[bucket]
                mine = word[b.word]
                yield pa.RecordBatch.from_arrays(
                    [ids[i].values, pa.array(np.unpackbits(np.frombuffer(train, np.uint8))[:len(b.sizes)] == 0),
                     pa.array(b.sizes), pa.array(np.add.reduceat((mine > 0).astype(np.int64), b.starts)),
                     pa.array(np.full(len(b.sizes), total)),
                     pa.array(np.add.reduceat(np.log10((mine + 1) / (total + 1 * (types + 1))), b.starts)),
                     pa.array(np.add.reduceat(np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * floor), b.starts))], names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return _with_counts(blocks, counts, "all", ["ids", "train"]).mapInArrow(
        rate, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bigram model's and the base scores of all whole texts of ``documents``."""
    return score(read(spark, sf_dir, "documents").select("doc_id", "text"))
