"""The n-gram Jaccard join against brute force."""

import itertools
import random

import numpy as np
import pytest

from fitframe.llm import setjoin
from tests.llm.test_llm_operators import odd_texts, prose, table, union_find


def brute(texts, ids, width, percent):
    sets = [set(setjoin.shingles((t or "").encode(), width)) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    roots, least = union_find(len(texts), pairs), {}
    for i, r in enumerate(roots):
        if ids[i] is not None:
            least[r] = min(least.get(r, 10 ** 9), ids[i])
    return [(ids[i], len(sets[i]), least.get(roots[i]) if sets[i] else ids[i]) for i in range(len(texts))], len(pairs)


def near_copies(seed, n, words, vocab):
    """Texts of like length over few words, many with some words changed in others."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out).split()
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(vocab)}"
            if rng.random() < 0.5:
                t = t[:rng.randrange(3, len(t) + 1)] + [f"w{rng.randrange(vocab)}"]
        else:
            t = [f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(words // 2, words))]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("hot,percent,width,words", [(1, 85, 1, 14), (1, 60, 1, 12), (64, 85, 4, 90), (3, 100, 2, 10)])
def test_groups_equal_brute_force(spark, hot, percent, width, words):
    texts = near_copies(hot * 1000 + percent + words, 220, words, 30 if width == 1 else 400)
    ids = list(range(len(texts)))
    want, links = brute(texts, ids, width, percent)
    got = setjoin.jaccard_groups(table(spark, texts), width=width, percent=percent, hot=hot, slack_every=1000)
    assert sorted(map(tuple, got.collect())) == want and links >= (0 if percent == 100 else 11)


def test_large_buckets_are_met_by_deletions(spark, monkeypatch):
    """Pairs that agree in nothing but segments passed over are found by one-deletion neighbourhoods, and only there."""
    texts = []
    for f in range(4):  # members of a family have three words of their own; they are near its bare text only
        base = [f"f{f}b{i}" for i in range(21)]
        texts += [" ".join(base + [f"f{f}m{k}u{i}" for i in range(3)]) for k in range(40)] + [" ".join(base)]
    ids = list(range(len(texts)))
    want, links = brute(texts, ids, 1, 85)
    got = setjoin.jaccard_groups(table(spark, texts), width=1, hot=2, slack_every=1000)
    assert sorted(map(tuple, got.collect())) == want and links > 20
    monkeypatch.setattr(setjoin, "_large_bucket_pairs", lambda *_: None)
    without = setjoin.jaccard_groups(table(spark, texts), width=1, hot=2, slack_every=1000)
    assert sorted(map(tuple, without.collect())) != want


def test_a_group_of_near_sets_gives_few_pairs(spark, monkeypatch):
    """Sets all near each other are joined by links that rise with their number, not by all their pairs."""
    rng, n = random.Random(8), 150
    gone = [rng.sample(range(60), 2) for _ in range(n)]
    texts = [" ".join(f"m{k}u{i}" if i in gone[k] else f"b{i}" for i in range(60)) for k in range(n)]
    rows = [(k, t, len(have), setjoin.bitmap(have), k)
            for k, t in enumerate(texts) for have in [setjoin.tokens(t.encode(), 1)]]
    facts = spark.createDataFrame(rows, "cid long, text string, n long, bits binary, comp long")
    met = spark.createDataFrame([(key, False, k) for key in range(64) for k in range(n)], "key long, less boolean, cid long")
    asked, verified = [], setjoin._verified
    monkeypatch.setattr(setjoin, "_verified", lambda pairs, *r: asked.append(pairs.count()) or verified(pairs, *r))
    links = setjoin._met(met, met, facts.drop("text"), facts, 1, 85).collect()
    assert len(set(union_find(n, [(r.a, r.b) for r in links]))) == 1
    assert sum(asked) < 10 * n < n * (n - 1) / 2, asked


def test_forest_joins_what_its_links_join():
    rng = np.random.default_rng(3)
    for _ in range(50):
        ends, cost = rng.integers(0, 30, (2, int(rng.integers(1, 80)))) * 7, rng.random(80)
        stay = setjoin._forest(ends, cost[:ends.shape[1]])
        pairs = (ends // 7).T.tolist()
        assert union_find(30, [pairs[i] for i in stay]) == union_find(30, pairs) and len(stay) < 30


def test_odd_rows(spark):
    texts = odd_texts()
    ids = [5, None, 2, 3, 3, 9, 6, 7, 8, 10, 11, 12, 13]
    want, _ = brute(texts, ids, 4, 85)
    df = table(spark, texts, ids)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, setjoin.jaccard_groups(df).collect()), key=key) == sorted(want, key=key)
    assert setjoin.jaccard_groups(df.limit(0)).count() == 0
    for name in ("key", "cid", "text2", "n"):
        other = df.select(df.doc_id.alias(name), "text", df.source.alias("first"))
        assert setjoin.jaccard_groups(other, id_col=name).columns == [name, "n_shingles", "component_id"]
    many = table(spark, [prose(1, 60)] * 50 + [None] * 20, [7] * 50 + [None] * 20)
    assert {tuple(r) for r in setjoin.jaccard_groups(many).collect()} == {(7, 57, 7), (None, 0, None)}


def test_bitmaps_never_reject_a_near_pair():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) > 0.08]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64)]))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 85 * (len(a) + len(b) - same):
            assert setjoin._may_be_near(len(a), setjoin.bitmap(a), len(b), setjoin.bitmap(b), 85)


def test_bitmaps_are_small_and_still_tell_sets_apart():
    """Bitmaps travel with every row of an open bucket: two bits a token at most, which rule out sets of little likeness."""
    rng = np.random.default_rng(6)
    for n in (65, 300, 511, 512, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        mine = setjoin.bitmap(a)
        assert 8 * len(mine) < 2 * max(64, len(a))
        out = 0
        for _ in range(100):  # 75 % alike, of other sizes too
            m = int(rng.integers(n // 8, n // 4))
            b = np.unique(np.concatenate([a[m:], rng.integers(0, 1 << 63, n // 3 - m, dtype=np.uint64)]))
            out += not setjoin._may_be_near(len(a), mine, len(b), setjoin.bitmap(b), 85)
        assert out > 50, (n, out)


def test_shingles_differ_by_the_order_of_their_words():
    texts = ["a b c d", "b a c d", "d c b a", "a b c", "a b c d d", "c a b", "a a a", "a a", "a a a a"]
    made = [tuple(setjoin.tokens(t.encode(), 4).tolist()) for t in texts]
    assert len(set(made)) == len(texts) and [len(m) for m in made] == [1, 1, 1, 1, 2, 1, 1, 1, 1]
    assert tuple(setjoin.tokens(b"A b  C\nd", 4).tolist()) == made[0]


def test_neighbourhoods_mark_segments_passed_over(spark):
    """Each row says of its own segment whether its bucket was passed over and how many rows it has: no join looks it up."""
    bands, text = setjoin.Bands(85), " ".join(f"w{i}" for i in range(60))
    have = setjoin.tokens(text.encode(), 1)
    band, take = bands.parts(len(have))[0]
    keys = setjoin._keys(have, bands, band, take)
    rows = spark.createDataFrame([(4, band, 2, [int(keys[1]), int(keys[3])], text)],
                                 "cid long, band int, units long, gone array<long>, text string")
    got = setjoin._neighbourhoods(rows, 1, bands).collect()
    assert {r.segment for r in got if r.passed} == {1, 3} and {(r.cid, r.band, r.units) for r in got} == {(4, band, 2)}
    assert [r.key for r in got if not r.less] == keys.tolist()
    assert all(r.size == sum(o.segment == r.segment for o in got) for r in got)
