"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest

from fitframe.llm import spelling
from tests.llm.test_llm_operators import LOWER, table


def brute(rows, least=7, fewest=2, ratio=10, every=31):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= least
    n = {w: c for w, c in n.items() if len(w) >= least and c >= fewest}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form = [], {}
    around = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    for w in n:
        if around[w] and n[around[w][0]] >= ratio * n[w]:
            form[w] = around[w][0]
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if w in form else None))
    return sorted(out)


def corpus(seed, docs):
    rng = random.Random(seed)
    letters = "abcdeéßÿ÷Àz"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaa"]
    weights = [1 / (1 + i) ** 1.5 for i in range(len(base))]

    def word():
        w = rng.choices(base, weights)[0]
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
        return w.upper() if rng.random() < 0.1 else w

    return [" ".join(word() for _ in range(rng.randrange(400))) for _ in range(docs)]


@pytest.mark.parametrize("options", [{}, {"shard_words": 20, "round_bytes": 64, "bits": 4}])
def test_groups_equal_brute_force(spark, options):
    texts = corpus(3, 40) + [None, "", " \n", "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999, "einmalig"]
    ids = [5, None, 2, 3, 3, *range(10, 10 + len(texts) - 5)]
    got = spelling.spelling_groups(table(spark, texts, ids), every=5, **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(list(zip(ids, texts)), every=5)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] not in (None, w[2]) for w in want)


def test_empty_table_and_odd_names(spark):
    df = table(spark, ["foobars foobars foobarz foobarz"] * 11 + ["foobarx foobarx"])
    assert spelling.spelling_groups(df.limit(0)).count() == 0
    odd = df.select(df.doc_id.alias("word"), df.text.alias("n"), df.source.alias("text"))
    assert sorted(map(tuple, spelling.spelling_groups(odd, id_col="word", text_col="n").collect())) == \
        sorted(map(tuple, spelling.spelling_groups(df).collect())) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_only_positives_are_spelt_out():
    words = ["abcdefg", "abcdefgh", "zzzzzzzz"]
    filters = {(7, 0): spelling.np.zeros(4, spelling.np.uint64), (8, 0): spelling.np.zeros(4, spelling.np.uint64)}
    assert not any(a for a, _ in spelling.edits(words[1:], 8, filters, {7: 1, 8: 1}))
