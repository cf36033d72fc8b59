"""Conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib

from fitframe.llm import repair

ROWS = "conv_id long, turn int, role string, text string, id string, kind int, `place` string, audit string"
LEGAL = re.compile("(s?(ua)+)?")


def brute_plan(rows):
    """Every plan by rising (cost, audit), until one gives a legal result; (cost, audit, turns)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, shape = heapq.heappop(heap)
        if i == len(rows) and LEGAL.fullmatch(shape):
            return cost, audit, shape
        # shapes with one last role and one place go on alike; the first to come is the best
        if (i, shape[-1:]) in done or not re.fullmatch("s?(ua)*u?", shape):
            continue
        done.add((i, shape[-1:]))
        for r in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, shape + r))
        if i < len(rows):
            initial, fault = rows[i]
            more = 3 if fault == "t" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, shape))
            if fault != "x":
                if initial:  # an empty role is no role to keep
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, shape + initial))
                for r in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, shape + r))


def exhaustive(rows):
    """The same with nothing left out, for few rows: all plans with at most two inserted turns in a row."""
    best = None
    stack = [(0, "", 0, "", 0)]
    while stack:
        cost, audit, i, shape, run = stack.pop()
        if best and cost > best[0]:
            continue
        if i == len(rows):
            if LEGAL.fullmatch(shape) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, shape)
        else:
            initial, fault = rows[i]
            more = 3 if fault == "t" else 0
            stack.append((cost + 4, audit + "D", i + 1, shape, 0))
            if fault != "x":
                stack.append((cost + more, audit + "K", i + 1, shape + initial, 0))
                stack += [(cost + 3 + more, audit + "R", i + 1, shape + r, 0) for r in "ua"]
        if run < 2:
            stack += [(cost + 3, audit + "I", i, shape + r, run + 1) for r in "ua"]
    return best


def test_plans_equal_exhaustive_search():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suauaz"), rng.choice("---tx")) for _ in range(rng.randrange(4))]
        assert repair.cheapest(rows) == exhaustive(rows)[:2] == brute_plan(rows)[:2], rows


def test_longer_plans():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice("suauauaz"), rng.choice("------tx")) for _ in range(rng.randrange(60))]
        assert repair.cheapest(rows) == brute_plan(rows)[:2], rows
    for pattern in ("u", "a", "s", "uua", "aua", "uaau", "z"):  # a thousand rows, all of them clashing
        rows = [(r, "t" if k % 7 == 3 else "-") for k, r in enumerate((pattern * 1000)[:1000])]
        cost, audit = repair.cheapest(rows)
        assert (cost, audit) == brute_plan(rows)[:2] and len(audit.replace("I", "")) == 1000


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        have = []
        for c, t, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            have += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        have.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in have:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "-" if solid[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = [t for t, _, _ in have if t is not None]
        cost, audit, shape = brute_plan([(r[:1], "x" if f in "bd" else f) for (_, r, _), f in zip(have, faults)])
        left, final = iter(have), []
        roles = iter(shape)
        for e in audit:
            row = ("", "", "") if e == "I" else next(left)
            if e != "D":
                r = next(roles)
                final.append((row[1] if e == "K" else {"u": "user", "a": "assistant"}[r]) + ":" + row[2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(have, have[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, "bdt"),
                    illegal, cost, audit, hashlib.sha256("\n".join(final).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def test_report_equals_brute_force(spark):
    rng = random.Random(7)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Fine.  ", "a.b", "x" * 5000 + "."]
    rows = [(c if c else None, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "system", "tool", None, ""]
             if rng.random() < 0.3 else [["user", "assistant"][t % 2]]), rng.choice(texts))
            for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(900 + c, 1, "user", "Yes.") for c in range(60)] + [(700, 1, "user", "Yes.")] * 3 + [(800, t, ["user", "assistant"][t % 2], "Long.") for t in range(300)]
    df = spark.createDataFrame([(*r, "i", 1, "p", "a") for r in rows], ROWS)
    got = [tuple(r) for r in repair.repair_report(df).collect()]
    want = brute(rows)
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0)) == want
    assert any(r[-2] == "" for r in want) and len({c for r in want for c in r[-2]}) == 4
    assert repair.repair_report(df.limit(0)).count() == 0


def test_turns_follow_the_plan(spark):
    df = spark.createDataFrame([("x", 1, "system", "Be kind."), ("x", 2, "assistant", "Hello."), ("x", 3, "user", "Hi?"),
                                ("y", 1, "user", ""), ("y", 2, "tool", "cut")], "conv string, n int, who string, said string")
    report, turns = repair.repair_conversations(df, "conv", "n", "who", "said")
    assert {r.conv: (r.cost, r.audit) for r in report.collect()} == {"x": (6, "KIKKI"), "y": (8, "DD")}
    assert [tuple(r) for r in turns.orderBy("conv", "place").collect()] == [
        ("x", 0, "K", "system", "Be kind."), ("x", 1, "I", "user", ""), ("x", 2, "K", "assistant", "Hello."),
        ("x", 3, "K", "user", "Hi?"), ("x", 4, "I", "assistant", "")]
