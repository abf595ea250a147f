import hashlib
import itertools
import random
import re

import pytest

from eventloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """[(initial, fault)] of rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def brute(rows):
    """(cost, audit, repaired) by trying every edit of every turn, with up to two insertions before each and at the end."""
    found, marks = None, faults(rows)
    choices = [[f"{i}{e}" for i in ("", "I", "II") for e in ("DRK" if f not in ("blank", "duplicate") else "D")] for _, f in marks]
    for edits in itertools.product(*choices, ("", "I", "II")):
        state, cost, out = 0, 0, []
        for (_, role, text), (initial, fault), edit in zip([*rows, (None, None, None)], [*marks, (None, None)], edits, strict=True):
            for letter in edit:
                if letter == "D":
                    cost += 3
                    continue
                to = {"I": "ua"[state == 2], "R": "ua"[state == 2], "K": initial}[letter]
                legal = {"s": state == 0, "u": state in (0, 1, 3), "a": state == 2}.get(to, False)
                if not legal:
                    break
                state = {"s": 1, "u": 2, "a": 3}[to]
                full = {"u": "user", "a": "assistant"}.get(to)
                cost += {"I": 2, "R": 2, "K": 0}[letter] + (fault == "truncated" and letter != "I")
                out.append(f"{role if letter == 'K' else full}:{'' if letter == 'I' else text}")
            else:
                continue
            break
        else:
            if state in (0, 3) and (found is None or (cost, "".join(edits)) < found[:2]):
                found = (cost, "".join(edits), out)
    return found


def expected(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    marks, (cost, audit, out) = faults(rows), brute(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [sum(f == name for _, f in marks) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    return gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations(n=60, most=4):
    rnd = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "cut off", " \n", "", None, "Why? ", "é…"]
    return {k: [(rnd.choice([None, *range(6)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(rnd.randint(1, most))] for k in [None, *range(n)]}


def test_equals_trying_every_edit(spark):
    rows = conversations()
    df = spark.createDataFrame([(c, *t) for c, turns in rows.items() for t in turns], SCHEMA)
    every = spark.createDataFrame([(c,) for c in [*rows, 1000]], "conv_id long")
    got = {r[0]: tuple(r)[1:] for r in repair.report(df, every).collect()}
    assert got == {c: expected(turns) for c, turns in rows.items()} | {1000: expected([])}


@pytest.mark.parametrize(("block", "fan"), [(1, 1), (12, 6)])
def test_levels_do_not_change_the_result(spark, monkeypatch, block, fan):
    """A long conversation over several partitions, against the same turns repaired as one run."""
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rnd = random.Random(2)
    turns = [(t, rnd.choice(["user", "assistant", "tool"]), rnd.choice(["Yes.", f"no {t}", "", "Oh!", f"Fine {t}."])) for t in range(90)]
    df = spark.createDataFrame([(7, *t) for t in turns] + [(8, 0, "user", "Hi.")] * 5, SCHEMA)
    tree = repair.Tree()
    for (initial, fault), (turn, _, _) in zip(faults(turns), turns, strict=True):
        tree.add(repair.one_run(turn, 1, initial, fault))
    ends = repair.product(tree.total()[0], repair.closure())
    cost, audit = min(x for x in (ends[0], ends[3]) if x)
    got = {r.conv_id: r for r in repair.report(df, df).collect()}
    assert (got[7].cost, got[7].audit) == (cost, audit)
    assert (got[8].duplicate, got[8].audit, got[8].cost) == (4, "DDDDD", 15) or got[8].audit == min("KDDDDI", "KIDDDD")
    lines = {}
    for r in repair.repaired(df).orderBy("conv_id", "position").collect():
        lines.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    for c, x in lines.items():
        assert [p for p, _ in x] == list(range(len(x)))
        assert hashlib.sha256("\n".join(t for _, t in x).encode()).hexdigest() == got[c].repaired_sha256


def test_products_are_associative():
    rnd = random.Random(4)
    for _ in range(200):
        a, b, c = (repair.turn_matrix(rnd.choice("suat"), rnd.choice(["", *repair.FAULTS])) for _ in range(3))
        assert repair.product(repair.product(a, b), c) == repair.product(a, repair.product(b, c))
    m = repair.turn_matrix("u", "")
    assert repair.power(m, 5) == repair.product(m, repair.product(repair.product(m, m), repair.product(m, m)))


def test_empty_tables_and_very_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(none, none).count() == 0 and repair.repaired(none).count() == 0 and repair.damaged(none).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", " " * 500_000)], SCHEMA)
    assert [(r.position, r.edit, r.role) for r in repair.repaired(long).orderBy("position").collect()] == [(0, "K", "user"), (1, "I", "assistant")]


def test_damage(spark):
    rows = [(c, t, "user", "Yes. No") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    import zlib

    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" ", " ") if role is None else (role, text)
        one = (c, t, "user" if fate == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text))
        want += [one] * {0: 0, 3: 2}.get(fate, 1)
    got = [tuple(r) for r in repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
