from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import CLASHING
from vectorloom.llm import audit_repair as ar

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def conversations(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in [*CLASHING, "block", "pos", "fault", "kind", "said", "place"]}) if extra else df


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def ordered(rows):
    said = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), said(r)))


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def exhaustive(kinds, faults):
    """Cheapest, then least, of all audits with at most two insertions between rows."""
    inserts = ["", "u", "a", "ua", "au"]
    best = None

    def go(i, roles, audit, cost):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for more in inserts:
            r, a, c = roles + more, audit + "I" * len(more), cost + 2 * len(more)
            if i == len(kinds):
                if re.fullmatch("(s?(ua)+)?", r) and (best is None or (c, a) < best[:2]):
                    best = (c, a, r)
                continue
            go(i + 1, r, a + "D", c + 3)
            if faults[i] not in (1, 2):
                extra = faults[i] == 3
                go(i + 1, r + kinds[i], a + "K", c + extra)
                for role in "ua":
                    go(i + 1, r + role, a + "R", c + 2 + extra)

    go(0, "", "", 0)
    return best


def plain(kinds, faults):
    """The same by a table of whole strings, for long conversations."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    cells = {"": (0, "")}

    def inserted(cells):
        for _ in range(3):
            for state, (cost, audit) in list(cells.items()):
                for role in "ua":
                    if (state, role) in move:
                        to = move[state, role]
                        cells[to] = min(cells.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return cells

    for kind, fault in zip(kinds, faults):
        after: dict = {}
        for state, (cost, audit) in inserted(cells).items():
            options = [(state, 3, "D")]
            if fault not in (1, 2):
                options += [(move[state, r], (0 if e == "K" else 2) + (fault == 3), e) for r, e in [(kind, "K"), ("u", "R"), ("a", "R")] if (state, r) in move]
            for to, more, edit in options:
                after[to] = min(after.get(to, (10**9, "")), (cost + more, audit + edit))
        cells = after
    return min(v for s, v in inserted(cells).items() if s in ("", "a"))


def repaired_text(rows, audit):
    out, i, roles = [], 0, ""
    for edit in audit:
        role = "a" if roles.endswith("u") else "u"
        if edit == "K":
            out.append(f"{rows[i][2]}:{rows[i][3]}")
            role = rows[i][2][:1]
        elif edit == "R":
            out.append(f"{NAMES[role]}:{rows[i][3]}")
        elif edit == "I":
            out.append(f"{NAMES[role]}:")
        i += edit != "I"
        roles += role if edit != "D" else ""
    assert i == len(rows) and re.fullmatch("(s?(ua)+)?", roles)
    return "\n".join(out)


def brute(given):
    out = []
    for conv_id in {r[0] for r in given}:
        rows = ordered(damaged([r for r in given if r[0] == conv_id]))
        faults, kinds = faults_of(rows), [r[2][:1] for r in rows]
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = plain(kinds, faults)
        sha = hashlib.sha256(repaired_text(rows, audit).encode()).hexdigest()
        out.append((conv_id, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha))
    return sorted(out, key=str)


def sample(seed=1, n=60, turns=9):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    texts = ["Yes.", "No", "", " \n", None, "Why? ", "same.", "same.", "ünï!", "x" * 50]
    rows = [(c, t * rng.choice([1, 1, 3]), rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randrange(1, turns))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in (0, 1, None, 5)]
    rows += [(1000, None, "user", "a."), (1000, None, "user", "b."), (1000, None, "assistant", "a.")]
    rows += [(1001, 3, "user", "again.")] * 7 + [(1002, -(2**62), "user", "x. " * 20_000), (1002, 2**62, "assistant", "y")]
    return rows + rows[:5]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_equals_the_contract(spark, block):
    rows = sample()
    got = ar.repair_report(conversations(spark, rows), block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found, want = sorted(map(tuple, got.collect()), key=str), brute(rows)
    assert [r for r in found if r[0] != 1002] == [r for r in want if r[0] != 1002]
    far = [(f, w) for f, w in zip(found, want) if f[0] == 1002][0]
    assert far[0][2:] == far[1][2:] and far[0][1] == min(far[1][1], 2**63 - 1)


def test_empty_table_and_dropped_conversations(spark):
    assert ar.repair_report(conversations(spark, [])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    [row] = ar.repair_report(conversations(spark, [(gone, 0, "user", "Hello.")])).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_audits_against_all_audits():
    rng = random.Random(3)
    cases = [*itertools.product("suat", repeat=2)] + [rng.choices("suat", k=rng.randrange(4)) for _ in range(60)]
    letters = {"s": 0, "u": 1, "a": 2, "t": 3}
    for kinds in cases:
        faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in kinds]
        cost, audit, _ = exhaustive(kinds, faults)
        blocks = [ar.block_audits([letters[k]], [f], range(4)) for k, f in zip(kinds, faults)]
        joined = ar.joined_audit(blocks)
        assert (joined[0], joined[1].text()) == (cost, audit) == plain(kinds, faults)


def test_long_conversations_in_blocks_of_any_size():
    rng = random.Random(4)
    kinds = rng.choices(range(4), [1, 6, 5, 1], k=3000)
    faults = rng.choices(range(4), [8, 1, 1, 3], k=3000)
    want = plain(["suat"[k] for k in kinds], faults)
    for size in (7, 500, 3000):
        blocks = [ar.block_audits(kinds[i : i + size], faults[i : i + size], range(4)) for i in range(0, 3000, size)]
        cost, last = ar.joined_audit(blocks)
        assert (cost, last.text()) == want


def test_comparison_survives_colliding_hashes(monkeypatch):
    monkeypatch.setattr(ar, "_MOD", 2)
    rng = random.Random(5)
    for _ in range(300):
        node, texts = ar.Edits(None, ""), []
        for text in ("".join(rng.choices("DIKR", k=rng.randrange(1, 12))) for _ in range(2)):
            end = node
            for part in text:
                end = ar.Edits(end, part)
            texts.append((text, end))
        assert ar.less(texts[0][1], texts[1][1]) == (texts[0][0] < texts[1][0])


def test_one_conversation_in_many_ranges(spark):
    rows = [(5, i // 2, "user" if i % 3 else "assistant", f"line {i % 400}{'.' if i % 5 else ''}") for i in range(2000)]
    got = ar.repair_report(conversations(spark, rows), 64).collect()
    assert [tuple(r) for r in got] == brute(rows)
