"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidelog.llm import conversations
from tidelog.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPACE = " \t\n\x0b\x0c\r"
GIVEN = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else text
        text = text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """Every node's cheapest (cost, letters) from the end on, one row after the other."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        first = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        faults.append(first)
        seen.add((role, text))

    def inserted(best):
        for _ in range(4):
            for q in range(4):
                if best[GIVEN[q]] is not None:
                    cost, letters = best[GIVEN[q]]
                    best[q] = min(x for x in (best[q], (cost + 5, "I" + letters)) if x is not None)
        return best

    best = inserted([(0, ""), None, None, (0, "")])
    for (_, role, _), fault in zip(rows[::-1], faults[::-1]):
        now = []
        for q in range(4):
            options = [(best[q][0] + 2, "D" + best[q][1])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if (q, role[:1]) in KEPT:
                    cost, letters = best[KEPT[q, role[:1]]]
                    options.append((cost + more, "K" + letters))
                cost, letters = best[GIVEN[q]]
                options.append((cost + more + 1, "R" + letters))
            now.append(min(options))
        best = inserted(now)
    cost, audit = best[0]
    state, at, left = 0, 0, []
    for letter in audit:
        given = "assistant" if state == 2 else "user"
        if letter == "I":
            left.append((given, ""))
            state = GIVEN[state]
            continue
        _, role, text = rows[at]
        at += 1
        if letter == "K":
            left.append((role, text))
            state = KEPT[state, role[:1]]
        elif letter == "R":
            left.append((given, text))
            state = GIVEN[state]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, digest), left


def random_rows(seed, conversations_, longest):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "cut off", "", " ", None, "a.", "b?", "And so on.", "tail \n", "Ja. ", "d!", "e.", "f."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool"]
    rows = []
    for conv in [None, *range(conversations_)]:
        for turn in range(int(rng.integers(1, longest))):
            at = None if rng.random() < 0.1 else turn - int(rng.random() < 0.1)
            role = roles[int(rng.integers(7))] if rng.random() < 0.5 else roles[turn % 2]
            text = texts[int(rng.integers(14))] if rng.random() < 0.5 else f"t{turn}."
            rows.append((conv, at, role, text))
    return rows


def as_table(spark, rows):
    extra = [(*r, 1, "x") for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, pos long, segment string")


def values(row):
    return tuple(row)[1:9]


@pytest.mark.parametrize("short, segment", [(1000, 512), (8, 3)])
def test_repair_equals_search(spark, short, segment):
    rows = random_rows(short, 60, 30)
    rows += [(777, k % 5, "user", "same.") for k in range(400)] + [(778, None, "user", "x.")] * 50
    want = {c: plain(r) for c, r in damage(rows).items() if r}
    table = conversations.damaged(as_table(spark, rows))
    found = {r.conv_id: values(r) for r in conversations.repair_conversations(table, short, segment).collect()}
    assert found == {c: w[0] for c, w in want.items()}
    left = defaultdict(list)
    for r in sorted(conversations.repaired_messages(table, short, segment).collect(), key=lambda r: r.position):
        left[r.conv_id].append((r.role, r.text))
    assert left == {c: w[1] for c, w in want.items() if w[1]}


def test_costs_of_a_segment_add_up():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cells = [
            (bool(rng.random() < 0.2), "suax"[int(rng.integers(4))], bool(rng.random() < 0.3), int(rng.integers(1, 4)))
            for _ in range(int(rng.integers(2, 12)))
        ]
        cut = int(rng.integers(1, len(cells)))
        lattice = conversations.Lattice(cells, conversations._ENDS, True)
        whole = [lattice.auction(s) for s in range(4)]
        ends = [0, 10, 5, 0]
        for part in (cells[cut:], cells[:cut]):
            costs = conversations.segment_costs(part)
            ends = [min(c + e for c, e in zip(own, ends) if c is not None) for own in costs]
        assert whole == ends


def test_query_whole_table(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("benchmark tables not here")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: values(r) for r in QUERIES["op11_conversation_repair"](spark, SF_DIR).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found == {c: plain(r)[0] if r else nothing for c, r in damage(rows).items()}


def test_no_rows(spark):
    empty = as_table(spark, [])
    assert conversations.repair_conversations(empty).collect() == []
    assert conversations.repaired_messages(empty).collect() == []
