from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tenderscope.llm.prefix_trie import trie
from tenderscope.llm.q_conversations import rebuild

TURNS = "conv_id long, turn long, role string, text string, words string, path string, g string"


def brute(rows, family=20):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % family) * (1 if c >= 0 else -1)
        built[c] = own.get(first, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    total = {}
    for k in sorted(members, key=len, reverse=True):
        w = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves = sum(total[x][0] for x in kids[k]) if kids[k] else 1
        total[k] = leaves, (len(members[k]) - 1) * w + sum(total[x][1] for x in kids[k])
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), len(kids[k]), *total[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def answer(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "w", "p", "g") for r in rows], TURNS).repartition(3)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    return sorted((tuple(r[n] for n in names) for r in trie(rebuild(df), **sizes).collect()), key=repr)


def odd_rows(seed, convs, deepest=6):
    r = random.Random(seed)
    texts = ["hi there", "a  b\tc", "", None, "é ü\x0bx", "long " * 400]
    rows = []
    for c in r.sample(range(-40, 4 * convs), convs):
        if c % 3 == 0:  # many with the same turns
            rows += [(c, t, "user", "hi there") for t in range(1 + c % 2)]
            continue
        for _ in range(r.randint(1, deepest)):
            rows.append((c, r.choice([None, 0, 1, 2, 3, 3]), r.choice(["user", "assistant", None]), r.choice(texts)))
    rows += rows[:10]  # repeated rows
    rows += [(None, 0, "user", "nobody"), (5000, None, None, None)]
    return rows


@pytest.mark.parametrize("group_turns", [3, 1 << 20])
def test_against_brute_force_at_every_group_size(spark, group_turns):
    rows = odd_rows(group_turns, 120)
    assert answer(spark, rows, group_turns=group_turns) == brute(rows)


def test_a_shared_first_turn_and_a_conversation_logged_at_each_turn(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 3 else f"{c} {t}") for c in range(0, 400, 20) for t in range(5)]
    rows += [(1000 + 20 * n, t, "user", f"grow {t}") for n in range(30) for t in range(n)]
    assert answer(spark, rows, group_turns=20) == brute(rows)


def test_ids_of_a_node_run_over_several_ranges(spark):
    rows = [(c, 0, "user", "same") for c in [*range(-20, 6000, 100), 10**12, -(10**12), 2**62]]
    assert answer(spark, rows) == brute(rows)


def test_empty_table_and_conversations_without_turns(spark):
    assert answer(spark, []) == []
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    assert answer(spark, [(lone, 0, "user", "gone")]) == brute([(lone, 0, "user", "gone")])


def test_registered_query_agrees_with_brute_force(spark, data):
    import pandas as pd

    from tenderscope.llm.catalog import QUERIES

    rows = [tuple(r) for r in pd.read_parquet(f"{data}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    got = QUERIES["op13_prefix_trie"](spark, data).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
