"""The prefix trie against nodes counted one by one, with small and large buckets."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tideflow.llm import turn_trie

KIND = "conv_id long, turn long, role string, text string, id string, words string, turns string, ids string, n string, node string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in convs.items()}
    sign = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    members, children = defaultdict(list), defaultdict(set)
    ends = defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(sign(c), [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[: d - 1]].add(seq[:d])
        ends[seq].append(c)
    tokens = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * tokens(p)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def sample():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(-45, 260):
        for t in range(int(rng.integers(1, 7))):
            common = rng.random() < 0.7
            rows.append((c, t, "user" if t % 2 else "assistant", "hello there" if common else f"word{rng.integers(0, 4)} and\x0bmore\t words"))
    rows += [(1000 + c, t, "user", f"copy turn {t}") for c in range(150) for t in range(4)]  # a third are copies
    rows += [(2000, None, None, None), (2000, 3, "user", "x"), (2000, 3, "user", "x"), (2000, 3, None, "a"), (2001, 0, "", ""), (2003, None, "system", " \n"), (None, 0, "user", "no conversation"), (2004, 9, "user", "wörd " * 3000), (2004, -1, "user", "é")]
    rows += [(3000 + c, t, "user", "deep") for c in (0, 40, 81) for t in range(60)]  # one line of many turns
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], KIND).repartition(6)


@pytest.mark.parametrize("local", [1, 40, turn_trie.LOCAL_TURNS])
def test_nodes_equal_brute_force(spark, local, monkeypatch):
    monkeypatch.setattr(turn_trie, "CHUNK", 16)
    rows = sample()
    if local == 1:
        rows = [r for r in rows if r[0] is None or r[0] < 3000]
    got = Counter(tuple(r) for r in turn_trie.prefix_trie(table(spark, rows), local).collect())
    assert got == brute(rows)


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        got = turn_trie.prefix_trie(table(spark, rows))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"] and got.count() == 0


def test_turnless_conversations_make_a_root(spark):
    rows = [(c, 0, "user", "x") for c in range(21, 40)]  # no first of the family
    got = turn_trie.prefix_trie(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute(rows) and any(r["depth"] == 0 for r in got)


def test_multikey_quicksort_orders_siblings():
    rng = np.random.default_rng(4)
    items = {tuple(int(x) for x in rng.integers(0, 3, rng.integers(0, 6))) for _ in range(200)}
    items = [(list(s), [1] * len(s), k, 1, f"e{k}") for k, s in enumerate(items)]
    nodes = turn_trie.multikey_nodes(items, 0, -1)
    prefixes = {tuple(i[0][:d]) for i in items for d in range(len(i[0]) + 1)}
    assert len(nodes) == len(prefixes) and nodes[0][3] == len(items)
    assert sum(n[4] for n in nodes) == len(nodes) - 1 and nodes[0][5] == sum(n[4] == 0 for n in nodes)
