"""The prefix trie against brute force over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tapewright.llm import conversation_trie, queries


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[n] for n in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[n] for n in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*conversation_trie.COLUMNS).collect()), key=repr)


def made(seed=2):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "lost"), (7, 0, None, None), (7, 1, "user", ""), (7, 2, "", "a b"), (9, None, "user", "first"), (9, 0, "user", "second"),
            (41, 0, "user", "x"), (40, 0, "user", "y z"), (40, 1, "user", "y z"), (45, 3, "user", "q"), (45, 3, "user", "q")]
    for c in range(100, 400):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 3)))))
    for c in range(1000, 1200):  # copies of one conversation
        rows += [(c, t, "user", f"same {t}") for t in range(5)]
    for c in range(1300, 1310):  # very long ones with a common beginning
        rows += [(c, t, "user", f"step {t}" if t < 300 + c else f"own {c} {t}") for t in range(300 + c + 3)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block, fan", [(100_000, 256), (40, 2), (7, 3)])
def test_equals_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(conversation_trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    rows = made()
    if block == 7:
        rows = [r for r in rows if r[0] is None or r[0] < 1000]
    df = spark.createDataFrame([(*r, b"x") for r in rows], SCHEMA + ", key binary").withColumnRenamed("key", "codes")
    assert got(conversation_trie.prefix_trie(df)) == brute(rows)


def test_small_tables(spark):
    assert got(conversation_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = [(3, 0, "user", "only one")]
    assert got(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert got(conversation_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA))) == []


def test_siblings_are_balanced():
    tree = conversation_trie.TernaryTree()
    tree.insert_sorted([([i], [1], [i]) for i in range(1023)])

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.first[0]) == 10


def test_query_over_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_trie(spark, sf)) == brute(rows)
