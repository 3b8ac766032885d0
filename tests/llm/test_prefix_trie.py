"""The burst trie against a plain trie of all beginnings."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest

from jobtide.llm import prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string, key string, words string, n int, pos int"


def rebuilt(rows):
    """Every conversation's turns after its beginning is lent by the first one of its family."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def plain(conversations):
    """One tuple per node: smallest conversation, depth, parent, conversations, children, leaves, saved words, ends."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, own in members.items():
        cost = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += cost
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(conversations[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "w", 1, 2) for r in rows], TURNS)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def talk(seed, convs, most, hot=0.4):
    """Conversations over few texts, many of which share a long beginning or are copies."""
    random.seed(seed)
    texts = ["", "hi", "hello there", "a\tb  c", "é è", "yes yes yes", None]
    start = [(random.choice(["user", "assistant", None]), random.choice(texts)) for _ in range(most)]
    rows = []
    for c in random.sample(range(-30, 4 * convs), convs):
        n = random.randint(1, most)
        same = random.randint(0, n) if random.random() < hot else 0
        turns = start[:same] + [(random.choice(["user", "assistant"]), random.choice(texts)) for _ in range(n - same)]
        rows += [(c, t if t % 5 else None if t == 0 else t, *x) for t, x in enumerate(turns)]
    rows += [(c, 1, "user", "hi") for c in (2001, 2002, 2003, 2021, 2040)] + [(2040, 1, "user", "hi"), (2040, 1, None, "a"), (None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize(
    ("seed", "convs", "most", "limit", "section", "ahead"),
    [(1, 60, 6, 100_000, 4096, 32), (2, 80, 6, 8, 4096, 1), (3, 80, 14, 10, 4096, 2), (4, 50, 14, 12, 5, 2), (5, 50, 9, 100_000, 4, 32), (6, 60, 5, 0, 1, 4)],
)
def test_nodes_equal_a_plain_trie(spark, seed, convs, most, limit, section, ahead):
    rows = talk(seed, convs, most)
    turns = prefix_trie.lent_beginnings(prefix_trie.ordered_turns(table(spark, rows)))
    assert found(prefix_trie.trie(turns, limit, section, ahead)) == plain(rebuilt(rows))


def test_copies_and_long_conversations(spark):
    """A very common conversation and one of many turns; nobody shares the latter's end."""
    rows = [(i, t, "user", f"w{t} x") for i in range(0, 2000, 20) for t in range(3)]
    rows += [(5000, t, "user", f"long {t}") for t in range(300)] + [(5020, t, "user", f"long {t if t < 250 else -t}") for t in range(300)]
    turns = prefix_trie.lent_beginnings(prefix_trie.ordered_turns(table(spark, rows)))
    want = plain(rebuilt(rows))
    assert found(prefix_trie.trie(turns, 50, 64, 8)) == want
    assert found(prefix_trie.trie(turns)) == want


def test_conversations_left_without_turns(spark):
    rows = [(c, 0, "user", "hi") for c in range(1, 20)]
    turns = prefix_trie.lent_beginnings(prefix_trie.ordered_turns(table(spark, rows)))
    want = plain(rebuilt(rows))
    assert any(r[1] == 0 and r[7] != prefix_trie.EMPTY for r in want)
    assert found(prefix_trie.trie(turns)) == want
    gone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    turns = prefix_trie.lent_beginnings(prefix_trie.ordered_turns(table(spark, [r for r in rows if r[0] in gone])))
    assert [r[1:3] + r[4:7] for r in found(prefix_trie.trie(turns))] == [(0, None, 0, 1, 0)]


def test_empty_table(spark):
    empty = table(spark, [])
    assert prefix_trie.trie(prefix_trie.lent_beginnings(prefix_trie.ordered_turns(empty))).count() == 0
    assert prefix_trie.trie(prefix_trie.lent_beginnings(prefix_trie.ordered_turns(table(spark, [(None, 1, "user", "x")])))).count() == 0


def test_ids_of_many_copies_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 7)
    ids = random.sample(range(100_000), 200)
    df = spark.createDataFrame([(i, "a") for i in ids] + [(5, "b")], "conv_id long, sid string").repartition(5)
    want = {"a": ",".join(map(str, sorted(ids))), "b": "5"}
    assert dict(map(tuple, prefix_trie._ends(df).collect())) == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_query_equals_its_sql_and_a_plain_trie(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = found(queries.op12_burst_trie(spark, sf_dir))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == plain(rebuilt(rows))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
        assert got == sorted(db.sql(queries.SQL["op12_burst_trie"]).fetchall(), key=str)
