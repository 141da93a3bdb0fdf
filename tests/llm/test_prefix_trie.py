"""The trie against one built turn by turn, and the query against its SQL twin."""

import hashlib
import random
import zlib
from collections import defaultdict
from math import fmod

import duckdb
import pytest
from linefold.llm.oracles import ORACLES
from linefold.llm.prefix_trie import prefix_trie, short_digest, turn_rows
from linefold.llm.queries import op13_prefix_trie, rebuilt
from linefold.llm.store import stage

SF = "/root/testdata/sf0.001"
KINDS = "conv_id long, turn long, role string, text string, seg long, key string, depth int"


def plain_trie(convs):
    """Nodes by walking the tree; ``convs`` has the turns (role, text) of each id."""
    members, children = defaultdict(list), defaultdict(list)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, rows = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        own = len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * own + sum(saved[c] for c in children[node])
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def ordered_turns(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, short_digest(f"{len(role.encode())}:{role}{text}".encode()), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def plain_rebuilt(convs):
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - int(fmod(c, 5)), [])[: heads[c]] + convs[c][heads[c] :] for c in convs}


def random_rows(rng):
    rows = []
    for conv in range(-7, 30):
        if rng.random() < 0.2:
            continue
        for turn in range(rng.choice([0, 1, 3, 9, 40])):
            place = rng.choice([turn, turn, turn, None])
            rows.append((conv, place, rng.choice(["u", None]), rng.choice(["a", "a", "a", "bé", None]), 1, "k", 0))
    return [*rows, rows[0], (None, 1, "u", "x", 1, "k", 0)]


def collected(nodes):
    return sorted(map(tuple, nodes.collect()), key=repr)


@pytest.mark.parametrize(("seed", "block", "segment"), [(0, 1, 1), (1, 3, 2), (2, 4, 64)])
def test_random_conversations(spark, seed, block, segment):
    rows = random_rows(random.Random(seed))
    turns, convs = rebuilt(stage(turn_rows(spark.createDataFrame(rows, KINDS)), "turns"))
    assert collected(prefix_trie(turns, convs, block, segment)) == plain_trie(plain_rebuilt(ordered_turns(rows)))


def test_copies_and_one_long_conversation(spark):
    rows = [(c, t, "u", f"{t}", 1, "k", 0) for c in range(300) for t in range(3)]
    rows += [(999, t, "u", "same" if t % 7 else f"{t}", 1, "k", 0) for t in range(3000)]
    turns = stage(turn_rows(spark.createDataFrame(rows, KINDS)), "turns")
    got = collected(prefix_trie(turns, turns.select("conv_id").distinct(), 2, 4))
    assert got == plain_trie(ordered_turns(rows))


def test_no_conversations(spark):
    turns, convs = rebuilt(turn_rows(spark.createDataFrame([], KINDS)))
    assert prefix_trie(turns, convs).collect() == []


def test_query_and_twin(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = op13_prefix_trie(spark, SF)
    result = con.execute(ORACLES["op13_prefix_trie"])
    assert [d[0] for d in result.description] == got.columns
    theirs = sorted(result.fetchall(), key=repr)
    assert collected(got) == theirs
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert theirs == plain_trie(plain_rebuilt(ordered_turns(rows)))
