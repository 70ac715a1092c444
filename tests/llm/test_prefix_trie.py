import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from bibweave.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), text or ""))
    own = {c: [(r, t, whole) for _, _, r, t, whole in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][2]) if node else 0)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in who if len(built[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((who[0], len(node), parent, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def some_rows(n_convs, n_texts, seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None, ""]), rng.choice([None, "", *["ä" * i for i in range(n_texts)]])) for c in range(n_convs) for t in range(rng.randrange(0, 7))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("case", ["mixed", "nulls", "chain", "root"])
def test_against_brute_force(spark, monkeypatch, case):
    """Shared openings, absent bases, turnless conversations; null turns, ties and repeats; a long chain; all ending at the root."""
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    if case == "mixed":
        rows = some_rows(230, 3, 1)
    elif case == "nulls":
        rows = [(7, None, "u", "b"), (7, None, "u", "a"), (7, None, "u", "a"), (7, 0, None, None), (7, 0, "", ""), (None, 1, "u", "lost"), (100, 1, "u", "a"), (100, 1, "u", "a"), (300, None, None, None)]
    elif case == "chain":
        monkeypatch.setattr(prefix_trie, "BLOCK", 4)
        rows = [(c, t, "u", f"{t}" if t < cut else f"{t} of {c}") for c, cut in ((200, 90), (500, 90), (700, 40), (800, 150)) for t in range(150)]
    else:
        rows = [(c, 0, "u", "x" * c) for c in range(101, 160)]
    conversations = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS depth", "3 AS size")
    assert got(prefix_trie.prefix_trie(conversations)) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chains_take_few_rounds(spark):
    """A chain of 300 nodes goes in about log2(300) rounds, not 300."""
    tree = spark.range(300).selectExpr("0L AS conv_id", "id AS depth", "IF(id > 0, 0L, NULL) AS parent_conv_id", "IF(id > 0, id - 1, NULL) AS parent_depth", "1L AS n")
    raked, spliced = prefix_trie.contract(tree, ("n",))
    assert len(raked) <= 12 and sum(s.count() for s in spliced) > 250


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op12_prefix_trie']})").fetchall()
    assert want and got(queries.op12_prefix_trie(spark, sf_dir)) == sorted(want, key=str)
