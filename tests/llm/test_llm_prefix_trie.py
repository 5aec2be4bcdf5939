"""The conversation trie against one built of dictionaries."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from cases import CLASHING, SMALL

from matchgrain.llm import prefix_sums, prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if whole[c] == p) for p, m in members.items()}
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, *(("x",) * len(CLASHING))) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


def messy():
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c % 7}") for c in range(0, 260, 3) for t in range(c % 9)]
    rows += [(100, None, "user", "before all"), (100, None, None, "and this"), (105, 0, None, None), (105, 1, "", ""), (106, 5, "a", "b:c"), (106, 5, "a:b", "c"), (107, 1, "r", None)]
    rows += [(None, 0, "user", "lost"), (None, None, None, None), (400, 0, "user", "alone"), (400, 0, "user", "alone"), (501, 0, "Ü", "日本語"), (502, 0, "Ü", "日本語"), (599, 1, "u", "x" * 50_000)]
    rows += [(700 + i, t, "user", f"copy {t}") for i in range(90) for t in range(6)]  # one group of copies
    return rows + [(900, t, "user", "long") for t in range(700)] + [(901, t, "user", "long") for t in range(650)]


def small():
    return duckdb.sql(f"select conv_id, turn, role, text from read_parquet('{SMALL}/conversations.parquet')").fetchall()


@pytest.mark.parametrize("rows", [messy(), small(), [], [(None, 1, "a", "b")], [(7, 0, None, None)]], ids=["messy", "small", "empty", "no ids", "one"])
def test_as_by_dictionaries(spark, rows):
    nodes = prefix_trie.prefix_trie(prefix_trie.share_openings(prefix_trie.conversation_paths(frame(spark, rows))))
    assert Counter(tuple(r) for r in nodes.select(*COLUMNS).collect()) == plain(rows)


def test_intervals_nest_and_hold_the_subtree(spark):
    nodes = prefix_trie.prefix_trie(prefix_trie.share_openings(prefix_trie.conversation_paths(frame(spark, messy())))).orderBy("position").collect()
    assert [n["position"] for n in nodes] == list(range(len(nodes)))
    open_ends = []
    for n in nodes:
        while len(open_ends) > n["depth"]:
            open_ends.pop()
        assert len(open_ends) == n["depth"] and (not open_ends or n["subtree_end"] <= open_ends[-1])
        open_ends.append(n["subtree_end"])
        inside = nodes[n["position"] : n["subtree_end"] + 1]
        assert n["n_leaves"] == sum(not x["n_children"] for x in inside)
        assert all(x["depth"] > n["depth"] for x in inside[1:]) and (n["subtree_end"] + 1 == len(nodes) or nodes[n["subtree_end"] + 1]["depth"] <= n["depth"])


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_digests_whatever_the_blocks(spark, block):
    rows = [(b"k%d" % (c % 3), c) for c in range(-5, 200)]
    got = {bytes(r["key"]): r["ends_sha256"] for r in prefix_trie.ends_digest(spark.createDataFrame(rows, "key binary, conv_id long").repartition(5), block).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c) for _, c in sorted(rows) if _ == k).encode()).hexdigest() for k in {k for k, _ in rows}}


def test_running_sums(spark):
    rows = [(i % 17, i, None if i % 5 == 0 else i) for i in range(500)]
    got = prefix_sums.running(spark.createDataFrame(rows, "a long, b long, v long").repartition(7), ["a", "b"], {"at": "v"}).collect()
    total = 0
    for (a, b, v), r in zip(sorted(rows, key=lambda r: r[:2]), sorted(got, key=lambda r: (r["a"], r["b"])), strict=True):
        assert (r["a"], r["b"], r["v"], r["at"]) == (a, b, v, total)
        total += v or 0
