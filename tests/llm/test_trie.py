"""The conversation trie against a direct construction, list ranking on its own, and border cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from spatialframe.functions.durable import Scratch
from spatialframe.llm import trie

TURN = "conv_id long, turn long, role string, text string, node string, d string, c string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURN)


def direct(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [v[1:] for v in sorted(rows)] for c, rows in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[k] for k in kids[seq]) or 1
        saved[seq] = sum(saved[k] for k in kids[seq]) + (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0)
    ends = lambda seq: ",".join(map(str, sorted(c for c in members[seq] if full[c] == seq)))
    return sorted(str((min(m), len(seq), min(members[seq[:-1]]) if seq else None, len(m), len(kids[seq]), leaves[seq], saved[seq], hashlib.sha256(ends(seq).encode()).hexdigest()))
                  for seq, m in members.items())


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    says = ["yes", "no", "perhaps", "Ü", "", None]
    some = [(int(c), int(t), ["user", "assistant", None][t % 3], says[int(r.integers(0, 6))]) for c in [*range(0, 40), *range(100, 130), 250, 251, -3, -205, -200] for t in range(int(r.integers(1, 9)))]
    some += [(300, 0, "a", "x"), (302, 0, "a", "x")] + [(c, 0, "q", "alone") for c in range(401, 421)]            # turnless ones among them
    some += [(None, 1, "user", "nobody"), (500, None, "user", "b"), (500, None, "user", "a"), (500, None, None, None), (500, 1, "user", "a"), (500, 1, "assistant", "a")]
    some += [(600, 5, "user", "again")] * 70 + [(601, 5, "user", "again")] * 70                                  # equal rows
    some += [(700, t, "user", f"turn {t}") for t in range(900)] + [(701, t, "user", f"turn {t}" if t < 500 else "other") for t in range(700)]      # long
    return some


@pytest.mark.parametrize("walk,block,copies", [(trie.WALK, trie.BLOCK, trie.COPIES), (20, 16, 9)])
def test_trie_is_the_direct_one(spark, rows, monkeypatch, walk, block, copies):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "COPIES", copies)
    got = trie.build_trie(frame(spark, rows).repartition(3), walk).collect()
    assert sorted(str(tuple(r)) for r in got) == direct(rows)


@pytest.mark.parametrize("n,walk", [(1, 1), (2, 1), (500, 3)])
def test_list_ranking(spark, n, walk):
    order = np.random.default_rng(n).permutation(n * 3)[:n].tolist()
    arcs = [(a, order[i - 1] if i else None, order[i + 1] if i + 1 < n else None) for i, a in enumerate(order)]
    scratch = Scratch(spark)
    got = {r["arc"]: r["place"] for r in trie.list_ranks(spark.createDataFrame(arcs, "arc long, prev long, next long"), scratch, walk).collect()}
    scratch.close()
    assert got == {a: i for i, a in enumerate(order)}


def test_one_hot_end_is_one_stream(spark):
    rows = [(c, 0, "u", "t") for c in range(1000, 3000) if zlib.crc32(str(c).encode()) % 6 == 0]
    got = {r["depth"]: r for r in trie.build_trie(frame(spark, rows)).collect()}
    ids = ",".join(str(r[0]) for r in rows)
    assert got[1]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and got[0]["ends_sha256"] == trie.EMPTY and got[1]["saved_tokens"] == len(rows) - 1


def test_no_conversations(spark):
    assert trie.build_trie(frame(spark, [])).count() == 0
    assert trie.build_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
