"""Importance resampling against direct counting, and its border cases."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from spatialframe.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, n_words string, text string, weight string, `index` string"


def direct(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), Counter(" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))


def brute(docs, target, percent, min_words, buckets):
    s, t = np.zeros(buckets), np.zeros(buckets)
    at = lambda f: zlib.crc32(f.encode()) % buckets
    for side, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f, n in direct(text)[1].items():
                side[at(f)] += n
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, f = direct(text)
        weight = sum(c * gain[at(x)] for x, c in f.items())
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("piece,gather", [(1 << 20, 100_000), (7, 5), (40, 3)])
def test_features_of_pieces_are_those_of_the_text(monkeypatch, piece, gather):
    monkeypatch.setattr(importance, "PIECE", piece)
    monkeypatch.setattr(importance, "GATHER", gather)
    texts = ["The cat, the CAT: the cat sat", "", None, " \t ", "Éa éB ÇÇ 12 a1", "x" * 200 + " y " + "z" * 50, "one", " " + "w" * 30 + " v", "a\u0000b c d"]
    got, counts = [Counter() for _ in texts], None
    for owner, found in importance.features([None if t is None else t.encode() for t in texts]):
        if found is None:
            counts = owner
        else:
            for i, b in zip(owner.tolist(), found.tolist()):
                got[i][b] += 1
    for i, t in enumerate(texts):
        n, f = direct(t)
        want = Counter()
        for x, c in f.items():
            want[zlib.crc32(x.encode()) % importance.BUCKETS] += c
        assert got[i] == want and counts[i] == n


def test_crc_of_every_length():
    r = np.random.default_rng(5)
    sizes = np.concatenate([np.arange(0, 70), [importance.LONG + 1, 300, 300]])
    data = r.integers(0, 256, int(sizes.sum())).astype(np.uint8)
    start = np.cumsum(sizes) - sizes
    got = importance.crc_by_length(data, start, sizes)
    assert got.tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(start, sizes)]


def test_resample_is_the_direct_count(spark):
    r = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(vocabulary[i] for i in r.integers(0, 60, n))
    docs = [(i, text(int(r.integers(0, 60)))) for i in range(120)]
    docs += [(None, text(30)), (None, None), (7, docs[7][1]), (7, docs[7][1]), (500, ""), (501, "?!"), (502, "Ä" + text(20_000))]
    target = [text(40) for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame([(i, "q", t, "q", "q") for i, t in docs], DOC)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(frame, bench, percent=30, min_words=20, buckets=97).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs, target, 30, 20, 97)
    again = importance.resample(frame.repartition(3), bench.repartition(2), percent=30, min_words=20, buckets=97).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "q", "a b c " * 10, "q", "q")], DOC)
    got = importance.resample(one, bench, percent=100).collect()
    assert len(got) == 1 and got[0]["rank"] == 1 and got[0]["n_features"] == 87
