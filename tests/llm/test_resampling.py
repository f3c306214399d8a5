"""op11: importance weights and the exact draw against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from hirecube.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feats(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, items, buckets=resampling.BUCKETS):
    def counts(texts):
        c = Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in feats(t)[1])
        return c, sum(c.values())
    s, S = counts([t for _, t in docs])
    t, T = counts([x for x in items])
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (S + buckets)) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        w, f = feats(text)
        total = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        weight = total // len(f) if f else 0
        if doc_id is None:
            score = None
        else:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = int(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        out.append([doc_id, len(f), weight, score, len(w), zlib.crc32((text or "").encode())])
    eligible = [r for r in out if r[3] is not None and r[4] >= 20]
    k = 25 * len(eligible) // 100
    ranked = sorted(eligible, key=lambda r: (-r[3], r[0]))[:k]
    for i, r in enumerate(ranked):
        r.append(i + 1)
    return sorted((tuple(r[:4]) + ((r[6],) if len(r) > 6 else (None,)) for r in out), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(50)] + ["Ünï", "naïve"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (None, "v1 " * 30), (402, "X" * 30000), (403, "v1 v2 " * 5000)]
    items = [" ".join(rng.choice(vocab[:10]) for _ in range(30)) for _ in range(12)] + [None]
    return docs, items


def test_weights_scores_and_ranks(spark, tables):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(d, b).collect()), key=repr)
    assert got == plain(docs, items)


def test_cutoff_is_exact_for_every_k(spark):
    rng = random.Random(2)
    keys = [(rng.randrange(-5, 5), rng.randrange(0, 50), rng.randrange(0, 3)) for _ in range(200)]
    frame = spark.createDataFrame(keys, "score long, doc_id long, tie long").repartition(5)
    ordered = sorted(keys, key=lambda k: (-k[0], k[1], k[2]))
    for k in (1, 2, 37, 100, 199, 200):
        assert resampling.cutoff(frame, k) == ordered[k - 1]


def test_empty_and_clashing(spark, tables):
    docs, items = tables
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank long, _b long")
    b = spark.createDataFrame([], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(d, b).collect()), key=repr)
    assert got == plain(docs, [])
    assert resampling.resample(spark.createDataFrame([], "doc_id long, text string"), b).count() == 0
