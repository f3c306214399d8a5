"""Each operator against a plain version, and the cases that its docstring defines."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hirecube.llm import (
    fingerprints, impact_search, kneser_ney, language_id, mixing, near_dups, packing, simple8b, token_counts, token_files, tokens,
    toxicity, words,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, h long, node long, part long"
GAP = re.compile("[ \t-\r]+")


def plain_words(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w for w in GAP.split((text or "").translate(table)) if w]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "naïve", "Don't", "x y", "日本"]
    def text(n):
        return " ".join(rng.choice(vocab, n))
    out = []
    for i in range(60):
        out.append((i, text(int(rng.integers(0, 40))), ["en", "de", None][i % 3], ["a", "b", "c", None][min(i % 7, 3)]))
    base = text(60)
    out += [(100, base, "en", "a"), (101, base, "en", "b"), (102, base + " tail", "en", "a"), (103, base.upper(), "de", "a")]
    out += [(104, None, "en", "a"), (105, "", None, None), (106, " \t\n ", "en", "b"), (107, "12 34 !!", "en", "b")]
    out += [(108, "one two", "en", "a"), (109, "ONE  two", "en", "a"), (None, base, "en", None), (None, None, None, None)]
    out += [(110, text(3000), "en", "a"), (111, "long" * 5000, "en", "a"), (100, base, "en", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(*r, len(r[1] or ""), 1, 0.5, 2, 3, 4) for r in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(frame):
    return [r.asDict() for r in frame.collect()]


def test_words_are_those_of_the_plain_version(rows):
    texts = pa.array([r[1] for r in rows])
    got = []
    for _, data, offsets in words.chunks(texts, 500):
        data = words.LOWER[data]
        starts, ends, before = words.spans(data, offsets)
        raw = data.tobytes()
        for a, b in zip(before[:-1], before[1:]):
            got.append([raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])])
    assert got == [plain_words(r[1]) for r in rows]


# 1

def plain_scores(rows, held):
    train = [plain_words(t) + [None] for (i, t, *_), h in zip(rows, held) if not h]
    raw = Counter(w for s in train for w in s)
    pair = Counter((v, w) for s in train for v, w in zip(["<b>", *s], s))
    left, follow = Counter(w for _, w in pair), defaultdict(list)
    for (v, _), c in pair.items():
        follow[v].append(c)
    n, size = sum(raw.values()), len(raw)
    cut = lambda x: kneser_ney.discounts([sum(c == k for c in x) for k in (1, 2, 3, 4)])
    d, e = cut(pair.values()), cut(left.values())
    off = lambda c, x: 0 if c == 0 else x[min(c, 3) - 1]
    whole = sum(left.values())
    spare = sum(off(c, e) for c in left.values())
    out = []
    for _, t, *_ in rows:
        s, total, base = plain_words(t) + [None], 0.0, 0.0
        for v, w in zip(["<b>", *s], s):
            p = (max(left[w] - off(left[w], e), 0) + spare / (size + 1)) / whole if whole else 1 / (size + 1)
            if follow[v]:
                c = pair[v, w]
                p = (max(c - off(c, d), 0) + sum(off(x, d) for x in follow[v]) * p) / sum(follow[v])
            total += math.log10(p)
            base += math.log10((raw[w] + 1) / (n + size + 1))
        out.append((len(s), sum(raw[w] > 0 for w in s), n, base, total))
    return out


def test_kneser_ney(docs, rows, spark):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    got = collect(kneser_ney.score_held_out(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2))
    order = lambda x: repr((x[0] is None, x[0], x[2], round(x[5], 6)))
    want = sorted(((r[0], h, *s) for r, h, s in zip(rows, held, plain_scores(rows, held))), key=order)
    got = sorted(((g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], g["base_score"], g["score"]) for g in got), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_kneser_ney_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b b c", "a", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = kneser_ney.train(frame)
    hashes = np.concatenate([h for _, h, _ in kneser_ney.sequences(pa.array(["a b c zzz"]))])  # and the end
    for context in range(4):
        ps = []
        for w in hashes:
            pair = model.score(np.array([hashes[context], w]), np.array([0, 2]))["score"][0]
            ps.append(10 ** (pair - model.score(hashes[context:context + 1], np.array([0, 1]))["score"][0]))
        assert sum(ps) == pytest.approx(1.0)


def test_kneser_ney_without_training_rows(docs, empty):
    assert {r["score"] for r in collect(kneser_ney.score_held_out(docs, F.lit(True)))} == {0.0}
    assert collect(kneser_ney.score_held_out(empty, F.lit(False))) == []


def test_kneser_ney_merges_one_part_of_one_shard_at_a_time(docs, rows, spark, monkeypatch):
    merge = kneser_ney.merge_pairs

    def alone(batches, folder):  # a task that gets several shards fails
        def watched():
            seen = set()
            for b in batches:
                seen |= set(b.column("shard").to_pylist())
                assert len(seen) < 2, seen
                yield b
        return merge(watched(), folder)

    for name, value in (("merge_pairs", alone), ("SHARD_TOKENS", 300), ("SHARD_WORDS", 20), ("GROUP_TOKENS", 400)):
        monkeypatch.setattr(kneser_ney, name, value)
    model = kneser_ney.train(docs.select("text"))
    assert model.pair_bits >= 4 and model.vocab_bits >= 2
    got = collect(kneser_ney.score(docs, model, ["doc_id"]))
    want = plain_scores(rows, [False] * len(rows))
    order = lambda x: repr((x[0], round(x[2], 6)))
    got = sorted(((g["n_tokens"], g["n_known"], g["score"], g["base_score"]) for g in got), key=order)
    want = sorted(((n, k, score, base) for n, k, _, base, score in want), key=order)
    assert np.allclose(got, want, rtol=1e-9)


def test_kneser_ney_merge_holds_a_part(tmp_path):
    rng = np.random.default_rng(8)
    packed = np.unique(rng.integers(0, 50, 3000) << 32 | rng.integers(0, 50, 3000))
    whole = kneser_ney.pair_rows(packed, rng.integers(1, 400, len(packed)), 1)
    assert len(whole) == 2 << kneser_ney.PART_BITS
    read = []

    def batches():
        for i in range(len(whole)):
            read.append(i)
            yield whole.slice(i, 1)

    out = kneser_ney.merge_pairs(batches(), str(tmp_path))
    first = next(out)
    assert read == [0, 1]  # the second batch tells that the first part has ended
    known = pa.Table.from_batches([first, *out]).to_pandas().query("kind == 0").groupby("id")["a"].sum()
    assert known.to_dict() == Counter((packed & 0xFFFFFFFF).tolist())
    keys = [np.load(tmp_path / f"pair-{s:06d}.npy") for s in range(2)]
    assert np.array_equal(np.concatenate(keys), np.sort(words.combine((packed >> 32).astype("u8"), (packed & 0xFFFFFFFF).astype("u8"))))
    large = np.load(tmp_path / "pair_large-000001.npy")
    assert np.array_equal(large[0], np.flatnonzero(np.load(tmp_path / "pair_count-000001.npy") == 255)) and (large[1] >= 255).all()


# 2

def plain_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = plain_words(t)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        k = find(i)
        best[k] = min(best.get(k, math.inf), math.inf if r[0] is None else r[0])
    return [(r[0], len(s), None if best[find(i)] == math.inf else best[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))]


def test_near_duplicates(docs, rows, empty):
    got = collect(near_dups.near_duplicates(docs))
    assert sorted(((g["doc_id"], g["n_shingles"], g["component_id"]) for g in got), key=repr) == sorted(plain_components(rows), key=repr)
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got)
    assert collect(near_dups.near_duplicates(empty)) == []


def test_near_duplicates_of_a_star_and_a_hot_group(spark):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    made = []
    for i in range(150):  # each copy is near the base, copies are less near one another
        w = list(base)
        for p in rng.choice(120, int(rng.integers(1, 4)), replace=False):
            w[p] = f"e{i}x{p}"
        made.append((i + 1000, " ".join(w), "", ""))
    made.append((5000, " ".join(base), "", ""))
    frame = spark.createDataFrame([(r[0], r[1]) for r in made], "doc_id long, text string")
    got = {g["doc_id"]: g["component_id"] for g in collect(near_dups.near_duplicates(frame))}
    assert got == {d: c for d, _, c in plain_components(made)}


def test_near_duplicates_meet_in_buckets_without_full_sets(spark, monkeypatch):
    rng = np.random.default_rng(12)
    common = [f"t{i}" for i in range(100)]
    made = []
    for i in range(40):  # families of one common text: members are near each other, families are not
        own = [*common, *(f"f{i % 8}x{j}" for j in range(27))]
        own[int(rng.integers(0, 100))] = f"e{i}"
        made.append((i, " ".join(own), "", ""))
    seen, rows = [], []
    keep = near_dups.checkpoint

    def watched(frame):
        seen.append(frame.columns)
        out = keep(frame)
        if "key" in frame.columns and "outside" in frame.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(near_dups, "checkpoint", watched)
    frame = spark.createDataFrame([(r[0], r[1]) for r in made], "doc_id long, text string")
    got = {g["doc_id"]: g["component_id"] for g in collect(near_dups.near_duplicates(frame))}
    assert got == {d: c for d, _, c in plain_components(made)}
    assert rows and rows[0] > 0  # buckets stayed open
    assert not any("key" in c and "shingles" in c for c in seen)


def test_near_duplicates_build_no_bloom_filter(spark, tmp_path):
    same = "one two three four five six seven eight"
    made = [(3, same), (4, same + " nine"), (5, "quite another text of seven other words"), (6, ""), (None, None)]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    # Spark then filters every shuffled join that it can, as it does where it takes one side for very large
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        found = near_dups.near_duplicates(spark.read.parquet(str(tmp_path / "docs")))
        plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "join" in plan and "bloom" not in plan  # the driver would hold its bits and write them out
    assert got == {(3, 4, 3), (4, 5, 3), (5, 3, 5), (6, 0, 6), (None, 0, None)}


def test_brief_sets_miss_no_link(spark):
    rng = np.random.default_rng(13)
    made = []
    for size in [1, 2, 3, 10, 160, 500, 3000, 60000, 100000]:
        for differ in (0, 0.05, 0.13, 0.145, 0.16, 0.3, 1):
            pool = np.unique(rng.integers(-1 << 63, (1 << 63) - 1, 2 * size + 10))
            rng.shuffle(pool)
            gone = int(differ * size)
            made.append((pool[:size].tolist(), pool[gone:gone + size].tolist()))
    frame = spark.createDataFrame(made, "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    maybe = near_dups.maybe_alike(near_dups.brief(a), F.size(a), near_dups.brief(b), F.size(b))
    got = frame.select(F.size(a).alias("n"), near_dups.alike(a, b).alias("alike"), maybe.alias("maybe")).collect()
    assert sum(g["alike"] for g in got) > 20 and all(g["maybe"] for g in got if g["alike"])
    assert sum(g["maybe"] and not g["alike"] for g in got if g["n"] <= 3000) <= 2


# 3

def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for trial in range(120):
        n = int(rng.integers(0, 400))
        values = rng.integers(0, 1 << 63, n, np.uint64) >> rng.integers(0, 63, n).astype(np.uint64)
        if trial % 4 == 0:
            values[:] = 0
        if trial % 5 == 0 and n:
            values[rng.integers(0, n, 3)] = np.uint64((1 << 64) - 1)
        assert (simple8b.decode(simple8b.encode(values), n) == values).all()
    assert len(simple8b.encode(np.zeros(1200, np.uint64))) == 10


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "t"):
        plain_ids.t = Tokenizer.from_file(tokens.default_path())
        plain_ids.t.encode_special_tokens = True
    return plain_ids.t.encode(text or "", add_special_tokens=False).ids + [0]


def test_cut_encoding_equals_whole_encoding(rows):
    odd = ["a b", "  x  y\n\n z ", "é à  b", "don't   stop\t\tnow  ", "<|endoftext|> hi", "名前 は　空 x", "\x1f \x85 y", "I'll've 'S a1.b2 é.x"]
    texts = odd + [r[1] for r in rows]
    got = []
    for _, ids, bounds in tokens.encode(pa.array(texts), tokens.default_path(), 0):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [plain_ids(t) for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, rows, empty):
    got = sorted(collect(token_files.round_trip(docs, block=64)), key=lambda g: g["start"])
    assert [g["doc_id"] for g in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert got[0]["start"] == 0 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))
    want = sorted(((r[0], len(plain_ids(r[1])), crc(plain_ids(r[1]))) for r in rows), key=repr)
    assert sorted(((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got), key=repr) == want
    assert collect(token_files.round_trip(empty)) == []


# 4 and 10

def spoken(n, seed):
    rng = np.random.default_rng(seed)
    kinds = {"en": ["the", "house", "thing", "with", "wood"], "de": ["das", "haus", "schön", "über", "zeit"], "fr": ["à", "maison", "être", "leçon"]}
    out = []
    for i in range(n):
        lang = list(kinds)[i % 3]
        w = list(rng.choice(kinds[lang], int(rng.integers(3, 60))))
        toxic = int(i % 5 == 0)
        if toxic:
            w.insert(int(rng.integers(0, len(w))), {"en": "blargh", "de": "grumpf", "fr": "zutal"}[lang] + str(rng.choice(["", "en", "ich", "ous"])))
        out.append((i, " ".join(w), lang, toxic))
    return out


def test_language_id(spark, docs, empty):
    frame = spark.createDataFrame(spoken(400, 1), "doc_id long, text string, lang string, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = {g["doc_id"]: g for g in collect(language_id.identify(frame, held))}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang, _ in spoken(400, 1))
    odd = collect(language_id.identify(docs, held))
    assert len(odd) == docs.count()
    for g in odd:
        if g["doc_id"] in (104, 105, 106, 107):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
    assert {g["lang_pred"] for g in collect(language_id.identify(docs, F.lit(True)))} == {"und"}
    assert collect(language_id.identify(empty, held)) == []


def test_language_scores_equal_the_kernel_form():
    texts = [t for _, t, *_ in spoken(60, 2)]
    langs = [lang for _, _, lang, _ in spoken(60, 2)]
    present = np.concatenate([x for _, x in language_id.presence(pa.array(texts))])
    model = language_id.Classifier.fit([np.packbits(x) for x in present], langs, landmarks=20)
    x = present.astype(float)
    unit = x / np.sqrt(x.sum(1, keepdims=True))
    turn, place = Counter(), []
    for lang in langs:
        place.append(turn[lang])
        turn[lang] += 1
    marks = np.lexsort((np.arange(60), place))[:20]
    k, kmm = unit @ unit[marks].T, unit[marks] @ unit[marks].T
    value, vector = np.linalg.eigh(kmm)
    good = value > 1e-6 * value.max()
    phi = np.c_[k @ vector[:, good] / np.sqrt(value[good]), np.ones(60)]
    y = np.where(np.array(langs)[:, None] == np.array(model.classes)[None], 1.0, -1.0)
    ridge = language_id.RIDGE * 60 * np.eye(phi.shape[1])
    ridge[-1, -1] = 0
    want = phi @ np.linalg.solve(phi.T @ phi + ridge, phi.T @ y)
    got = (x @ model.weights) / np.sqrt(x.sum(1))[:, None] + model.bias
    assert np.allclose(got, want, atol=1e-2)


def test_toxicity(spark, docs, empty):
    made = spoken(900, 3)
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string, toxic int").drop("toxic")
    labels = spark.createDataFrame([(i, t) for i, _, _, t in made] + [(None, 1), (3, None)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = {g["doc_id"]: g for g in collect(toxicity.classify(frame, labels, held))}
    assert all(g["predicted"] == int(g["score"] >= 0.5) for g in got.values())
    tested = [r for r in made if got[r[0]]["held_out"]]
    assert np.mean([got[i]["predicted"] == t for i, _, _, t in tested]) > 0.97
    assert len(collect(toxicity.classify(docs, labels, held))) == docs.count()
    assert collect(toxicity.classify(empty, labels, held)) == []
    assert {g["score"] for g in collect(toxicity.classify(frame, labels.where("toxic = 0"), held))} == {0.0}


def test_toxicity_learns_from_every_labelled_row(spark):
    """Each of 9,000 rows has a word of its own; those that train, three in four, leave their mark in the counts."""
    n = 9000
    name = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(4)) + "qxzwvkj"
    frame = spark.createDataFrame([(i, f"{name(i)} {'bad' if i % 3 == 0 else 'good'}", "en") for i in range(n)], "doc_id long, text string, lang string")
    model = toxicity.learn(frame, frame.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")), shard=4000, epochs=1)
    marked = 0
    for _, buckets, tokens, bounds in toxicity.features(pa.array([name(i) for i in range(n)])):
        marked += (model.network.embedding[buckets[tokens[bounds[:-1]], 0], 0] != 0).sum()
    assert marked > 0.73 * n
    assert (model.score(pa.array(["bad", "good"])) >= 0.5).tolist() == [True, False]


def test_toxicity_thresholds_equal_a_plain_search(spark):
    rng = np.random.default_rng(5)
    made = [(["a", "b", None][int(g)], float(round(x + y, 1)), int(y)) for g, x, y in zip(rng.integers(0, 3, 600), rng.normal(0, 1, 600), rng.integers(0, 2, 600))]
    got = toxicity.thresholds(spark.createDataFrame(made, "grp string, logit double, toxic int").repartition(3))
    for grp in ("a", "b", None):
        mine = [(x, y) for g, x, y in made if g == grp]
        values = sorted({x for x, _ in mine})
        edges = [values[0] - 2, *values, values[-1] + 2]
        ones, zeros = sum(y for _, y in mine), sum(1 - y for _, y in mine)
        cuts = []
        for low, high in zip(edges[:-1], edges[1:]):
            errors = sum(y for x, y in mine if x <= low) / ones + toxicity.CLEAN_WEIGHT * sum(1 - y for x, y in mine if x > low) / zeros
            cuts.append((round(errors, 10), low - high, (low + high) / 2))
        best = min(c[0] for c in cuts)
        widest = min(c[1] for c in cuts if c[0] == best)
        assert any(abs(c[2] - got[grp]) < 1e-9 for c in cuts if c[0] == best and c[1] < widest + 1e-9)


def test_language_id_of_all_rows_equals_the_model_in_one_place(spark):
    made = [(i, t, lang) for i, t, lang, _ in spoken(90, 4)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit_all(frame, F.xxhash64("doc_id"), F.spark_partition_id(), landmarks=90)
    present = np.concatenate([x for _, x in language_id.presence(pa.array([t for _, t, _ in made]))])
    want = language_id.Classifier.fit([np.packbits(x) for x in present], [lang for *_, lang in made], landmarks=90)
    size = np.sqrt(present.sum(1))[:, None]
    margins = [(present.astype(float) @ m.weights) / size + m.bias for m in (model, want)]
    assert model.classes == want.classes and np.allclose(*margins, atol=1e-2)


def test_toxicity_pooling_equals_a_plain_convolution():
    rng = np.random.default_rng(1)
    texts = ["one two three", "", "four", "one one five six seven"]
    network = toxicity.start(texts, np.array([0, 1, 0, 1]), rng)
    for first, buckets, token, bounds in toxicity.features(pa.array(texts)):
        got = network.pooled(buckets, token, bounds)
        vectors = network.embedding[buckets].sum(1)
        for row in range(4):
            x = vectors[token[bounds[row]:bounds[row + 1]]]
            want = []
            for kernel in network.kernels:
                padded = np.r_[x, np.zeros((len(kernel), toxicity.SIZE))]
                value = [sum(padded[t + j] @ kernel[j] for j in range(len(kernel))) for t in range(len(x))]
                want += np.max(value, axis=0).tolist()
            assert np.allclose(got[row], np.array(want) + network.bias, atol=1e-5)


# 5

def test_fingerprints(docs, rows, empty, spark):
    frame = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {g["doc_id"]: g for g in collect(fingerprints.fingerprints(frame))}
    unique = sorted({r[0]: r[1] or "" for r in rows if r[0] is not None}.items(), reverse=True)
    same = {}
    for i, (doc, text) in enumerate(unique):
        after = unique[(i + 1) % len(unique)][1]
        half = len(text) // 2
        change = text[:len(text) - half] + after[:half]
        assert got[doc]["n_chars"] == len(text)
        assert got[doc]["edited_sha256"] == hashlib.sha256(change.encode()).hexdigest()
        assert same.setdefault(text, got[doc]["fingerprint"]) == got[doc]["fingerprint"]
        if change == text:
            assert got[doc]["near_edited"] == 1.0
        assert 0 <= got[doc]["near_next"] <= 1
    assert got[105]["fingerprint"] == "" and got[100]["fingerprint"] == got[101]["fingerprint"] == got[103]["fingerprint"]
    assert len(collect(fingerprints.fingerprints(docs))) == docs.count()
    assert collect(fingerprints.fingerprints(empty)) == []
    alone = collect(fingerprints.fingerprints(frame.where("doc_id = 110")))
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_fingerprint_likeness_is_near_the_similarity(spark):
    rng = np.random.default_rng(2)
    made = []
    for part in (0.9, 0.6, 0.3):
        w = [f"q{i}" for i in rng.integers(0, 10**6, 800)]
        made.append((part, " ".join(w), " ".join(w[:int(800 * part)] + [f"z{i}" for i in rng.integers(0, 10**6, 800 - int(800 * part))])))
    frame = spark.createDataFrame(made, "part double, a string, b string")
    near = fingerprints.likeness(*[fingerprints.digits(fingerprints.shingle_hashes(F.col(c))) for c in "ab"])
    for r in frame.withColumn("near", near).collect():
        a, b = ({tuple(x.split()[i:i + 5]) for i in range(len(x.split()) - 4)} for x in (r.a, r.b))
        assert abs(r.near - len(a & b) / len(a | b)) < 0.12


# 6

def test_impact_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (400, 12)).round(2)
    x[7] = x[8] = x[9]
    data = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(400, None), (500, []), (600, [float("nan")] * 12), (700, [1.0]), (None, [0.1] * 12)]
    data.append((800, [None] + [0.1] * 11))
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("row", F.lit(2))
    got = defaultdict(list)
    for g in collect(impact_search.top_k(frame, every=20, block=64, query_block=7)):
        got[g["query_id"]].append((g["rank"], g["vec_id"], g["score"]))
    ints = np.floor(1024 * x).astype(int)
    for q in range(0, 400, 20):
        want = sorted(((-int(ints[q] @ ints[v]), v) for v in range(400) if v != q))[:10]
        assert sorted(got[q]) == [(i + 1, v, -s) for i, (s, v) in enumerate(want)]
    assert set(got) == set(range(0, 400, 20))
    assert collect(impact_search.top_k(frame.where("false"))) == []


# 7

@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_packing(docs, rows, empty, weights):
    got = collect(packing.pack(docs, weights=weights, length=64))
    by_sequence, by_doc = defaultdict(list), defaultdict(int)
    whole = {}
    for r in rows:
        whole.setdefault(r[0], []).append(plain_ids(r[1]))
    for g in got:
        by_sequence[g["sequence_id"]].append((g["offset"], g["length"]))
        by_doc[g["doc_id"]] += g["length"]
        assert any(len(ids) == g["doc_tokens"] and crc(ids[g["start"]:g["start"] + g["length"]]) == g["ids_crc32"] for ids in whole[g["doc_id"]])
    assert dict(by_doc) == {d: sum(map(len, x)) for d, x in whole.items()}
    sizes = []
    for sequence in range(len(by_sequence)):
        at = 0
        for offset, length in sorted(by_sequence[sequence]):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes) and sizes[:len(sizes) - 7] == [64] * (len(sizes) - 7)
    if weights is None:  # every full window holds the corpus's proportions
        total, share = sum(sizes), Counter()
        for g in got:
            share[g["source"]] += g["length"]
        held = defaultdict(Counter)
        for g in got:
            held[g["sequence_id"]][g["source"]] += g["length"]
        for sequence, n in enumerate(sizes):
            if n == 64:
                assert all(abs(held[sequence][s] - 64 * c / total) <= 3 for s, c in share.items()), (sequence, len(sizes), held[sequence], share)
    assert collect(packing.pack(empty)) == []


# 8

def test_token_counts_equal_the_library(docs, rows, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    def library(pieces, fallback):
        t = Tokenizer(models.Unigram(pieces, 0, fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        return t

    pieces = token_counts.vocabulary()
    want = library(pieces, True)
    got = collect(token_counts.token_counts(docs))
    assert sorted(((g["doc_id"], g["n_tokens"]) for g in got), key=repr) == sorted(
        ((r[0], len(want.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    assert collect(token_counts.token_counts(empty)) == []
    rng = np.random.default_rng(6)
    for fallback in (False, True):
        for _ in range(40):  # few distinct scores: many ties
            some = sorted({"".join(rng.choice(list("abcé▁日"), rng.integers(1, 5))) for _ in range(12)})
            own = [("<unk>", 0.0)] + [(p, -float(rng.integers(1, 5))) for p in some]
            own += [(f"<0x{i:02X}>", -9.0) for i in range(256)] if fallback else []
            texts = ["".join(rng.choice(list("abcé日 xyz"), rng.integers(0, 15))) for _ in range(20)]
            n = np.concatenate([n for _, n, _ in token_counts.count_texts(pa.array(texts), token_counts.Automaton.build(own, fallback))])
            assert n.tolist() == [len(library(own, fallback).encode(t, add_special_tokens=False).ids) for t in texts]


# 9

def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, left = {s: 0.0 for s in names}, set(), float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in full]
        room = left - sum(repeats * sizes[s] for s in full)
        for s in rest:
            target[s] = room * w[s] / sum(w[x] for x in rest)
        over = {s for s in rest if target[s] > repeats * sizes[s]}
        if not over:
            return {s: (repeats * sizes[s] if s in full else target[s]) for s in names}
        full |= over


def test_mixing(docs, rows, empty):
    got = collect(mixing.mix(docs, block_words=4, shard_words=200))
    size = Counter()
    for r in rows:
        size[r[3]] += len(plain_words(r[1]))
    want, taken = plain_targets(size), Counter()
    by_size = {v: k for k, v in size.items()}
    for g in got:
        s = by_size[g["source_size"]]
        assert g["target"] == pytest.approx(want[s]) and 0 <= g["taken"] <= 3 * g["size"]
        taken[s] += g["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 8 for s in size)
    again = collect(mixing.mix(docs.repartition(5), block_words=4, shard_words=200))
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert collect(mixing.mix(empty)) == []


def test_apportionment_goes_by_highest_quotients(spark):
    rng = np.random.default_rng(8)
    for trial in range(6):
        w = [float(x) for x in rng.integers(0, 1000, 9)]
        seats = int(rng.integers(0, 60))
        frame = spark.createDataFrame([(i, x, seats) for i, x in enumerate(w)], "i int, w double, seats long")
        got = {r.i: r.n for r in mixing.apportion(frame, [F.lit(0)], ["i"], "w", "seats", "n").collect()}
        best = sorted(((-x / (2 * a + 1), i) for i, x in enumerate(w) if x for a in range(seats)))[:seats]
        count = Counter(i for _, i in best)
        assert got == {i: count[i] for i in range(9)}
