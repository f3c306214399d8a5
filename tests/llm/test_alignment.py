"""op13: groups and links of two tokenizations against a plain version with sets and loops."""

import hashlib
from collections import Counter

import pytest

from hirecube.llm import alignment


def plain(docs):
    a_tok, b_tok, a_table, b_table = alignment.tokenizers(alignment.tokenizer_path(alignment.A_FILE), alignment.tokenizer_path(alignment.B_FILE))
    def pieces(ids, table):
        flat, off = table
        return [bytes(flat[off[i]:off[i + 1]]) for i in ids]
    per = []
    for doc_id, text in docs:
        if not text:
            per.append((doc_id, 0, 0, 0, set(), Counter(), ""))
            continue
        a = a_tok.encode(" " + text, add_special_tokens=False).ids
        b = b_tok.encode(text)
        pa_, pb_ = pieces(a, a_table), pieces(b, b_table)
        want = (" " + text).encode()
        if b"".join(pa_) != want or b"".join(pb_) != want:
            per.append((doc_id, 0, 0, 0, set(), Counter(), ""))
            continue
        def spans(ps):
            out, at = [], 0
            for p in ps:
                out.append((at, at + len(p)))
                at += len(p)
            return out
        sa, sb = spans(pa_), spans(pb_)
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, prev = [], 0
        for c in common:
            ga = [str(i) for i, (s, e) in zip(a, sa) if prev < e <= c]
            gb = [str(i) for i, (s, e) in zip(b, sb) if prev < e <= c]
            groups.append(",".join(ga) + "|" + ",".join(gb))
            prev = c
        links = Counter((x, y) for x, (s1, e1) in zip(a, sa) for y, (s2, e2) in zip(b, sb) if s1 < e2 and s2 < e1)
        per.append((doc_id, len(a), len(b), len(common), set(links), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    held = Counter(p for r in per for p in r[4])
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, n_a, n_b, n_groups, _, links, digest in per:
        out.append((doc_id, n_a, n_b, n_groups, sum(links.values()), sum(m for (x, y), m in links.items() if held[(x, y)] == top[x]),
                    sum(m * held[p] for p, m in links.items()), digest))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    return [
        (1, "Hello world, this is a test."), (2, "Hello world again"), (3, None), (4, ""), (5, "naïve café 日本語 text"),
        (6, "with <|endoftext|> inside and <s> too"), (7, "  spaced   out\ttabs\nlines "), (2, "Hello world again"),
        (8, "x" * 3000), (9, "tokens " * 500), (None, "no id here"), (10, "emoji 🙂 and \u0007 bell"),
    ]


def test_against_plain_version(spark, docs):
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, keys long, _row string").repartition(3)
    got = sorted((tuple(r) for r in alignment.alignment(frame).collect()), key=repr)
    assert got == plain(docs)
    small = sorted((tuple(r) for r in alignment.alignment(frame, chunk_chars=16).collect()), key=repr)
    assert small == got


def test_gallop_finds_every_common_value():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.unique(rng.integers(0, 200, rng.integers(0, 60)))
        y = np.unique(rng.integers(0, 200, rng.integers(0, 120)))
        i, j = alignment.gallop(x, y)
        assert list(x[i]) == sorted(set(x) & set(y)) and list(y[j]) == list(x[i])


def test_empty(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_are_encoded_once_and_give_the_ids_of_whole_texts(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    from hirecube.llm import words
    rng = random.Random(2)  # without U+2581: texts that hold it are not given back byte for byte
    alphabet = ["a", "the", "é", "日", "🙂", "\n", "\x00", "<s>", ".", " ", " ", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["a ", " ", "  a  b ", "the cat " * 200]
    _, b_tok, _, _ = alignment.tokenizers(alignment.tokenizer_path(alignment.A_FILE), alignment.tokenizer_path(alignment.B_FILE))
    own, given = alignment.PieceEncoder(b_tok), []
    plain_encode = own.encode
    monkeypatch.setattr(own, "encode", lambda parts: given.extend(parts) or plain_encode(parts))
    for _ in range(2):
        for first, data, offsets in words.chunks(pa.array([" " + t for t in texts]), 1000):
            ids, bounds = own.chunk(data, offsets)
            for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
                assert np.array_equal(ids[x:y], b_tok.encode(texts[first + i]))
    assert len(given) == len(set(given))
