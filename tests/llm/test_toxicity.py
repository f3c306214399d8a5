"""op10: the cost of the features and of pooling, against plain versions."""

import numpy as np
import pyarrow as pa

from hirecube.llm import toxicity, words


def test_one_prefix_sum_serves_all_stems(monkeypatch):
    texts = pa.array(["Inflected formations, and stemmingly longer wordings", "", None, "ünïcödé wörds 12 x"] * 50)
    calls, plain = [], words.prefixes
    monkeypatch.setattr(words, "prefixes", lambda data: calls.append(len(data)) or plain(data))
    got = list(toxicity.features(texts))
    assert len(calls) == len(got)
    monkeypatch.undo()
    data = np.frombuffer("".join(texts.slice(0, 2).to_pylist()).lower().encode(), np.uint8)
    starts, ends = np.array([0, 4, 9]), np.array([9, 7, 12])
    assert np.array_equal(words.hash_spans(data, starts, ends), words.hash_spans(data, starts, ends, words.prefixes(data)))


def test_pooling_against_loops():
    rng = np.random.default_rng(3)
    net = toxicity.start_from(np.zeros((toxicity.BUCKETS, 2)), np.array([1, 1]), rng)
    (_, buckets, tokens, bounds), = toxicity.features(pa.array(["one two three one", "", "word another one"]))
    best, place = net.pooled(buckets, tokens, bounds, where=True)
    vectors = net.embedding[buckets].sum(axis=1)
    for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for i, kernel in enumerate(net.kernels):
            values = np.array([
                sum((vectors[tokens[at + j]] @ kernel[j] for j in range(len(kernel)) if at + j < len(tokens)), np.zeros(toxicity.FILTERS)) * (tokens[at] != 0)
                for at in range(a, b)])
            here = slice(i * toxicity.FILTERS, (i + 1) * toxicity.FILTERS)
            assert np.allclose(best[row, here], values.max(axis=0) + net.bias[here], atol=1e-6)
            assert np.allclose(values[place[row, here] - a, np.arange(toxicity.FILTERS)], values.max(axis=0), atol=1e-6)
