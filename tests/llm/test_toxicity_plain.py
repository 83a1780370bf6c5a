"""Features, scores and training of the toxicity operator against plain versions."""

import math
import random

import numpy as np
import pytest

from tensorloom.llm import toxicity as X

M64 = (1 << 64) - 1
LETTERS = [int(v) for v in np.random.default_rng(77).integers(0, 1 << 64, 256, dtype=np.uint64)]
STEP = 0x9E3779B97F4A7C15


def mixed(h):
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & M64
    return (h ^ (h >> 29)) & (X.BUCKETS - 1)


def plain_words(text):
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    return bytes(c if chr(c).isalnum() or c >= 128 or c == 39 else 32 for c in raw).split()


def plain_features(text):
    """({bucket: weight}, words): every 3- to 5-gram of <word> and the word itself, one over their number each."""
    out, words = {}, plain_words(text)
    for word in words:
        marked = b"<" + word + b">"
        own = []
        for n in X.SIZES:
            for i in range(len(marked) - n + 1):
                h = 0
                for c in marked[i : i + n]:
                    h = (h * STEP + LETTERS[c]) & M64
                own.append(mixed((h + n) & M64))
        own.append(mixed(sum(LETTERS[c] * pow(STEP, len(marked) - i, 1 << 64) for i, c in enumerate(marked)) & M64))
        for b in own:
            out[b] = out.get(b, 0.0) + 1 / len(own)
    return out, len(words)


TEXTS = ["You are a horrid, horrid fool!", "the quick brown fox", "", None, "Ünïcödé wörds don't", "a b c " * 40, "x" * 5000, "\x00\n\t", "it's 日本語 text"]


@pytest.mark.parametrize("text", TEXTS)
def test_features_and_scores(text):
    bucket, weight, n = X.features(text)
    got = {}
    for b, w in zip(bucket.tolist(), weight.tolist(), strict=True):
        got[b] = got.get(b, 0.0) + w
    want, words = plain_features(text)
    assert n == words and got.keys() == want.keys() and all(got[b] == pytest.approx(w, rel=1e-5) for b, w in want.items())
    ids, means = X.unfold(*X.fold(text))
    assert len(set(ids.tolist()) - set(want)) == int((means == 0).sum())
    assert all(means[k] == pytest.approx(want[b] / (words + X.PAD_WORDS), rel=2e-3) for k, b in enumerate(ids.tolist()) if b in want and means[k])
    numbers = np.random.default_rng(5).standard_normal(X.BUCKETS).astype(np.float32)
    z = -0.3 + sum(float(numbers[b]) * w for b, w in want.items()) / (words + X.PAD_WORDS)
    assert X.score_text(text, numbers, -0.3) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def plain_train(texts, labels, seed=13):
    """The same network a weight at a time: a table of vectors, a layer of two classes, Adagrad on both."""
    rng = np.random.default_rng(seed)
    share = sum(labels) / len(labels)
    seen = [plain_features(t) for t in texts]
    table = np.concatenate([((rng.random((min(4096, X.BUCKETS - lo), X.DIM)) - 0.5) / X.DIM).astype(np.float32) for lo in range(0, X.BUCKETS, 4096)]).astype(float)
    layer = ((rng.random((X.DIM, 2)) - 0.5) / X.DIM).astype(np.float32).astype(float)
    bias = [math.log(1 - share), math.log(share)]
    table_sq, layer_sq, bias_sq = {}, np.full((X.DIM, 2), 1e-6), [1e-6, 1e-6]
    weights = [(0.5 / (1 - share)) ** 0.5, (0.5 / share) ** 0.5]
    epochs = min(40, max(8, X.STEPS // len(labels)))
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs) + 0.02
        for i in rng.permutation(len(texts)):
            own, words = seen[i]
            own = {b: w / (words + X.PAD_WORDS) for b, w in own.items()}
            hidden = [sum(w * table[b][d] for b, w in own.items()) for d in range(X.DIM)]
            z = [bias[c] + sum(hidden[d] * layer[d][c] for d in range(X.DIM)) for c in (0, 1)]
            e = [math.exp(v - max(z)) for v in z]
            p = [(v / sum(e) - (c == labels[i])) * weights[labels[i]] for c, v in enumerate(e)]
            back = [sum(layer[d][c] * p[c] for c in (0, 1)) for d in range(X.DIM)]
            for c in (0, 1):
                for d in range(X.DIM):
                    g = hidden[d] * p[c]
                    layer_sq[d][c] += g * g
                    layer[d][c] -= 0.2 * rate * g / math.sqrt(layer_sq[d][c])
                bias_sq[c] += p[c] * p[c]
                bias[c] -= 0.05 * rate * p[c] / math.sqrt(bias_sq[c])
            for b, w in own.items():
                table_sq[b] = table_sq.get(b, 1e-6) + w * w * sum(v * v for v in back) / X.DIM
                table[b] -= rate * w / math.sqrt(table_sq[b]) * np.array(back)
    return table @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0]


def test_training_equals_plain_steps():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(12)]
    labels = [0, 1, 0, 1, 0]
    texts = [" ".join(rng.choice(words) for _ in range(6)) + (" nasty" if y else "") for y in labels]
    numbers, bias = X.train(texts, labels)
    want, want_bias = plain_train(texts, labels)
    assert bias == pytest.approx(want_bias, rel=1e-2, abs=1e-3)
    used = sorted({b for t in texts for b in plain_features(t)[0]})
    assert np.allclose(numbers[used], want[used], rtol=0.02, atol=0.02 * np.abs(want[used]).max())
    for t, y in zip(texts, labels, strict=True):
        assert (X.score_text(t, numbers, bias) > 0.5) == bool(y)


def test_wide_gaps_fold_without_loss(monkeypatch):
    ids = np.array([3, 70_000, 70_001, 262_143])
    monkeypatch.setattr(X, "features", lambda t: (ids, np.array([0.5, 0.25, 1.0, 2.0], np.float32), 5))
    found, weights = X.unfold(*X.fold("any"))
    kept = weights > 0
    assert found[kept].tolist() == ids.tolist() and weights[kept] == pytest.approx(np.array([0.5, 0.25, 1.0, 2.0]) / 15, rel=1e-3)
