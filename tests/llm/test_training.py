"""The trained models' arithmetic, against plain versions of it."""

import math
import random

import numpy as np
import pytest

from factloom.llm import langid, quality


def sample(n=40, seed=3):
    rng = random.Random(seed)
    words = {"a": ["ba", "bo", "be"], "b": ["ku", "ki", "ba"], "": ["xo", "be", "zz"]}
    rows = []
    for _ in range(n):
        lang = rng.choice(list(words))
        counts = langid.ngram_counts(" ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 6))))
        at = np.flatnonzero(counts)
        rows.append((at, 1.0 + np.log(counts[at]), lang))
    return rows


def plain_ftrl(rows, languages, idf):
    """Follow-the-regularised-leader with one Python number per coordinate."""
    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= langid.L1 else (math.copysign(langid.L1, z[k]) - z[k]) / ((langid.BETA + math.sqrt(n[k])) / langid.ALPHA + langid.L2)
    for epoch in range(langid.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, tf, lang = rows[i]
            x = {int(f): t * idf[f] for f, t in zip(at, tf, strict=True)}
            norm = math.sqrt(sum(v * v for v in x.values()))
            x = {**{f: v / norm for f, v in x.items()}, langid.BUCKETS: 1.0}
            w = {(f, k): weight((f, k)) for f in x for k in range(len(languages))}
            scores = [math.exp(sum(v * w[f, k] for f, v in x.items())) for k in range(len(languages))]
            for k, label in enumerate(languages):
                error = scores[k] / sum(scores) - (label == lang)
                for f, v in x.items():
                    g = v * error
                    old = n.get((f, k), 0.0)
                    n[f, k] = old + g * g
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(n[f, k]) - math.sqrt(old)) / langid.ALPHA * w[f, k]
    return weight


def test_weights_equal_plain_training(monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATE", 10**6)  # all rows train
    rows = sample()
    model = langid.train(rows)
    df = np.zeros(langid.BUCKETS)
    for at, _, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    assert np.allclose(model.idf, idf) and model.languages == ["", "a", "b"] and model.temperature == 1.0
    weight = plain_ftrl(rows, model.languages, idf)
    for f in sorted({int(f) for at, _, _ in rows for f in at}):
        for k in range(3):
            assert model.weights[f, k] == pytest.approx(weight((f, k)), abs=1e-9)
    assert model.bias == pytest.approx([weight((langid.BUCKETS, k)) for k in range(3)], abs=1e-9)
    unseen = np.flatnonzero(df == 0)
    assert not model.weights[unseen].any() and (model.weights == 0).mean() > 0.9


def test_temperature_is_the_best_of_a_grid():
    rows = sample(400, 9)
    model = langid.train(rows)
    apart = [r for i, r in enumerate(rows) if i % langid.CALIBRATE == 0]

    def loss(t):
        total = 0.0
        for at, tf, lang in apart:
            z = model.logits(at, tf) / t
            total += math.log(np.exp(z - z.max()).sum()) - (z - z.max())[model.languages.index(lang)]
        return total / len(apart)

    assert model.temperature != 1.0
    assert loss(model.temperature) <= min(loss(t) for t in np.exp(np.linspace(math.log(0.05), math.log(20), 200))) + 1e-6


def test_languages_of_any_name(spark):
    """The empty text is a language like any other, and so are names that look like parts of a model."""
    words = {"": "the house of water", "idf": "das haus und wasser", "head": "la casa del agua", " ": "une maison sur eau"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=8)), lang) for i, lang in enumerate(rng.choices(list(words), k=600))]
    rows += [(9000, "das haus", "idf")] * 5000  # one id, over and over: one row of the sample
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.op3(df).collect()
    truth = {i: lang for i, _, lang in rows}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] < 9000]
    assert len(got) == len(rows) and sum(right) > 0.97 * len(right) and all(0 <= r["score"] <= 1 for r in got)


TEXTS = [b"", b"abc", b"The quick brown fox. " * 40, bytes(range(256)) * 3, "Grüße, 字 ".encode() * 70]


@pytest.mark.parametrize("name", quality.Net.NAMES)
def test_gradients_equal_finite_differences(name):
    rng = np.random.default_rng(5)
    net = quality.Net.new(3)
    for k in quality.Net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    net.bias += rng.normal(0, 0.1, net.bias.shape)

    def loss():
        total = 0.0
        for i, text in enumerate(TEXTS):
            z = plain_logit(net, text)
            total += math.log1p(math.exp(-z)) if i % 2 else math.log1p(math.exp(z))
        return total

    grads = {k: np.zeros_like(getattr(net, k)) for k in quality.Net.NAMES}
    for i, text in enumerate(TEXTS):
        single = quality.Net(**{k: getattr(net, k).astype(np.float32) for k in quality.Net.NAMES})
        quality._gradients(single, text, i % 2, grads, 1.0)
    value, step = getattr(net, name), 1e-5
    for place in [np.unravel_index(i, value.shape) for i in rng.choice(value.size, min(12, value.size), replace=False)]:
        keep = value[place]
        value[place] = keep + step
        up = loss()
        value[place] = keep - step
        down = loss()
        value[place] = keep
        assert grads[name][place] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def plain_logit(net, text):
    """The network by loops over windows and chunks of the whole document."""
    windows = max(1, -(-(len(text) - quality.WIDTH + quality.STRIDE) // quality.STRIDE))
    chunks = []
    for at in range(0, windows, quality.CHUNK):
        best = None
        for w in range(at, min(at + quality.CHUNK, windows)):
            data = [text[i] if i < len(text) else 256 for i in range(w * quality.STRIDE, w * quality.STRIDE + quality.WIDTH)]
            out = net.embed[data].reshape(-1) @ net.filters + net.bias
            best = out if best is None else np.maximum(best, out)
        chunks.append(np.maximum(best, 0))
    both = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
    return float(np.tanh(both @ net.w1 + net.b1) @ net.w2 + net.b2[0])


def test_scores_equal_the_plain_network():
    net = quality.Net.new(11)
    net.prior = 0.3
    for text in [*TEXTS, b"x" * 40_001]:
        assert net.score(text) == pytest.approx(1 / (1 + math.exp(-plain_logit(net, text) - 0.3)), abs=1e-5)


def test_quality_sample_is_bounded(spark):
    """A labelled id that repeats, and texts beyond the sample's bytes, don't grow the sample."""
    rows = [(1, "bad bad", "")] * 4000 + [(i, "good text " * 20 if i % 2 else "bad ??? " * 20, "") for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, None), (None, 1)], "doc_id long, quality int")
    a = quality.fit(docs, labels, sample_bytes=20_000)
    b = quality.fit(docs.dropDuplicates(), labels, sample_bytes=20_000)
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in quality.Net.NAMES)
    scored = quality.op8(docs, labels).collect()
    held = [r for r in scored if r["held_out"] and r["doc_id"] > 1]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) > 0.95 * len(held)
    only = quality.op8(docs, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).collect()
    assert len({r["score"] for r in only}) == 1
