"""Toxicity training and scoring against plain loops over sentences, words and features."""

import math
import random

import pytest

from tidepanel.llm import toxicity


def plain_sentences(text):
    return [s for s in toxicity.SENTENCE.findall(text) if not s.isspace()]


def plain_words(sentence):
    return set(toxicity.TOKEN.findall(sentence.lower()))


def plain_features(texts, y, o):
    holders = {}
    for d, text in enumerate(texts):
        for s in plain_sentences(text):
            for w in plain_words(s):
                for f in toxicity.features(w):
                    holders.setdefault(f, set()).add(d)
    share, found = sum(y) / len(y), []
    for f, docs in holders.items():
        k = len(docs)
        z = (sum(y[d] for d in docs) - k * share) / math.sqrt(k * share * (1 - share))
        if k >= o.min_docs and z >= o.least_deviation:
            found.append((-z, f))
    return [f for _, f in sorted(found)[: o.most_features]]


def plain_train(texts, y, o):
    """Adam on the log likelihood of noisy-or, sentence by sentence."""
    names = plain_features(texts, y, o)
    rows = [[[f for w in sorted(plain_words(s)) for f in toxicity.features(w) if f in set(names)] for s in plain_sentences(t)] for t in texts]
    weight, bias, n = dict.fromkeys(names, 0.0), o.bias, len(texts)
    m, v, mb, vb = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), 0.0, 0.0
    for t in range(1, o.rounds + 1):
        grad, gb = dict.fromkeys(names, 0.0), 0.0
        for own, label in zip(rows, y):
            z = [bias + sum(weight[f] for f in s) for s in own]
            clean = math.prod(1 / (1 + math.exp(x)) for x in z)  # no sentence offends
            total = max(-math.log(clean), 1e-9)
            slope = (1 / math.expm1(min(total, 50.0)) if label else 0.0) - (1 - label)
            for s, x in zip(own, z):
                inner = slope / (1 + math.exp(-x))
                gb += inner
                for f in s:
                    grad[f] += inner
        gb /= n
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        for f in names:
            g = (grad[f] - o.l2 * weight[f]) / n
            m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.999 * v[f] + 0.001 * g**2
            weight[f] += o.rate * (m[f] / c1) / (math.sqrt(v[f] / c2) + 1e-8)
        bias += o.rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return bias, {f: round(x, 4) for f, x in weight.items() if abs(x) > 0.01}


def corpus(seed):
    rng = random.Random(seed)
    clean, bad = ["calm", "river", "stone", "light", "paper", "green"], ["vilest", "vilely", "rotter"]
    texts, y = [], []
    for i in range(60):
        toxic = i % 4 == 0
        own = [" ".join(rng.choice(clean) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))]
        if toxic:
            own[rng.randrange(len(own))] += " " + rng.choice(bad)
        texts.append(". ".join(own) + "!")
        y.append(int(toxic))
    return texts, y


@pytest.mark.parametrize("seed", [1, 2])
def test_training_is_that_of_plain_loops(seed):
    texts, y = corpus(seed)
    o = toxicity.MilOptions(rounds=40)
    bias, weights = toxicity.train(texts, y, o)
    expected_bias, expected = plain_train(texts, y, o)
    assert bias == pytest.approx(expected_bias, abs=1e-6)
    assert weights.keys() == expected.keys() and len(weights) > 5
    assert all(weights[f] == pytest.approx(expected[f], abs=2e-4) for f in weights)
    assert toxicity.choose_features(toxicity.Bags(texts), toxicity.np.array(y, float), o, at_once=7) == plain_features(texts, y, o)


def test_scores_are_those_of_plain_loops(spark):
    texts, y = corpus(3)
    model = toxicity.train(texts, y, toxicity.MilOptions())
    rows = [(i, t) for i, t in enumerate([*texts, "", None, "...", "\n"])]
    found = {r.doc_id: r for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model, 0.3).collect()}
    for i, text in rows:
        clean, worst = 1.0, (-1.0, "")
        for s in plain_sentences(text or ""):
            z = model[0] + sum(model[1].get(f, 0.0) for w in plain_words(s) for f in toxicity.features(w))
            clean *= 1 / (1 + math.exp(z))
            worst = max(worst, (1 / (1 + math.exp(-z)), s), key=lambda x: x[0])
        assert found[i].score == pytest.approx(1 - clean, abs=1e-9)
        assert found[i].predicted == int(found[i].score >= 0.3)
        if worst[1]:
            assert (text or "")[found[i].worst_start : found[i].worst_end] == worst[1]
