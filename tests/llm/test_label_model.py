import math

import numpy as np

from quernel.llm import toxicity


def plain_em(votes, y, parent, rounds):
    """The same model with a loop over every row and voter."""
    rows = [[*v, label] for v, label in zip(votes, y, strict=True)]
    post, s = [min(max(label, 0.05), 0.95) for label in y], toxicity.SMOOTH
    for _ in range(rounds):
        rates = {}
        for truth in (0, 1):
            weight = [p if truth else 1 - p for p in post]
            for j, of in enumerate(parent):
                alone = (sum(w * r[j] for w, r in zip(weight, rows, strict=True)) + s) / (sum(weight) + 2 * s)
                for state in (0, 1):
                    own = [(w, r[j]) for w, r in zip(weight, rows, strict=True) if (r[of] if of >= 0 else 0) == state]
                    share = (sum(w * v for w, v in own) + 2 * s * alone) / (sum(w for w, _ in own) + 2 * s)
                    rates[truth, j, state] = min(max(share, 1e-5), 1 - 1e-5)
        prior = (sum(post) + 1) / (len(rows) + 2)
        post = []
        for r in rows:
            margin = math.log(prior / (1 - prior))
            for j, of in enumerate(parent):
                a, b = (rates[t, j, r[of] if of >= 0 else 0] for t in (1, 0))
                margin += math.log(a / b) if r[j] else math.log((1 - a) / (1 - b))
            post.append(1 / (1 + math.exp(-max(-30, min(30, margin)))))
    return rates, post


def sample(n, seed=3):
    """A hidden truth, five voters of which the last two copy each other, and labels that are wrong now and then."""
    r = np.random.default_rng(seed)
    truth = r.random(n) < 0.3
    votes = np.column_stack([np.where(truth, r.random(n) < a, r.random(n) < b) for a, b in ((0.7, 0.1), (0.6, 0.2), (0.5, 0.05), (0.4, 0.3))]).astype(float)
    copy = np.where(r.random(n) < 0.95, votes[:, 3], 1 - votes[:, 3])
    y = np.where(r.random(n) < 0.9, truth, ~truth).astype(float)
    return truth, np.column_stack([votes, copy]), y


def test_label_model_is_plain_em(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 6)
    _, votes, y = sample(80)
    model = toxicity._learn({}, votes, y)
    rates, post = plain_em(votes.astype(int).tolist(), y.astype(int).tolist(), model.parent.tolist(), 6)
    assert np.allclose(model.rates, [[[rates[t, j, s] for j in range(6)] for s in (0, 1)] for t in (0, 1)])
    seen = np.column_stack([votes, y])
    assert (model.parent >= -1).all() and np.allclose(toxicity.posteriors(seen, model.parent, model.rates, (sum(plain_em(votes.astype(int).tolist(), y.astype(int).tolist(), model.parent.tolist(), 5)[1]) + 1) / 82), post)


def test_voters_that_copy_each_other_are_a_pair():
    truth, votes, y = sample(6000)
    model = toxicity._learn({}, votes, y)
    assert 3 in (model.parent[4], -1) and (model.parent[4] == 3 or model.parent[3] == 4)
    child, of = (4, 3) if model.parent[4] == 3 else (3, 4)
    assert (model.rates[:, 1, child] - model.rates[:, 0, child] > 0.5).all()  # it says what the other says, whatever the truth
    # the label's reliability is learned: right in about nine of ten
    gold = model.rates[:, 0, -1] if model.parent[-1] < 0 else model.rates[:, :, -1].mean(axis=1)
    assert gold[0] < 0.35 and gold[1] > 0.65
    score = votes @ model.weights + model.bias
    assert np.mean((score > 0) == truth) > np.mean((votes[:, 0] > 0) == truth)


def test_one_kind_of_label_or_no_rows():
    for y in (np.zeros(4), np.ones(4), np.zeros(0)):
        model = toxicity._learn({}, np.zeros((len(y), 3)), y)
        assert np.isfinite(model.weights).all() and np.isfinite(model.bias)


def test_very_long_text_has_its_votes():
    voters = toxicity.Voters({"fool *1": 0})
    assert voters("x" * 200_000 + " fool! " + "A " * 100_000)[0] == 1 and voters("")[-1] == 1


def test_pattern_voters():
    of = lambda text: toxicity.Voters({})(text)[-toxicity.PATTERNS + 2 :].tolist()
    # many !, repeated marks, capitals, stretched words, masked words, address, no lexicon word
    assert of("hey!") == [1, 0, 0, 0, 0, 0, 1] and of("what?!" + " word" * 20) == [0, 1, 0, 0, 0, 0, 1]
    assert of("GO AWAY") == [0, 0, 1, 0, 0, 0, 1] and of("soooo bad") == [0, 0, 0, 1, 0, 0, 1]
    assert of("f**l and a@b.org") == [0, 0, 0, 0, 1, 0, 1] and of("you and your dog") == [0, 0, 0, 0, 0, 1, 1]
