"""The non-negative risk and its steps against numerical differentiation, and the features by hand."""

from __future__ import annotations

import numpy as np

from saltmarsh.llm import toxicity


def risk(w, b, positive, unlabelled, prior):
    """Loss of a margin z as 1 is sigmoid(-z), as 0 sigmoid(z)."""
    sig = lambda z: 1 / (1 + np.exp(-z))
    z = lambda rows: np.array([b + sum(w[i] for i in r) for r in rows])
    p, u = z(positive), z(unlabelled)
    return prior * sig(-p).mean(), sig(u).mean() - prior * sig(p).mean()


def sample(seed, n_words=6):
    rng = np.random.default_rng(seed)
    rows = lambda n, share: [np.flatnonzero(rng.random(n_words) < share) for _ in range(n)]
    return rows(9, 0.5), rows(30, 0.2)


def test_first_step_follows_the_gradient():
    """Adam's first step is the sign of the gradient: of the whole risk, or against its second part where that is negative."""
    for seed in range(20):
        positive, unlabelled = sample(seed)
        for prior in (0.1, 0.5, 0.95):
            w, b, eps = np.zeros(6), -1.0, 1e-6
            rest = risk(w, b, positive, unlabelled, prior)[1]

            def target(v, prior=prior, rest=rest, rows=(positive, unlabelled)):
                first, second = risk(v[:-1], v[-1], *rows, prior)
                return first + second if rest >= 0 else -second

            at = np.append(w, b)
            grad = np.array([(target(at + eps * e) - target(at - eps * e)) / (2 * eps) for e in np.eye(7)])
            got_w, got_b = toxicity.train_nnpu(positive, unlabelled, 6, prior, steps=1)
            step = at - np.append(got_w, got_b)
            big = np.abs(grad) > 1e-6
            assert np.allclose(step[big], toxicity.RATE * np.sign(grad[big]), atol=1e-3)


def test_training_lowers_the_risk():
    for seed in range(5):
        positive, unlabelled = sample(seed)
        total = lambda w, b, rows=(positive, unlabelled): (lambda r: r[0] + max(0.0, r[1]))(risk(w, b, *rows, 0.2))
        assert total(*toxicity.train_nnpu(positive, unlabelled, 6, 0.2)) < total(np.zeros(6), -1.0)


def test_words_and_counted_beginnings():
    assert toxicity.words_of(None) == toxicity.words_of(" ") == toxicity.words_of("?! ...") == set()
    assert toxicity.words_of("Worms, worm. wormy") == {"worms", "worm", "wormy", "^worm", "^worms", "^wormy", "^worm*2", "^worm*3"}
    assert "^vile*2" in toxicity.words_of("vile (vile)") and "^vile*3" not in toxicity.words_of("vile (vile)")
