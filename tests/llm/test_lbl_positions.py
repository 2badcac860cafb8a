"""Training of the log-bilinear model takes every position of every text as a target."""

import numpy as np
import pytest
from topograin.llm import lbl

WORDS = [f"w{i}" for i in range(12)]


def test_every_position_is_a_target(spark, monkeypatch):
    """Words in a ring of twelve: a target at every twelfth position alone would teach one of them."""
    monkeypatch.setattr(lbl, "TARGETS", 1, raising=False)  # for a corpus as small as this
    texts = spark.createDataFrame([(bytearray(" ".join(WORDS * 5000).encode()),)], "text binary")
    model, _ = lbl.fit(texts)
    hashes = np.array([lbl.token_hash(w.encode()) for w in WORDS])
    own = model.find(hashes, np.array([lbl.bucket(w.encode()) for w in WORDS]))[1]
    line, at = lbl.lines([np.tile(own, 3)], model.net.end, model.net.context)
    assert model.net.log10(line, at[12:]).min() > -0.1


def test_gradient_of_a_line_is_that_of_its_contexts():
    rng = np.random.default_rng(4)
    mass = rng.random(40)
    net = lbl.Net(mass / mass.sum(), 3, dimension=4, context=3)
    line, at = lbl.lines([rng.integers(0, 40, n) for n in (7, 0, 1, 30)], net.end, net.context)
    for some in (at, at[5:9], at[::3], at[:1]):
        one = net.line_gradient(line, some, np.random.default_rng(5), noise=8)
        two = net.gradient(line[some[:, None] - np.arange(1, 4)], line[some], np.random.default_rng(5), noise=8)
        assert one.keys() == two.keys()
        for name in one:
            assert one[name] == pytest.approx(two[name], rel=1e-4, abs=1e-5), name
