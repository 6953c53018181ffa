"""Held-out accuracy and calibration of the quality classifier."""

import numpy as np

from citeloom.llm.classifier import fit, quality_classifier
from citeloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_accuracy_on_labels_held_out(spark):
    labels = table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality_classifier(table(spark, SF, "documents"), labels.filter("doc_id % 2 = 0")).collect()}
    rest = [(got[r.doc_id], r.quality) for r in labels.filter("doc_id % 2 = 1").collect() if got[r.doc_id].probability is not None]
    right = sum(r.keep == bool(q) for r, q in rest)
    assert len(rest) > 100 and right >= 0.93 * len(rest)
    loss = -np.mean([np.log(max(1e-9, r.probability if q else 1 - r.probability)) for r, q in rest])
    base = np.mean([q for _, q in rest])
    assert loss < -(base * np.log(base) + (1 - base) * np.log(1 - base))


def test_temperature_lowers_the_loss_of_noisy_labels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = fit(x, y, steps=1500)
    new = rng.normal(size=(4000, 8))
    p = 1 / (1 + np.exp(-2 * new[:, 0]))
    cross = lambda q: -np.mean(p * np.log(q) + (1 - p) * np.log(1 - q))
    calibrated = cross(np.clip(net.probability(new), 1e-6, 1 - 1e-6))
    net.temperature = 1.0
    assert calibrated < cross(np.clip(net.probability(new), 1e-6, 1 - 1e-6))
