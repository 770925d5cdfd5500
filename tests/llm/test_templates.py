"""Near copies among many documents of one template, which share band keys with what is less like them."""

import numpy as np
import pytest

from tessera.llm import minhash


def templated(n, planted=40, seed=3):
    """Texts of 200 words, 70 of them fixed, the others one of 5; the last ``planted`` texts differ from as many others in 14 words."""
    draws = np.random.default_rng(seed).integers(0, 5, (n, 200))
    draws[:, :70] = 0
    rng = np.random.default_rng(seed + 1)
    origin = rng.choice(n // 2, planted, replace=False) + n // 4
    for k, o in enumerate(origin):
        draws[n - planted + k] = draws[o]
        for at in 70 + rng.choice(130, 14, replace=False):
            draws[n - planted + k, at] += 10
    words = np.array([[f"w{i}x{v}" for v in range(20)] for i in range(200)])
    texts = [" ".join(words[np.arange(200), row]) for row in draws]
    return texts, [(int(o), n - planted + k) for k, o in enumerate(origin)]


@pytest.mark.parametrize("n", [500, 5_000, 20_000])
def test_near_copies_among_templates(spark, n):
    texts, pairs = templated(n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in minhash.components(docs, words=1, percent=85).collect()}
    assert len(found) == n
    assert [found[b] for _, b in pairs] == [a for a, _ in pairs]
    assert sum(c != d for d, c in found.items()) == len(pairs)
