import math
from collections import Counter

import pytest

from dossier.llm import mixing

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(mixing.VOCABULARY), reason="no vocabulary")


@pytest.mark.parametrize(("rate", "cap"), [(0.1, 1), (1.0, 2), (2.5, 3), (8.0, 4)])
def test_rates_invert(rate, cap):
    pmf = [math.exp(-rate) * rate**k / math.factorial(k) for k in range(60)]
    mean = sum(min(k, cap) * p for k, p in enumerate(pmf))
    assert mixing.capped_mean(rate, cap) == pytest.approx(mean)
    assert mixing.rate_for(mean, cap) == pytest.approx(rate, rel=1e-6)
    assert mixing.cumulative(rate, cap) == pytest.approx([sum(pmf[: k + 1]) for k in range(cap)])


def test_great_means():
    """A mean of a thousand under a cap of two thousand: the first term of the row is zero in floating point, the mean is kept."""
    rate = mixing.rate_for(1000.0, 2000)
    assert mixing.capped_mean(rate, 2000) == pytest.approx(1000.0)
    steps = mixing.cumulative(rate, 2000)
    assert sum(1 - x for x in steps) == pytest.approx(1000.0)
    assert mixing.cumulative(0.0, 3) == [1.0, 1.0, 1.0]


def test_mix(spark):
    docs = [(k, f"text number {k} of the large source with some words", "large") for k in range(3000)] + [(5000 + k, f"small text {k}", "small") for k in range(400)] + [(9000, "small text 1", "small"), (9001, "small text 2", "large"), (9002, None, "small"), (9003, " ", "small"), (9004, "x", None), (9005, "other", "nowhere")]
    targets = [("large", 0.8, 1), ("small", 0.2, 4), ("absent", 0.1, 2)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    rows = mixing.mix(documents, wanted).collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in mixing.mix(documents.repartition(7), wanted).collect()]
    used = Counter(r.text for r in rows)
    assert max(v for t, v in used.items() if t.startswith("text")) <= 1
    assert max(v for t, v in used.items() if t.startswith("small")) <= 4
    report = {r.source: r for r in mixing.shares(documents, wanted).collect()}
    assert report["absent"].actual_share == 0
    assert report["small"].actual_share == pytest.approx(0.2, abs=0.03)
    assert sum(r.n_tokens for r in rows) == sum(r.tokens for r in report.values())
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)
    assert mixing.mix(documents.limit(0), wanted).count() == 0
