"""The URL model on more URLs than it takes of a label."""

import math

from tarkash.llm import urls


def test_sample_keeps_the_prior_and_all_suffixes(spark):
    rows = [(f"http://h{i}.{'bad' if i % 20 == 0 else 'good'}{i % 40}.org/x/{i}", int(i % 20 == 0)) for i in range(2000)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    model = urls.UrlTrees(trees=2, sample=100).fit(labelled)
    mean = 100.5 / 2001
    assert abs(model.base - math.log(mean / (1 - mean))) < 1e-9
    counts = {r.suffix: r for r in model.suffixes[2].collect()}
    assert len(counts) == 40
    assert all((r.n, r.bad) == (50, 50 if s.startswith("bad") else 0) for s, r in counts.items())
    assert all(sum(r.fold_n) == r.n and sum(r.fold_bad) == r.bad for r in counts.values())
    noise = spark.createDataFrame([(f"http://h{i}.same.org/x/{i}", int(i % 20 == 0)) for i in range(2000)], "url string, label int")
    scores = [r.score for r in urls.UrlTrees(trees=2, sample=100).fit(noise).score(noise).collect()]
    assert sum(scores) / len(scores) < 0.2
