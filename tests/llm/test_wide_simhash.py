"""Wide SimHash fingerprints, their tables and the pairs the near-copy stage gets from them."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tarkash.llm import copies, simhash


def sets(n=60, size=90, seed=3):
    """Pairs of sets of similarity 0.8, and one group around a common core of similarity 0.5."""
    draw = random.Random(seed)
    new = lambda k: [draw.randrange(-(2**63), 2**63) for _ in range(k)]
    core, found = new(size * 2 // 3), []
    for _ in range(n):
        common = new(size * 8 // 9)
        found += [common + new(size // 9), common + new(size // 9)]
    return [np.unique(np.array(x, np.int64)) for x in [*found, *[core + new(size // 3) for _ in range(20)]]]


def test_wide_fingerprint_counts_votes():
    one, two, three = (np.array([x], np.int64) for x in (5, -9, 1 << 40))
    bits = lambda x: np.unpackbits(simhash.wide_fingerprint(x).view(np.uint8), bitorder="little")
    assert (bits(np.concatenate([one, two, three])) == (bits(one).astype(int) + bits(two) + bits(three) > 1)).all()
    assert not simhash.wide_fingerprint(np.zeros(0, np.int64)).any()
    far = [(bits(a) != bits(b)).mean() for a, b in zip(sets()[0:120:2], sets()[1:120:2], strict=True)]
    assert 0.13 < np.mean(far) < 0.17


@pytest.mark.parametrize("rows", [10, 1 << 22])
def test_tables_hold_all_similar_pairs_and_few_others(spark, rows):
    held = sets()
    table = [(i, len(x), simhash.wide_fingerprint(x).tolist(), i) for i, x in enumerate(held)]
    prints = spark.createDataFrame(table, "node long, n int, print array<long>, c long")
    got = {tuple(r) for r in simhash.crossing(prints, rows).where("b is not null").distinct().collect()}
    alike = {(i, i + 1) for i in range(0, 120, 2)}
    assert alike <= got and len(got) < len(alike) + 250
    close = {tuple(r) for r in spark.createDataFrame(sorted(got), "a long, b long").join(prints.selectExpr("node a", "print x"), "a").join(prints.selectExpr("node b", "print y"), "b").where(simhash.within("x", "y")).select("a", "b").collect()}
    assert alike == close
    assert simhash.crossing(prints.withColumn("c", prints.c * 0), rows).count() == 0
    assert simhash.segments(prints).groupBy("node").count().where("count <> 32").count() == 0


def test_overfull_buckets_tell_their_members():
    key, n, c = np.zeros(40, np.uint16), np.full(40, 9), np.arange(40)
    words = np.zeros((40, simhash.CHECK), np.uint64)
    a, b, full = simhash.bucket_pairs(key, n, c, words, 0.8)
    assert len(a) == len(b) == 0 and sorted(full) == list(range(40))
    a, b, full = simhash.bucket_pairs(key[:3], np.array([9, 8, 4]), c[:3], words[:3], 0.8)
    assert [(int(a[0]), int(b[0]))] == [(0, 1)] and len(a) == 1 and not len(full)


def test_stage_takes_its_candidates_from_fingerprints(spark, monkeypatch):
    asked = []
    whole = simhash.crossing
    monkeypatch.setattr(copies, "crossing", lambda *x: asked.append(x) or whole(*x))
    draw = random.Random(1)
    words = [draw.choice("abcdefgh") + str(draw.randrange(900)) for _ in range(150)]
    texts = [" ".join(words), " ".join(["edit", *words[1:75], "edit", *words[76:]]), "the other text of this table has few words", "the other text of this table has few words more"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert asked and kept == {0, 2}
