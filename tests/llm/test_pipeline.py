"""The whole pipeline against a plain version, and every stage on odd rows and an empty table."""

import hashlib
import re
import struct
from collections import Counter

import corpus_pipeline as p
import duckdb
import pytest
from test_copies import plain
from test_llm import plain_clause

from tarkash.llm import mixing, queries, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __tk_row int, row string, __tk_text string, __tk_score string, __tk_toxic string, __tk_dropped string, __tk_copies string, __tk_epoch string"
ODD = [
    (1, None, None, None, None), (2, "", "en", "src1", 0), (3, "the cat " * 20000, "en", "src2", 160000), (4, "same words here now and then", "en", "src1", 28), (5, "same words here now and then", "en", "src1", 28),
    (5, "same words here now and then", "en", "src1", 28), (None, "no id", "en", "src1", 5), (None, None, None, None, None), (6, "\n\n \n", "de", "src0", 4),
]


def odd(spark):
    return spark.createDataFrame([(*r, 1, "a", "b", "c", "d", "e", "f", "g") for r in ODD], DOCS)


def test_run_equals_a_plain_pipeline(spark):
    import sentencepiece

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    scorer = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))

    def toxic(text):
        found = []
        for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
            tags = [scorer.tag(w) for w in clause.split()]
            found += [max(0.0, plain_clause(tags))] if any(t <= toxicity.THREAT for t, _ in tags) else []
        best, matches = min(4.0, max(found, default=0.0)), min(3.0, float(__import__("math").log1p(sum(x > 0 for x in found))))
        a, b, c = scorer.model
        return a + b * best + c * matches >= __import__("math").log(0.7 / 0.3) - 1e-12

    docs = [d for d in docs if not toxic(d["text"])]
    pages, held = Counter(d["source"] or "" for d in docs), Counter()
    trim = lambda x: x.strip(" \t\r")
    for d in docs:
        held.update((d["source"] or "", k) for k in {trim(x) for x in (d["text"] or "").split("\n")} - {""})
    gone = {k for k, n in held.items() if n >= p.LINE_HELD and n > p.LINE_RATIO * pages[k[0]]}
    for d in docs:
        if d["text"]:
            d["text"] = "\n".join(x for x in d["text"].split("\n") if (d["source"] or "", trim(x)) not in gone)
    classes = plain({d["doc_id"]: d["text"] for d in docs})
    docs = [d for d in docs if classes[d["doc_id"]] == d["doc_id"]]
    duck = duckdb.connect()
    import pandas as pd

    duck.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    copies = {r[0]: r[1] for r in duck.sql("SELECT doc_id, copies FROM (" + mixing.oracle(queries.DOMAIN_SQL, queries.WEIGHTS, p.SHARE, p.EPOCHS, p.SEED) + ")").fetchall()}
    library, wanted = sentencepiece.SentencePieceProcessor(model_proto=queries.tokenizer()), Counter()
    for d in docs:
        ids = library.encode(d["text"] or "", add_bos=True, add_eos=True)
        wanted[d["doc_id"], hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()] += copies.get(d["doc_id"], 0)
    got = Counter((r.doc_id, r.ids_sha256) for r in p.run(spark, SF).collect())
    assert got == +wanted and len(got) > 20


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows_and_on_none(spark, number):
    name, stage = p.STAGES[number]
    docs = odd(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if number < 4:
        assert out.columns == docs.columns
        assert all((r["__tk_row"], r["row"], r["__tk_text"], r["__tk_copies"], r["__tk_epoch"]) == (1, "a", "b", "f", "g") for r in rows)
    ids = Counter(r.doc_id for r in rows)
    if number in (0, 1, 4):
        assert ids == Counter(r[0] for r in ODD), name
    if number == 1:
        assert {r.text for r in rows if r.doc_id == 1} == {None} and {r.text for r in rows if r.doc_id == 2} == {""}
    if number == 2:
        assert ids == Counter({1: 1, 3: 1, 4: 1, None: 2})
    if number == 3:
        assert ids[1] <= p.EPOCHS and set(ids) <= {r[0] for r in ODD}
    if number == 4:
        assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {2}


def test_folders_of_a_run_are_released(spark):
    from tarkash.llm.common import made, release

    before = set(made())
    out = p.run(spark, SF)
    assert out.count() > 0 and len(set(made()) - before) <= 1
    release(*(set(made()) - before))
