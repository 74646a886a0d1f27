"""The training-data operators against brute force, and their edge cases.

Edge cases of each: nulls in any column, empty and very long texts, ties, repeated rows, an empty
table, and extra columns with the operators' own names.
"""

import hashlib
import math
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarkash.llm import eliasfano, lines, maxscore, mixing, neighbours, pieces, pii, queries, simhash, toxicity, trie, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, text_id string"
ODD = ["", None, " ", "a", "A a", "x" * 30000, "the cat " * 9000, "one two three four five", "one two three four five", "Ünï 🙂 ▁▁x\n\n  y", "\x1c b \u2003 c", "1.2.3.4 a@b.co +1 (555) 123-4567 4111 1111 1111 1111"]


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s1"] * len(texts))[i], None, 1.0, 2, "z") for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, None, None, None)] if texts else []
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_elias_fano_round_trip_and_search():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (1, 2**62), (300, 50), (5000, 2**40), (9000, 3)):
        v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = eliasfano.EliasFano.encode(v)
        arrays, facts = eliasfano.load(eliasfano.dump(ef.arrays(), {"x": (ef.n, ef.low)}))
        ef = eliasfano.EliasFano(*facts["x"], *(arrays[k] for k in eliasfano.EliasFano.PARTS))
        asked = rng.integers(0, top, 200).astype(np.uint64)
        assert (ef.access(np.arange(n)) == v).all() if n else True
        assert (ef.successor(asked) == np.searchsorted(v, asked)).all()
        assert ((ef.find(np.append(asked, np.uint64(2**62 + 1))) >= 0) == np.isin(np.append(asked, np.uint64(2**62 + 1)), v)).all()


def plain_model(rows, order):
    counts, totals, different = Counter(), Counter(), Counter()
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    for i, w in tokens:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            counts.update((x,) for x in w)
            for n in range(2, order + 1):
                counts.update(tuple([None, *w][a : a + n]) for a in range(len(w) + 2 - n))
    for gram, c in counts.items():
        if len(gram) > 1:
            totals[gram[:-1]] += c
            different[gram[:-1]] += 1
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    out = Counter()
    for i, w in tokens:
        base = score = 0.0
        s = [None, *w]
        for k in range(1, len(s)):
            p = (counts[s[k],] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for size in range(2, order + 1):
                context = tuple(s[max(0, k - size + 1) : k])
                if len(context) < size - 1 or not totals[context]:
                    break
                discount = trie.DISCOUNTS[min(size, 3) - 2]
                p = max(counts[*context, s[k]] - discount, 0) / totals[context] + discount * different[context] / totals[context] * p
            score += math.log10(p)
        out[i, len(w), sum((b,) in counts for b in w), n, round(base, 3)] += 1
        out[i, "score"] = score
    return out


@pytest.mark.parametrize("texts,order", [(ODD, 3), (ODD, 2), (ODD, 4), (ODD, 1), (["", None], 3), ([], 3)])
def test_trie_scores(spark, real, texts, order):
    docs = table(spark, texts)
    if texts is ODD:
        docs = docs.select("doc_id", "text").union(real.selectExpr("doc_id + 1000", "text")).union(real.where("doc_id < 9").selectExpr("doc_id + 1000", "text"))
    wanted = plain_model([tuple(r) for r in docs.select("doc_id", "text").collect()], order)
    got = trie.language_model_scores(docs, order=order).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == Counter({k: n for k, n in wanted.items() if len(k) > 2})
    assert all(abs(r.score - wanted[r.doc_id, "score"]) <= 0.02 * abs(wanted[r.doc_id, "score"]) + 0.05 * r.n_tokens for r in got)
    if texts is ODD and order > 1:
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_longer_contexts_score_held_out_text_better(spark, real):
    docs = real.select("doc_id", "text")
    held = [sum(r.score for r in trie.language_model_scores(docs, order=n).collect() if r.held_out) for n in (1, 2, 3)]
    assert held[0] < held[1] < held[2]


def test_cells_of_a_small_grid_give_the_same_scores(spark, real, monkeypatch):
    docs = real.select("doc_id", F.col("text"), F.lit(True).alias("held_out"))
    whole = {r.doc_id: (r.score, r.n_tokens) for r in trie.score(docs, trie.train(docs)).collect()}
    monkeypatch.setattr(trie, "SHARD_BYTES", 20_000)
    parts = {r.doc_id: r.score for r in trie.score(docs, trie.train(docs, shard_tokens=2000)).collect()}
    assert max(abs(x - parts[i]) / n for i, (x, n) in whole.items()) < 0.05


def test_pieces_equal_the_library(spark, real):
    import sentencepiece

    proto = queries.tokenizer()
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    docs = table(spark, ODD).select("doc_id", "text").union(real.selectExpr("doc_id + 1000", "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pieces.encode_documents(docs, proto, check_every=1).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded == library.decode(ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encode_documents(table(spark, []), proto).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in s) % 10 == 0

    def holds(kind, hit):
        d = re.sub("[^0-9]", "", hit)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0]))


def test_base_spans_equal_plain_patterns(spark, real):
    odd = [*ODD, "🙂 a@b.co_x@y.com..a@-.-.é", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255", "4111-1111-1111-1111-1 41111111111111111111", "+1 ((( 2) +123456789012345678 +1.2.3.4.5.6.7.8.", "9" * 30000, "1 " * 15000, "a.b" * 9000 + "@x", "+1 " + "( " * 9000 + "2", "call 555 123 4567 or joe [at] x [dot] com"]
    docs = table(spark, odd).select("doc_id", "text").union(real.selectExpr("doc_id + 1000", "text"))
    texts = dict(tuple(r) for r in docs.collect())
    got = pii.personal_data(docs).select("doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.b == plain_spans(texts[r.doc_id])
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    assert pii.personal_data(table(spark, [])).count() == 0


def test_planted_spans_are_added_and_plain_numbers_are_not(spark):
    plant = {"email": "mail joe [at] example [dot] org", "phone": "call (555) 123-4567", "name": "ask Dr. Miller", "secret": "ssn: ABCDEFGH"}
    texts = [f"page {i + 1000000} says {x} and version {20000 + i}.{100 + i}" for i in range(60) for x in plant.values()]
    docs = table(spark, [*texts, "order 12345678 and page 1234567", "iban: ABCDEFGH"])
    got = {r.doc_id: r.s for r in pii.personal_data(docs).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    for i, text in enumerate(texts):
        kind, hit = [(k, x.partition(" ")[2] if k != "secret" else x) for k, x in plant.items()][i % 4]
        at = text.index(hit)
        assert f"{kind}:{at}:{at + len(hit)}" in got[i].split(","), (text, got[i])
        assert not any(x.startswith(("phone:5", "number")) for x in got[i].split(","))
    assert got[240] == "" and got[241] == "secret:0:14"


@pytest.mark.parametrize("text,base,spans", [("id 1234567 or 555-123-4567, ", 0, 40000), ("a@b.co or +1 555 123 4567, ", 80000, 80000)])
def test_time_is_linear_in_the_spans_of_a_text(spark, text, base, spans):
    began = time.time()
    r = pii.personal_data(spark.createDataFrame([(1, text * 40000)] + [(i, "call 555-123-4567 or page 1234567") for i in range(2, 50)], "doc_id long, text string")).where("doc_id = 1").select(F.size("base").alias("b"), F.slice("spans", 39999, 2).alias("x"), F.size("spans").alias("n")).first()
    assert time.time() - began < 40 and r.b == base and r.n in (0, spans) and (r.n == 0 or r.x[0].s < r.x[1].s)


def test_repeated_and_clashing_rows_of_personal_data(spark):
    docs = spark.createDataFrame([(1, "a@b.co", 1, 2, "x")] * 2 + [(None, None, 1, 2, "x")], "doc_id long, text string, base int, email int, found string")
    got = pii.personal_data(docs).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()
    assert sorted(map(str, got)) == sorted(["Row(doc_id=1, s='email:0:6')"] * 2 + ["Row(doc_id=None, s='')"])


def test_em_trusts_the_labelers_that_agree():
    # three labelers agree on most items, the fourth says yes at random
    patterns = Counter()
    for i in range(400):
        truth = int(i % 4 == 0)
        patterns[truth, truth if i % 10 else 1 - truth, truth, i % 2, -1] += 1
    posterior, rates = pii.estimate(sorted(patterns.items()))
    assert posterior[1, 1, 1, 0, -1] > 0.9 > 0.1 > posterior[0, 0, 0, 0, -1]
    assert rates["base"][0] - rates["base"][1] > 0.8 > abs(rates["context"][0] - rates["context"][1])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int")


def sample_vectors(n=3000, size=16, seed=5):
    rng = np.random.default_rng(seed)
    points = (rng.standard_normal((n, size)) * 0.2).astype(np.float32)
    points[n // 2 : n // 2 + n // 3] = points[n // 2]  # a third are equal
    return points


ODD_VECTORS = [(100, None), (200, [float("nan")] * 16), (300, [None] * 16), (400, [float("inf")] * 16), (None, [0.1] * 16)]


@pytest.mark.parametrize("shard_rows,group_rows", [(8192, 8192), (700, 11)])
def test_nearest_recall_and_scores(spark, shard_rows, group_rows):
    points = sample_vectors()
    rows = [(i + 1000, p.tolist(), None, 1) for i, p in enumerate(points)] + [(i, v, None, 1) for i, v in ODD_VECTORS] + [(500, [0.0] * 16, None, 1)]
    got = neighbours.nearest(vectors(spark, rows), shard_rows=shard_rows, group_rows=group_rows).collect()
    exact = points.astype(np.float64)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(1000, 4000, 100):
        gaps = exact - exact[q - 1000]
        d = np.sqrt((gaps * gaps).sum(axis=1))
        d[q - 1000] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10] + 1000
        mine = sorted(by[q])
        assert [k for k, _, _ in mine] == list(range(1, 11))
        assert all(s == d[v - 1000] for _, v, s in mine)
        hits, total = hits + len({v for _, v, _ in mine} & set(best.tolist())), total + 10
    assert hits / total >= 0.9 and set(by) == set(range(1000, 4000, 100))
    assert neighbours.nearest(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("shard_rows,group_rows", [(8192, 8192), (100, 11)])
def test_maxscore_is_exact(spark, shard_rows, group_rows):
    points = sample_vectors(2500)
    rows = [(i + 1000, p.tolist(), None, 1) for i, p in enumerate(points)] + [(i, v, None, 1) for i, v in ODD_VECTORS] + [(500, [0.0] * 16, None, 1)]
    got = {}
    for r in maxscore.top_products(vectors(spark, rows), shard_rows=shard_rows, group_rows=group_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    z = {i + 1000: np.floor(p.astype(np.float64) * 256).astype(int) for i, p in enumerate(points)} | {500: np.zeros(16, int)}
    asked = [i for i in z if i % 50 == 0]
    assert set(got) == set(asked)
    for q in asked:
        best = sorted(((-int(v @ z[q]), i) for i, v in z.items() if i != q))[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert maxscore.top_products(vectors(spark, [])).count() == 0
    few = maxscore.top_products(vectors(spark, [(0, [0.5], None, 1), (1, [0.25], None, 1)])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, 128 * 64)]


def test_each_row_of_a_repeated_query_asks_for_itself(spark):
    rows = [(0, [1.0, 0.0], None, 1), (0, [0.0, 1.0], None, 1), (1, [1.0, 0.1], None, 1), (2, [0.1, 1.0], None, 1), (2, [0.1, 1.0], None, 1)]
    near = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.nearest(vectors(spark, rows), k=4).collect())
    assert near == [(0, 1, 1, 0.1), (0, 1, 2, 0.1), (0, 2, 2, 0.1), (0, 2, 2, 1.345362), (0, 3, 1, 1.345362), (0, 3, 2, 1.345362), (0, 4, 0, 1.414214), (0, 4, 0, 1.414214)]
    best = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_products(vectors(spark, rows), k=2).collect() if r.query_id == 0)
    assert best == [(0, 1, 1, 256 * 256), (0, 1, 2, 256 * 256), (0, 2, 2, 25 * 256), (0, 2, 2, 256 * 256)]


def test_few_rows_are_verified_on_the_supplied_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    points, n = np.stack(rows["embedding"]).astype(np.float64), len(rows)
    held = neighbours.index(64, {"rows": np.arange(n), "ids": rows["vec_id"].to_numpy(), "points": points}, 128, 7)
    asked = {k: held[k][::100] for k in ("rows", "ids", "points")}
    gaps = np.sqrt(((points[None] - asked["points"][:, None]) ** 2).sum(axis=2))
    radius = np.sort(gaps, axis=1)[:, 10]
    found = neighbours.search(held, asked, radius, n, math.erf(math.sqrt(0.5)) - 0.03, 1.0, 1.5, 40, neighbours.directions(64, 128, 7))
    assert sum(len(i) for _, i, _ in found) / len(found) / n < 0.12


def test_windows_count_alike_by_lists_and_by_ranks():
    rng = np.random.default_rng(1)
    held = neighbours.index(8, {"rows": np.arange(500), "ids": np.arange(500), "points": rng.standard_normal((500, 8))}, 16, 3)
    windows = neighbours.Windows(held, rng.standard_normal(16))
    onto = np.empty((16, 500))
    np.put_along_axis(onto, held["order"].astype(int), held["sorted"], axis=1)
    for half in (0.0, 0.01, 0.05, 0.3, 1.0, 100.0):
        assert (windows.counts(half) == (np.abs(onto - windows.at[:, None]) <= half).sum(axis=0)).all()


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return {f: root(f) for f in keys}


@pytest.mark.parametrize("heavy", [64, 1])
def test_simhash_components(spark, real, heavy):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8
    copies = [base + f"tail{i}" for i in range(40)] + [base] * 5
    docs = table(spark, ODD + copies).where("doc_id is not null").select("doc_id", "text").union(real.selectExpr("doc_id + 1000", "text"))
    texts = dict(tuple(r) for r in docs.collect())
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    roots = plain_components(set(prints.values()))
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    got = simhash.simhash_components(docs, heavy=heavy).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", least[roots[f]]) for i, f in prints.items()}


def test_simhash_keeps_one_and_all_columns(spark):
    docs = table(spark, ["a b c d", "a b c d", None, "", "other words in here"])
    docs = docs.union(docs.where("doc_id = 0"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "4", "None"]
    assert simhash.simhash_components(table(spark, [])).count() == 0


def test_grammar_weighs_clauses():
    s = toxicity.Scorer({}, {})
    assert s.clauses("you are an idiot") > s.clauses("the idiot") > s.clauses("he said idiot")
    assert s.clauses("you are not an idiot")[0] < s.clauses("you are an idiot")[0]
    assert s.clauses("i will kill you")[0] > s.clauses("kill the lights")[0]
    assert s.clauses("not so. idiot")[0] == 1.0 and s.clauses("") == []


def plain_clause(tags, window=3, threat=2.0, target=0.5, negation=1.5, reported=1.0):
    """The five rules of the grammar, each by itself and without any automaton."""
    total, hit = 0.0, (toxicity.INSULT, toxicity.THREAT)
    pending, open_ = False, None  # a threat that waits for its target; the last insult or target that has no partner yet
    for i, (tag, own) in enumerate(tags):
        total += own if tag == toxicity.INSULT else 0.0
        if tag == toxicity.THREAT:
            total, pending = total + 0.5, True
        elif tag == toxicity.TARGET and pending:
            total, pending = total + threat - 0.5, False
        if tag in (toxicity.INSULT, toxicity.TARGET):
            if open_ and open_[0] != tag and i - open_[1] <= window:
                total, open_ = total + target, None
            else:
                open_ = (tag, i)
        before = [t for t, _ in tags[max(0, i - window) : i]]
        total -= negation if tag in hit and toxicity.NEGATION in before else 0.0
        total -= reported if tag in hit and toxicity.REPORTED in [t for t, _ in tags[:i]] else 0.0
    return total


def test_the_composed_grammar_equals_its_rules(spark):
    rng, machine = np.random.default_rng(8), toxicity.grammar()
    for _ in range(3000):
        tags = [(int(t), float(rng.choice([0.5, 1.0, 1.7]))) for t in rng.integers(0, 6, rng.integers(0, 14))]
        assert abs(machine.weigh(tags) - plain_clause(tags)) < 1e-9, tags


def test_toxicity_query_equals_a_plain_scorer(spark, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = table(spark, ODD).select("doc_id", "text").union(real.selectExpr("doc_id + 1000", "text"))
    scorer = toxicity.learn(real, labels)

    def plain(text):
        clauses = []
        for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
            tags = [scorer.tag(w) for w in clause.split()]
            if any(t <= toxicity.THREAT for t, _ in tags):
                clauses.append(max(0.0, plain_clause(tags)))
        a, b, c = scorer.model
        x = a + b * min(4.0, max(clauses, default=0.0)) + c * min(3.0, math.log1p(sum(x > 0 for x in clauses)))
        return 1 / (1 + math.exp(-x))

    for r in toxicity.toxicity(docs, scorer).collect():
        assert abs(r["__tk_score"] - plain(r.text)) < 1e-9 and r["__tk_toxic"] == int(plain(r.text) >= 0.7)


def test_toxicity_learns_on_training_rows_only(spark):
    texts = [f"some plain words number{i} here" + (" grobnak" if i % 4 == 0 else "") for i in range(400)]
    docs = table(spark, [*texts, "", None, "you grobnaks " * 9000])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 404 and all(0 <= r["__tk_score"] <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and all(r["__tk_toxic"] == int(r.doc_id % 4 == 0) for r in held)
    none = toxicity.learn(docs, labels.limit(0))
    assert toxicity.toxicity(table(spark, []), none).count() == 0


def same(spark_rows, duck, sql):
    wanted = duck.sql(sql)
    columns = sorted(wanted.columns)
    rows = [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()]
    one = lambda r: tuple(str(r[c]) for c in columns)
    assert sorted(columns) == sorted(spark_rows.columns)
    assert sorted(map(one, (r.asDict() for r in spark_rows.collect()))) == sorted(map(one, rows))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


@pytest.mark.parametrize("few", [200_000, 0])
def test_lines_go_by_share_of_the_host(spark, few):
    texts = ["menu\nown 1", " menu \nown 2\nmenu", "menu\n\nown 3", "own 4", "own 5\nrare", None, "", "menu\nelse", "menu\ntwo"]
    hosts = ["h"] * 7 + ["few"] * 2
    docs = table(spark, texts, hosts)
    got = {r.doc_id: (r["__tk_text"], r["__tk_dropped"], r["__tk_lines"]) for r in lines.site_lines(docs, F.col("text"), F.col("source"), 0.4, few=few).collect()}
    assert got[0] == ("own 1", 1, 2) and got[1] == ("own 2", 2, 3) and got[2] == ("\nown 3", 1, 3)
    assert got[4] == ("own 5\nrare", 0, 2) and got[5] == ("", 0, 1) and got[7] == ("menu\nelse", 0, 2) and got[None] == ("no id", 0, 1)
    assert lines.site_lines(table(spark, []), F.col("text"), F.col("source")).count() == 0


def test_a_small_host_keeps_its_own_lines(spark):
    docs = table(spark, [f"own {i}\nalso {i}\n" + ("both" if i < 2 else "rest") for i in range(6)])
    got = {r.doc_id: r["__tk_text"] for r in lines.site_lines(docs, F.col("text"), F.col("source"), 0.1).collect()}
    assert got[0] == "own 0\nalso 0\nboth" and got[5] == "own 5\nalso 5"


def test_clashing_columns_stay(spark):
    names = ["__tk_text", "__tk_host", "__tk_lines", "__tk_dropped", "__tk_score", "__TK_Toxic", "__tk_domain", "__tk_tokens", "__tk_copies", "__tk_grant", "row", "host", "key", "tokens", "n"]
    docs = table(spark, ["a b c", None, "a b c", "d"]).withColumns({n: F.lit(f"own {n}") for n in names})
    outs = [
        lines.site_lines(docs, F.col("text"), F.col("source")),
        toxicity.toxicity(docs, toxicity.Scorer({}, {})),
        mixing.mix(docs, queries.domain(), {}, 1.0, 1),
        urls.UrlTrees().fit(spark.createDataFrame([("http://a/b", 1)], "url string, label int")).score(docs.withColumnRenamed("text", "url"), "__tk_score"),
    ]
    for out, more in zip(outs, (["__tk_host_", "__tk_text_", "__tk_lines_", "__tk_dropped_"], ["__tk_score_", "__tk_toxic_"], ["__tk_domain_", "__tk_tokens_", "__tk_copies_", "__tk_grant_"], ["__tk_score_"]), strict=True):
        rows = out.collect()
        assert out.columns[-len(more) :] == more and len(rows) == docs.count()
        assert all(r[n] == f"own {n}" for r in rows for n in names)


@pytest.mark.parametrize("share,epochs,short", [(0.4, 1, 4096), (0.4, 1, 1), (1.6, 2, 4096), (1.6, 2, 0), (5.0, 3, 4096)])
def test_mixing_equals_sql(spark, share, epochs, short, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 1 if short < 2 else 3)
    monkeypatch.setattr(mixing, "FEW_LEAVES", 0 if short == 1 else 100_000)
    texts = [("w " * (i % 7)).strip() if i % 11 else None for i in range(300)]
    docs = table(spark, texts, [f"src{i % 3 * (i % 2)}" if i % 13 else None for i in range(300)])
    docs = docs.union(docs.where("doc_id < 5"))
    out = mixing.mix(docs, queries.domain(), queries.WEIGHTS, share, epochs, 3, short)
    out = out.select("doc_id", F.col("__tk_domain").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("__tk_tokens").alias("tokens"), F.col("__tk_copies").alias("copies"), F.col("__tk_grant").alias("grant_tokens"))
    duck = duckdb.connect()
    documents = docs.select("doc_id", "text", "lang", "source").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    duck.register("documents", documents)
    same(out, duck, mixing.oracle(queries.DOMAIN_SQL, queries.WEIGHTS, share, epochs, 3))
    assert mixing.mix(table(spark, []), queries.domain(), {}).count() == 0


def plain_rule(host, path):
    fit = [(len(r), v, r) for v, r in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fit)[1:] if fit else (None, None)


def test_urls(spark):
    odd = [None, "", "nothing", "http://", "HTTP://A.EXAMPLE.com/en/7x?y#z", "http://example.net/de/8", "x://net/de/", "x://com?en/", "http://a.b://c.com/en/", "http://h/" + "a" * 20000, "http://É.com#/en/", "a\n://Com/en/\nz", "http://a\0b/c\0d"]
    odd += [f"http://{'cheap-pills' if i % 5 == 0 else 'garden' + 'abc'[i % 3]}.example.org/fr/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, None, 1.0) for i, u in enumerate(odd)], "page_id long, url string, html string, score double")
    got = urls.judge(pages, queries.RULES, urls.weak_labels(pages, queries.SPAM_WORDS)).collect()
    assert len(got) == len(odd)
    for r in got:
        rest = (odd[r.page_id] or "").partition("://")[2] if "://" in (odd[r.page_id] or "") else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
        assert (r.host, r.path) == (host, m[2])
        verdict, rule = plain_rule(host, m[2])
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
        if r.page_id >= 13:
            assert r.verdict == ("block" if "pills" in r.host else "allow")
    empty = pages.limit(0)
    assert urls.judge(empty, queries.RULES, urls.weak_labels(empty, queries.SPAM_WORDS)).count() == 0


def test_of_equally_long_rules_the_first_counts(spark):
    pages = spark.createDataFrame([("a.com", "/en/abc")], "h string, p string")
    for rules, verdict in (([("block", "a.com/en/"), ("allow", "com/en/ab")], "block"), ([("allow", "com/en/ab"), ("block", "a.com/en/")], "allow")):
        assert pages.select(urls.fitting_rule(F.col("h"), F.col("p"), rules)["verdict"]).first()[0] == verdict


SIGNALS = {"length": ("abcd", "abcdabcd"), "depth": ("abcdabcd", "a/c/a/c/"), "digits": ("abcdabcd", "1bc2ab3d"), "entropy": ("aaaabbbb", "abcdefgh"), "params": ("?a~b&c~d", "?a=b&c=d"), "suffix2_rate": ("abcd", "abcd")}


@pytest.mark.parametrize("feature", SIGNALS)
def test_a_tree_splits_on_each_named_feature(spark, feature):
    rows = [(f"http://h.{'ab'[i % 2] if feature.startswith('suffix') else 'a'}bc.org/{SIGNALS[feature][i % 2]}{'xyzuvw'[i % 6 // 2]}{chr(103 + i % 7)}{chr(103 + i // 7 % 11)}", i % 2) for i in range(800)]
    model = urls.UrlTrees(trees=1, depth=1).fit(spark.createDataFrame(rows, "url string, label int"))
    assert {f for tree in model.model for tests, _ in tree for f, _, _ in tests} == {feature}
    assert model.held_out(spark.createDataFrame(rows, "url string, label int"), 0.5)[1::2] == (0, 0)


def test_repeated_and_clashing_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "u", "v", "w", 1.0)] * 2 + [(None, None, "u", "v", "w", 1.0)], "page_id long, url string, host string, path string, rule string, score double")
    got = urls.judge(pages, queries.RULES, urls.weak_labels(pages, queries.SPAM_WORDS)).collect()
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got) == [("1", "a.com", "/x", None, "allow")] * 2 + [("None", "", "", None, "allow")]


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] >= sizes[4] > 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == sizes[4]
