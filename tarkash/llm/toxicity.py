"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become tags (insult, threat, target, negation, reported speech, other). Five small
transducers read a clause's tags; each keeps its own state and adds a weight: an insult counts as
much as its word weighs, a threat counts more once a target follows, a target near an insult adds,
a negation shortly before takes off, reported speech earlier in the clause takes off. Their
composition is one transducer whose states are tuples and whose weights add up, and a clause's score
is the weight of its path. A weight is a pair: what counts times the word's own weight, which only
the insult transducer uses, and what counts as it is.
A document's score is a logistic function of its best clause and of how many clauses match.

The seed lexicon is extended by words and word beginnings that mark labelled toxic training
documents, with their smoothed log odds as lexical weights; the logistic function is fitted on the
same documents. Both use a bounded sample of labelled rows, the parameter ``sample``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.llm.common import cut, free_name, remainder

INSULT, THREAT, TARGET, NEGATION, REPORTED, OTHER = range(6)
SEEDS = {
    INSULT: "idiot idiots moron morons scum trash loser losers clown stupid pathetic worthless disgusting dumb fool imbecile idiota estúpido estúpida basura idiote débile ordure crétin dummkopf abschaum",
    THREAT: "kill hurt destroy beat punch strangle töten matar tuer",
    TARGET: "you your yours yourself u ihr du dich dein tú usted tu toi vous",
    NEGATION: "not never no isn't aren't wasn't don't nicht kein nie nunca jamás jamais",
    REPORTED: "said says wrote called quoted claims reported sagte schrieb dijo dit écrit",
}
SCORE, TOXIC = "__tk_score", "__tk_toxic"
CLAUSE = re.compile(r"[.!?;:\n]+")
STRIP = ".,!?;:\"'()[]{}<>*%&$#«»¿¡…-_|"


Weight = tuple[float, float]
NOTHING: Weight = (0.0, 0.0)


class Transducer:
    """States 0..n-1 from 0; ``arcs[state][tag]`` is (next state, weight by the word, fixed weight)."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple[int, float | Weight]]) -> None:
        self.arcs = [[(s, *NOTHING) for _ in range(6)] for s in range(states)]
        for (s, t), (to, weight) in arcs.items():
            self.arcs[s][t] = (to, *(weight if isinstance(weight, tuple) else (0.0, weight)))

    def compose(self, other: Transducer) -> Transducer:
        """The transducer that runs both and adds their weights; only reachable states are made."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        for a, b in todo:
            for t in range(6):
                (x, v, p), (y, w, q) = self.arcs[a][t], other.arcs[b][t]
                if (x, y) not in number:
                    number[x, y] = len(number)
                    todo.append((x, y))
                arcs[number[a, b], t] = (number[x, y], (v + w, p + q))
        return Transducer(len(number), arcs)

    def weigh(self, tags: list[tuple[int, float]]) -> float:
        """The weight of the path of (tag, the word's own weight)."""
        state, total, arcs = 0, 0.0, self.arcs
        for tag, own in tags:
            state, by_word, fixed = arcs[state][tag]
            total += by_word * own + fixed
        return total


def grammar(window: int = 3, threat: float = 2.0, target: float = 0.5, negation: float = 1.5, reported: float = 1.0) -> Transducer:
    """Insult, threat, target, negation and reported speech, composed."""
    insult = Transducer(1, {(0, INSULT): (0, (1.0, 0.0))})
    threats = Transducer(2, {(0, THREAT): (1, 0.5), (1, TARGET): (0, threat - 0.5), (1, THREAT): (1, 0.5)})
    near = {(0, INSULT): (window, 0.0), (0, TARGET): (2 * window, 0.0)}
    for k in range(1, window + 1):
        near |= {(k, t): (k - 1, 0.0) for t in (NEGATION, REPORTED, OTHER, THREAT)} | {(k, INSULT): (window, 0.0), (k, TARGET): (0, target)}
        j = window + k
        near |= {(j, t): (0 if k == 1 else j - 1, 0.0) for t in (NEGATION, REPORTED, OTHER, THREAT)} | {(j, TARGET): (2 * window, 0.0), (j, INSULT): (0, target)}
    targets = Transducer(2 * window + 1, near)
    down = {}
    for k in range(window + 1):
        down |= {(k, t): (max(0, k - 1), 0.0) for t in (TARGET, REPORTED, OTHER)} | {(k, NEGATION): (window, 0.0)}
        down |= {(k, t): (max(0, k - 1), -negation if k else 0.0) for t in (INSULT, THREAT)}
    negations = Transducer(window + 1, down)
    reports = Transducer(2, {(0, REPORTED): (1, 0.0), (1, INSULT): (1, -reported), (1, THREAT): (1, -reported)})
    out = insult
    for part in (threats, targets, negations, reports):
        out = out.compose(part)
    return out


class Scorer:
    """Tags words by lexicon and weighs clauses by the grammar."""

    def __init__(self, learned: dict[str, float], starts: dict[str, float], model: tuple[float, float, float] = (-4.0, 2.0, 0.5)) -> None:
        self.tags = {w: (tag, 1.0) for tag, words in SEEDS.items() for w in words.split()}
        self.tags |= {w: (INSULT, x) for w, x in learned.items() if self.tags.get(w, (INSULT,))[0] == INSULT}
        self.starts, self.model, self.grammar = starts, model, grammar()
        self.lengths = sorted({len(s) for s in starts}, reverse=True)
        self.known: dict[str, tuple[int, float]] = {}

    def tag(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            bare = word.strip(STRIP)
            found = self.tags.get(bare, (OTHER, 0.0))
            start = next((self.starts[bare[:n]] for n in self.lengths if len(bare) >= n and bare[:n] in self.starts), 0.0)
            if found[0] in (INSULT, OTHER) and start > found[1]:
                found = (INSULT, start)
            if len(self.known) > 200_000:
                self.known.clear()
            if len(word) <= 40:
                self.known[word] = found
        return found

    def clauses(self, text: str) -> list[float]:
        """The scores of the clauses that hold an insult or a threat; negative ones are 0."""
        text = text.lower()
        tag, out = self.tag, []
        if not any(tag(w)[0] <= THREAT for w in set(text.split())):
            return out
        for clause in CLAUSE.split(text):
            tags = [tag(w) for w in clause.split()]
            if any(t <= THREAT for t, _ in tags):
                out.append(max(0.0, self.grammar.weigh(tags)))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        found = self.clauses(text or "")
        return (min(4.0, max(found, default=0.0)), min(3.0, math.log1p(sum(x > 0 for x in found))))

    def score(self, text: str | None) -> float:
        best, matches = self.features(text)
        a, b, c = self.model
        return 1 / (1 + math.exp(-(a + b * best + c * matches)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled training rows, the first by hash.

    Training rows are those whose crc32(doc_id) modulo 3 is not 1; labels other than 0 and 1 are
    left out. Only ids, at most ``sample``, are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(remainder("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


def fit(rows: DataFrame, least: int = 5, odds: float = 2.5) -> Scorer:
    """The lexicon and the logistic function from (text, toxic) rows of bounded number; copies count once.

    A word or word beginning (5 to 7 letters) joins if it stands in ``least`` toxic documents and
    its smoothed log odds reach ``odds`` over the share of toxic documents; a beginning whose
    shorter form joined is left out. Both are bounded by the sample's texts; none is cut off.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set()
                for word in set(text.lower().split()):
                    bare = word.strip(STRIP)
                    if len(bare) >= 2:
                        seen.add(bare)
                        seen.update(bare[:n] + "\0" for n in range(5, 8) if len(bare) > n)
                counts.update((w, toxic) for w in seen)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["w", "toxic", "n"])

    rows = cut(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))
    sizes = dict(rows.groupBy("toxic").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Scorer({}, {})
    counts = rows.mapInArrow(tokens, "w string, toxic int, n long").groupBy("w").agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    found = {r.w: r.x for r in counts.where(F.col("bad") >= least).withColumn("x", weight).where(F.col("x") >= odds).collect()}
    starts = {w[:-1]: x for w, x in found.items() if w.endswith("\0")}
    starts = {w: x for w, x in starts.items() if not any(w[:n] in starts for n in range(5, len(w)))}
    words = {w: x for w, x in found.items() if not w.endswith("\0")}
    scale = lambda x: min(2.0, x / 4)
    scorer = Scorer({w: scale(x) for w, x in words.items()}, {w: scale(x) for w, x in starts.items()})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([round(a, 2) for a, _ in got], pa.float64()), pa.array([round(b, 2) for _, b in got], pa.float64()), batch.column(1).cast(pa.int32())], ["best", "matches", "toxic"])

    table = rows.mapInArrow(features, "best double, matches double, toxic int").groupBy("best", "matches", "toxic").count().collect()
    scorer.model = _logistic([((1.0, r.best, r.matches), r.toxic, r["count"]) for r in table])
    scorer.known.clear()
    return scorer


def _logistic(rows: list[tuple[tuple[float, ...], int, int]], rounds: int = 400, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Weighted logistic regression by gradient steps with a bound on each; weights of evidence stay positive."""
    w = [-3.0, 1.0, 0.5]
    total = sum(n for _, _, n in rows)
    for _ in range(rounds):
        step = [0.0] * 3
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, v in enumerate(x):
                step[i] += n * (y - p) * v / total
        w = [a + 4.0 * (s - ridge * a) for a, s in zip(w, step, strict=True)]
        w[1:] = [max(0.05, v) for v in w[1:]]
    return w[0], w[1], w[2]


def toxicity(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` and __tk_score, __tk_toxic (1 if the score reaches ``threshold``).

    A null or empty text has no clauses and gets the model's lowest score. Repeated rows stay, an
    empty table gives none. A column of ``docs`` with a result's name stays, and the result's name
    gets underscores. The lexicon goes with the task; the sample it was learned from bounds it.
    """
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())

    found, toxic = free_name(docs, SCORE), free_name(docs, TOXIC)
    out = docs.withColumn(found, score(F.col("text").cast("string")))
    return out.withColumn(toxic, (F.col(found) >= threshold).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Scorer:
    return fit(labelled_sample(docs, labels, sample))
