"""URL filters: rules by host and path, and boosted trees on lexical features, without Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarkash.llm.common import cut, free_name, packed_row, release, stored, unpacked_row, with_side
from tarkash.llm.lines import after_scheme, host_of

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/?=&%#:@"
LEVELS = (2, 3)  # labels of a host's end whose share of bad URLs is counted
FEATURES = ("length", "depth", "digits", "entropy", "params", "host_length", *(f"suffix{k}_rate" for k in LEVELS))
FOLDS = 5


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null.

    A rule is (verdict, host/path); it fits its host and all subdomains if the path starts with
    the rule's. Of two equally long rules the first in the list counts.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last test comes first
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def suffix_of(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def lexical(url: Column, host: Column) -> dict[str, Column]:
    """Features of a URL that need no statistics; a null URL counts as empty."""
    text = F.lower(F.coalesce(url, F.lit("")))
    length = F.length(text)
    held = [(length - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in ALPHABET]
    n = sum(held[1:], held[0])
    plogp = [F.when(h > 0, h * F.log2(h)).otherwise(0.0) for h in held]
    digits = sum((held[ALPHABET.index(c)] for c in "123456789"), held[ALPHABET.index("0")])
    return {
        "length": length.cast("double"),
        "depth": held[ALPHABET.index("/")],
        "digits": F.when(length > 0, digits / length).otherwise(0.0),
        "entropy": F.when(n > 0, F.log2(n) - sum(plogp[1:], plogp[0]) / n).otherwise(0.0),
        "params": held[ALPHABET.index("=")],
        "host_length": F.length(host).cast("double"),
    }


class UrlTrees:
    """Boosted trees on binned features, trained by histogram sums.

    ``fit`` takes labelled(url, label) and learns from at most ``sample`` URLs of each label, the
    first by hash, each weighted by its label's URLs over those taken; the prior and the rates of
    the suffixes are counted on all. One fold of five, by a hash of the URL, is held out: no tree
    sees it, and ``held_out`` measures on it. A training row's suffix rates leave out its own fold
    and the held-out one, so a row's label never reaches its features. Each level of a tree is one
    aggregation over the bounded sample: weighted gradient sums by leaf, feature and bin. The trees
    are kept as thresholds and become one column expression.
    """

    def __init__(self, trees: int = 10, depth: int = 3, rate: float = 0.4, bins: int = 12, sample: int = 10_000, prior: float = 5.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.sample, self.prior = trees, depth, rate, bins, sample, prior
        self.base, self.mean, self.model, self.edges = 0.0, 0.5, [], {}
        self.suffixes: dict[int, DataFrame] = {}
        self.few: dict[int, bool] = {}
        self.pending: list = []

    def _count_suffixes(self, known: DataFrame) -> None:
        """For each suffix, its labelled and bad URLs, in all and by fold."""
        for k in LEVELS:
            parts = known.groupBy(suffix_of(host_of(F.col("url")), k).alias("suffix"), "fold").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
            by_fold = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)) for c in ("n", "bad") for f in range(FOLDS)]
            table = parts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.array(*by_fold[:FOLDS]).alias("fold_n"), F.array(*by_fold[FOLDS:]).alias("fold_bad"))
            self.suffixes[k] = cut(table)
            self.few[k] = self.suffixes[k].count() <= 100_000

    def _features(self, urls: DataFrame, without: Column | None = None) -> DataFrame:
        """``urls`` (with url) and the features as __tk_ columns; ``without`` lists folds that suffix rates leave out."""
        urls = urls.withColumn("__tk_h", host_of(F.col("url")))
        urls = urls.withColumns({f"__tk_{k}": c for k, c in lexical(F.col("url"), F.col("__tk_h")).items()})
        for k in LEVELS:
            urls = urls.withColumn("suffix", suffix_of(F.col("__tk_h"), k))
            urls = with_side(urls, self.suffixes[k], ["suffix"], self.few[k], F.col("url"), "left")
            n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
            if without is not None:
                out = lambda c: F.coalesce(F.aggregate(without, F.lit(0).cast("long"), lambda a, f: a + F.get(F.col(c), f)), F.lit(0))
                n, bad = n - out("fold_n"), bad - out("fold_bad")
            rate = (bad + self.prior * self.mean) / (n + self.prior)
            urls = urls.withColumn(f"__tk_suffix{k}_rate", rate).drop("suffix", "n", "bad", "fold_n", "fold_bad")
        return urls.drop("__tk_h")

    def _labelled(self, labelled: DataFrame) -> DataFrame:
        known = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label"))
        return known.where("url is not null and label in (0, 1)").withColumn("fold", fold_of(F.col("url")))

    def fit(self, labelled: DataFrame) -> UrlTrees:
        known = self._labelled(labelled)
        n, bad = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        self.mean = (bad + 0.5) / (n + 1)
        self.base = math.log(self.mean / (1 - self.mean))
        self.model = []
        self._count_suffixes(known)
        if not 0 < bad < n:
            return self
        seen = known.where("fold <> 0")
        held = dict(seen.groupBy("label").count().collect())
        parts = [seen.where(f"label = {y}").orderBy(F.xxhash64("url"), "url").limit(self.sample).withColumn("__tk_w", F.lit(max(held.get(y, 0) / self.sample, 1.0))) for y in (0, 1)]
        rows, first = stored(parts[0].union(parts[1]).coalesce(1))
        own = F.when(F.col("fold") == 0, F.array(F.lit(0))).otherwise(F.array("fold", F.lit(0)))
        table, second = stored(self._features(rows, own).coalesce(1))
        steps = [i / self.bins for i in range(1, self.bins)]
        found = table.groupBy("label").agg(*[F.percentile_approx(f"__tk_{f}", steps, 10_000).alias(f) for f in FEATURES]).collect()  # two rows
        self.edges = {f: sorted({x for r in found for x in r[f]}) for f in FEATURES}  # of both labels, as one may be rare
        binned = F.array(*[F.struct(F.lit(i).alias("f"), self._bin(f).alias("b")) for i, f in enumerate(FEATURES)])
        table, third = stored(table.withColumn("__tk_bins", binned).coalesce(1))
        for _ in range(self.trees):
            self._grow(table)
        release(first, second, third)
        return self

    def held_out(self, labelled: DataFrame, threshold: float = 0.5) -> tuple[int, int, int, int]:
        """(good URLs, of them blocked, bad URLs, of them allowed) of the fold no tree has seen."""
        rows = self._features(self._labelled(labelled).where("fold = 0"), F.array(F.lit(0)))
        block = 1 / (1 + F.exp(-self._margin())) >= threshold
        good, bad = F.col("label") == 0, F.col("label") == 1
        return tuple(rows.agg(F.count_if(good), F.count_if(good & block), F.count_if(bad), F.count_if(bad & ~block)).first())

    def _bin(self, feature: str) -> Column:
        return sum((F.when(F.col(f"__tk_{feature}") > e, 1).otherwise(0) for e in self.edges[feature]), F.lit(0))

    def _grow(self, table: DataFrame) -> None:
        p = 1 / (1 + F.exp(-self._margin()))
        leaves: dict[str, tuple] = {"": ()}  # a leaf's path of 0 and 1, and its conditions
        for level in range(self.depth + 1):
            where = F.lit(None).cast("string")
            for name, tests in leaves.items():
                where = F.when(self._all(tests), F.lit(name)).otherwise(where)
            rows = table.coalesce(1).select(where.alias("leaf"), (F.col("__tk_w") * (F.col("label") - p)).alias("g"), (F.col("__tk_w") * p * (1 - p)).alias("h"), F.explode("__tk_bins").alias("x"))
            sums = rows.groupBy("leaf", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # leaves x features x bins
            grown: dict[str, tuple] = {}
            for name, tests in leaves.items():
                own = [r for r in sums if r.leaf == name]
                total_g = sum(r.g for r in own if r.f == 0)
                total_h = sum(r.h for r in own if r.f == 0)
                best = (1e-6, None)
                for f, feature in enumerate(FEATURES) if level < self.depth else []:
                    for b, edge in enumerate(self.edges[feature]):
                        g = sum(r.g for r in own if r.f == f and r.b <= b)
                        h = sum(r.h for r in own if r.f == f and r.b <= b)
                        gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                        if min(h, total_h - h) > 1e-3 and gain > best[0]:
                            best = (gain, (feature, edge))
                if best[1] is None:
                    self.pending = [*self.pending, (tests, self.rate * total_g / (total_h + 1))]
                else:
                    grown[name + "0"], grown[name + "1"] = (*tests, (*best[1], False)), (*tests, (*best[1], True))
            leaves = grown
            if not leaves:
                break
        self.model += [self.pending]
        self.pending = []

    def _all(self, tests: tuple) -> Column:
        out = F.lit(True)
        for feature, edge, over in tests:
            c = F.col(f"__tk_{feature}")
            out = out & ((c > edge) if over else (c <= edge))
        return out

    def _margin(self) -> Column:
        out = F.lit(self.base)
        for tree in self.model:
            value = F.lit(0.0)
            for tests, x in tree:
                value = F.when(self._all(tests), F.lit(x)).otherwise(value)
            out = out + value
        return out

    def score(self, urls: DataFrame, name: str = "score") -> DataFrame:
        """``urls`` with the probability that a URL is to be blocked; a null URL has that of an empty one.

        A column of ``urls`` with the result's name stays, and the result's name gets underscores.
        """
        rows = urls.select(packed_row(urls).alias("__tk_row"), F.col("url").cast("string").alias("url"))
        return self._features(rows).select(*unpacked_row(urls, "__tk_row"), (1 / (1 + F.exp(-self._margin()))).alias(free_name(urls, name)))


def weak_labels(urls: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """labelled(url, label): 1 if a part of the host between dots and hyphens is one of ``words``.

    Weak supervision where no labelled URLs are given: no feature sees the words themselves.
    """
    parts = F.split(host_of(F.col("url")), r"[.-]")
    return urls.select("url", F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words])).cast("int").alias("label"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    The longest fitting rule decides; elsewhere the trees do (block if score >= threshold). A null
    URL or one without :// has an empty host and path and is judged like any other. Repeated rows
    stay, an empty table gives none, other columns, whatever their names, are not read.
    """
    model = UrlTrees().fit(labelled)
    scored = model.score(pages.select("page_id", "url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = scored.select("page_id", "score", host.alias("host"), path.alias("path"))
    out = out.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")


