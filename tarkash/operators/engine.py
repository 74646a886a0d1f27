"""From typed words to menus: candidates, scores, order and layout in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tarkash.functions.script import is_latin_literal, is_number
from tarkash.operators import candidates, menu, scoring
from tarkash.operators.validity import validity
from tarkash.sources.stages import Stages

#: The families of candidates, in the order in which equal candidates count.
FAMILIES = ("exception", "lookup", "sign", "postposition", "inflection", "compound", "near_exact", "latin", "phonetic", "model", "completion", "emoji")


@dataclass(frozen=True)
class Policy:
    """Which families take part, whether other spellings are looked up, and the menu's measures."""

    families: Sequence[str] = FAMILIES
    respell: bool = True
    most_phonetic: int = 4
    most_completions: int = 3
    most_emoji: int = 2
    before_emoji: int = 3
    confidence: float = 0.9
    cap: int = 6
    floor: int = 50

    def without(self, *families: str) -> Policy:
        """The policy with families off, as an ablation runs it; an unknown name raises ValueError."""
        if unknown := set(families) - set(FAMILIES):
            raise ValueError(f"unknown families: {sorted(unknown)}")
        return replace(self, families=tuple(f for f in self.families if f not in families))


@dataclass(frozen=True)
class Tables:
    """What menus are made from.

    ``lexicon(roman, native, weight)`` has one row a roman, ``evidence(native, unigram, stem,
    attested)`` one a native. The others may be missing: ``exceptions(roman, native)``,
    ``index(prefix, roman, native, weight)``, ``by_code(code, emoji, weight, confidence)``,
    ``by_native(native, emoji, weight, confidence)``, ``learnt(typed, native, explicit_count,
    preferred)``, ``model(typed, native, log_prob)``.
    """

    lexicon: DataFrame
    evidence: DataFrame
    exceptions: DataFrame | None = None
    index: DataFrame | None = None
    by_code: DataFrame | None = None
    by_native: DataFrame | None = None
    learnt: DataFrame | None = None
    model: DataFrame | None = None
    largest: int = field(default=1)


def _known(natives: DataFrame, tables: Tables, floor: int) -> DataFrame:
    return validity(natives.select("native"), tables.evidence, floor)


def generate(typed: DataFrame, tables: Tables, policy: Policy = Policy(), keep: Stages | None = None) -> DataFrame:
    """The merged candidates of ``typed(typed)``, distinct lower-case words.

    Later families see what earlier ones found: phonetic forms are gated and capped by it and, like
    completions, leave out its natives; emoji come by the natives found.
    """
    keep = keep or Stages()
    lex, evidence, on = tables.lexicon, tables.evidence, set(policy.families)
    typed = keep(typed)
    attested = evidence.where("attested").select("native")
    sure = evidence.select("native", F.greatest("unigram", "stem").alias("evidence"), "attested")
    makers = {
        "exception": lambda: candidates.exceptions(typed, tables.exceptions) if tables.exceptions is not None else None,
        "lookup": lambda: candidates.hits(typed, lex, policy.respell),
        "sign": lambda: candidates.sign_stems(typed, lex),
        "postposition": lambda: candidates.postposition_stems(typed, lex, attested, respell=policy.respell),
        "inflection": lambda: candidates.inflected_stems(typed, lex, policy.respell),
        "compound": lambda: candidates.compounds(typed, lex, sure),
        "near_exact": lambda: candidates.near_exact(typed, lex),
        "latin": lambda: candidates.latin(typed),
    }
    parts = [part for name, make in makers.items() if name in on and (part := make()) is not None]
    rows, place = keep(candidates.placed(parts or [candidates.latin(typed).limit(0)])), len(parts)

    def add(part: DataFrame) -> None:
        nonlocal rows, place
        rows, place = rows.unionByName(keep(candidates.placed([part], place))), place + 1

    if "phonetic" in on:
        forms = keep(candidates.script_forms(typed))
        add(candidates.phonetic(typed, _known(forms, tables, policy.floor), policy.most_phonetic, candidates.merged(rows), policy.floor, forms))
    if "model" in on and tables.model is not None:
        add(candidates.modelled(tables.model.join(typed, "typed", "left_semi"), _known(tables.model, tables, policy.floor)))
    if "completion" in on and tables.index is not None:
        add(candidates.completions(typed, tables.index, policy.most_completions, rows, policy.respell))
    if "emoji" in on and tables.by_code is not None:
        natives = tables.by_native if tables.by_native is not None else tables.by_code.select(F.col("code").alias("native"), "emoji", "weight", "confidence").limit(0)
        add(candidates.emoji(typed, rows, tables.by_code, natives, policy.most_emoji))
    return candidates.merged(rows)


def rank(merged: DataFrame, tables: Tables, policy: Policy = Policy()) -> DataFrame:
    """The merged candidates with score, adjusted tier and rank within the typed word."""
    known = _known(merged, tables, policy.floor)
    scored = scoring.score(merged, known, tables.lexicon, tables.learnt, tables.largest, tables.model if "model" in policy.families else None)
    return menu.ranked(scored, "typed")


def lay(ranked: DataFrame, tables: Tables, policy: Policy = Policy()) -> DataFrame:
    """(typed, menu): the laid out natives; what is gathered is one typed word's candidates."""
    rows = ranked.withColumn("confidence", F.lit(0.0))
    if "emoji" in policy.families and tables.by_code is not None:
        sure = tables.by_code.select(F.col("emoji").alias("native"), F.col("confidence").alias("c"))
        if tables.by_native is not None:
            sure = sure.unionByName(tables.by_native.select(F.col("emoji").alias("native"), F.col("confidence").alias("c")))
        sure = sure.groupBy("native").agg(F.max("c").alias("c"))
        rows = ranked.join(sure, "native", "left").withColumn("confidence", F.when(F.col("tier") == menu.EMOJI, F.coalesce("c", F.lit(0.0))).otherwise(0.0))
    items = F.array_sort(F.collect_list(F.struct("rank", "native", "tier", "confidence")))
    laid = menu.layout(F.col("items"), policy.before_emoji, policy.most_emoji, policy.confidence, policy.cap)
    return rows.groupBy("typed").agg(items.alias("items")).select("typed", laid.alias("menu"))


def menus(typed: DataFrame, tables: Tables, policy: Policy = Policy(), keep: Stages | None = None) -> DataFrame:
    """(typed, menu) of every distinct typed word; null and empty words have none.

    An address or a number gets itself alone. Words are looked up in lower case. ``keep`` holds the
    frames that several steps read; give one to release them once the menus are written.
    """
    keep = keep or Stages()
    words = typed.select(F.lower("typed").alias("typed")).where("typed <> ''").distinct()
    plain = is_latin_literal(F.col("typed")) | is_number(F.col("typed"))
    found = keep(generate(words.where(~plain), tables, policy, keep))
    made = lay(rank(found, tables, policy), tables, policy)
    return made.unionByName(words.where(plain).select("typed", F.array("typed").alias("menu")))


def of_stream(typed: DataFrame, tables: Tables, write: Callable[[DataFrame, int], None], policy: Policy = Policy()) -> DataStreamWriter:
    """A writer, to be started by the caller, that gives each batch's menus to ``write(menus, batch number)``.

    The lookups group and rank by typed word, so they run on each batch as a plan of its own; a batch
    that is run again gives the same menus.
    """

    def batch(rows: DataFrame, number: int) -> None:
        keep = Stages()
        write(menus(rows, tables, policy, keep), number)
        keep.release()

    return typed.writeStream.foreachBatch(batch)
