"""Writers of the built tables. Each writes a new snapshot; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lexicon(table: DataFrame, path: str, key: str = "roman") -> None:
    """Parquet in ranges of the key, each sorted, so that a lookup reads few row groups."""
    table.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def prefix_index(index: DataFrame, path: str, prefix: str = "prefix") -> None:
    """Parquet in a folder for each prefix length, sorted by prefix."""
    sized = index.withColumn("size", F.length(prefix))
    sized.repartitionByRange("size", prefix).sortWithinPartitions("size", prefix).write.partitionBy("size").parquet(path)


def evidence(table: DataFrame, path: str, meta: str, floor: int) -> None:
    """The evidence of native words, and one JSON row about it."""
    lexicon(table, path, "native")
    about = table.agg(F.count("*").alias("words"), F.coalesce(F.max("unigram"), F.lit(0)).alias("max_unigram"))
    about.select(F.lit(2).alias("version"), "words", "max_unigram", F.lit(floor).alias("attested_floor")).coalesce(1).write.json(meta)


def ranked(counts: DataFrame, path: str, word: str = "word", n: str = "n", top: int | None = None) -> None:
    """Tab-separated words by falling count, then by word; all of them, or the ``top`` asked for."""
    rows = counts.orderBy(F.desc(n), word)
    rows = rows if top is None else rows.limit(top)
    rows.select(word, n).write.option("sep", "\t").csv(path)


def attested(words: DataFrame, path: str, floor: int) -> None:
    """JSON lines of the word and the floor, sorted."""
    words.select("word").distinct().orderBy("word").withColumn("floor", F.lit(floor)).write.json(path)


def unique_words(merged: DataFrame, path: str, tier: Column) -> None:
    """Tab-separated word, tier and comma-joined sources."""
    merged.select("word", tier.alias("tier"), F.array_join(F.array_sort("sources"), ",").alias("sources")).orderBy("word").write.option("sep", "\t").csv(path)


def lexicon_text(table: DataFrame, path: str) -> None:
    """Tab-separated roman, native, weight and a soft mark, in the order of romans over all files."""
    soft = ((F.col("weight") > 0) & (F.col("weight") < 100)).cast("int")
    table.orderBy("roman").select("roman", "native", "weight", soft.alias("soft")).write.option("sep", "\t").csv(path)


def prefix_text(index: DataFrame, path: str) -> None:
    """A line a prefix: its entries (native, weight and roman by unit separators) in rank order, joined by record separators.

    ``index(prefix, rank, roman, native, weight)`` has a bounded number of rows a prefix.
    """
    entry = F.concat_ws("\x1f", "native", F.col("weight").cast("string"), "roman")
    lines = index.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["e"]), "\x1e")
    lines.orderBy("prefix").select(F.concat_ws("\t", "prefix", joined).alias("value")).write.text(path)


def stems_json(counts: DataFrame, path: str, top: int = 80_000, word: str = "word", n: str = "n") -> None:
    """One JSON object of the ``top`` words and their counts; no more than those meet in a task."""
    rows = counts.orderBy(F.desc(n), word).limit(top)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(word).alias("k"), F.col(n).alias("v")))))
    rows.agg(F.to_json(entries).alias("value")).write.text(path)


def learning_store(store: DataFrame, path: str) -> None:
    """A JSON line a roman: preferred_native and natives with explicit_count, last_used and legacy_count.

    ``store(roman, native, explicit_count, last_used, legacy_count, preferred)`` has at most eight
    natives a roman. The folder is new and complete only with its success mark; none is changed in place.
    """
    meta = F.struct("explicit_count", "last_used", "legacy_count")
    natives = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("native").alias("k"), meta.alias("v")))))
    rows = store.where(F.col("native").isNotNull()).groupBy("roman").agg(F.max("preferred").alias("preferred_native"), natives.alias("natives"))
    rows.select(F.lit(2).alias("version"), "roman", "preferred_native", "natives").write.mode("errorifexists").json(path)


def rewritten(table: DataFrame, updates: DataFrame, path: str, key: str = "roman") -> None:
    """A new snapshot of a keyed table in which rows of ``updates`` replace those with their keys."""
    kept = table.join(updates.select(key), key, "left_anti").select(*table.columns)
    lexicon(kept.unionByName(updates.select(*table.columns)), path, key)


def splits(rows: DataFrame, path: str, bucket: Column) -> None:
    rows.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)


def jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines, for gold sets, keyword tables and one-row reports; null fields are left out."""
    rows.write.json(path)


def disagreements(menus: DataFrame, path: str, menu: str = "menu", gold: str = "native") -> None:
    """The rows whose first candidate is not the gold one, an empty or missing menu included."""
    first = F.get(F.col(menu), F.lit(0))
    menus.where(~first.eqNullSafe(F.col(gold))).write.json(path)


def bad_rows(table: DataFrame, **checks: Column) -> DataFrame:
    """One row with the number of rows that fail each check; a check that is null fails."""
    return table.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
