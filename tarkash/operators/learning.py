"""Learning from explicit selections, over a whole history at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROMOTION = 2
MOST_COUNT = 255
MOST_NATIVES = 8


def preferred(selections: DataFrame, key: str, native: str, ts: str, tie: str) -> DataFrame:
    """(key, preferred, at): the native promoted last, by its second or a later selection."""
    nth = F.row_number().over(Window.partitionBy(key, native).orderBy(ts, tie))
    promoted = selections.withColumn("__n", nth).where(F.col("__n") >= PROMOTION)
    last = promoted.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))).where("__r = 1")
    return last.select(key, F.col(native).alias("preferred"), F.col(ts).alias("at"))


def store(selections: DataFrame, key: str, native: str, ts: str) -> DataFrame:
    """(key, native, explicit_count, last_used): at most 8 natives a key, the latest used."""
    counts = selections.groupBy(key, native).agg(F.least(F.count("*"), F.lit(MOST_COUNT)).alias("explicit_count"), F.max(ts).alias("last_used"))
    order = Window.partitionBy(key).orderBy(F.desc("last_used"), native)
    return counts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= MOST_NATIVES).drop("__r")


def compact(kept: DataFrame, key: str, last_used: str, most: int = 10_000) -> DataFrame:
    """The rows of the ``most`` keys used last; ties go to the smaller key.

    The cap is the store's own size, so its keys fit a broadcast.
    """
    latest = kept.groupBy(key).agg(F.max(last_used).alias("__t")).orderBy(F.desc("__t"), key).limit(most).select(key)
    return kept.join(latest, key, "left_semi")


def parse(stores: DataFrame, text: str) -> DataFrame:
    """(roman, native, explicit_count, last_used, legacy_count, preferred) of stores as JSON text.

    An entry of the first version maps natives to counts, which become legacy counts and promote
    nothing. Broken texts and entries without a roman key give no rows; an entry without natives
    gives one row with a null native.
    """
    meta = "explicit_count:double,last_used:double,legacy_count:double,count:double"
    choices = F.from_json(F.get_json_object(text, "$.choices"), "map<string,string>")
    rows = stores.select(F.explode(choices).alias("roman", "nest")).withColumn("roman", F.regexp_replace(F.lower("roman"), "[^a-z+]", "")).where("roman <> ''")
    new, old = F.from_json("nest", f"struct<preferred_native:string,natives:map<string,struct<{meta}>>>"), F.from_json("nest", f"map<string,struct<{meta}>>")
    rows = rows.select("roman", new.alias("new"), old.alias("old"))
    second = F.col("new.natives").isNotNull() | F.col("new.preferred_native").isNotNull()
    entries = F.when(second, F.col("new.natives")).otherwise(F.map_filter("old", lambda _, v: v.isNotNull()))
    rows = rows.select("roman", second.alias("second"), F.col("new.preferred_native").alias("preferred"), F.explode_outer(entries).alias("native", "m"))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("long")
    most = lambda c: F.least(whole(c), F.lit(MOST_COUNT))
    legacy = F.when(F.col("second"), F.when(whole("m.legacy_count") != 0, whole("m.legacy_count")).otherwise(whole("m.count"))).otherwise(most("m.count"))
    explicit = F.when(F.col("second"), most("m.explicit_count")).otherwise(0)
    return rows.select("roman", "native", explicit.alias("explicit_count"), whole("m.last_used").alias("last_used"), legacy.alias("legacy_count"), "preferred")
