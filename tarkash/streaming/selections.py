"""Explicit selections from a stream of keys, selections and commits, and what is learnt from them.

Events: (user, ts, seq, kind, roman, text, type, composition). ``kind`` is select (a numbered
candidate), key (any other key, its name in text) or commit (its text). ``seq`` orders equal times.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarkash.functions.script import learning_key
from tarkash.operators.learning import MOST_COUNT, MOST_NATIVES, PROMOTION

SECONDS = 2.0
CONFIRMED = "user string, roman string, native string, ts timestamp"
LEARNT = "roman string, preferred string, natives int, ts timestamp"


def picked(number: Column, selected: Column, size: Column, page: int = 6) -> Column:
    """The 0-based candidate that a number key picks on the page of ``selected``, or null."""
    at = F.floor(F.greatest(F.coalesce(selected, F.lit(0)), F.lit(0)) / page) * page + number - 1
    return F.when(number.between(1, page) & (at < size), at.cast("int"))


def _prepared(events: DataFrame) -> DataFrame:
    """Adds ``valid``: a selection of a Gujarati word under a roman key."""
    text, kind = F.coalesce("text", F.lit("")), F.lower(F.coalesce("type", F.lit("")))
    roman = learning_key(F.coalesce("roman", F.lit("")))
    word = text.rlike(r"[઀-૿]") & ~text.rlike(r"[\x{1F300}-\x{1FAFF}]") & ~kind.rlike("latin|emoji|prefix")
    return events.select("user", "ts", "seq", "kind", roman.alias("roman"), text.alias("text"), F.coalesce("composition", F.lit("")).alias("composition"), ((F.col("kind") == "select") & word & (roman != "")).alias("valid"))


def confirmed(events: DataFrame) -> DataFrame:
    """(user, roman, native, ts) of selections whose text is committed within two seconds, over a whole history.

    A selection stands until the next selection or commit, Escape or BackSpace, or a key under
    another composition. One sort a user serves both windows; nothing is gathered.
    """
    rows = _prepared(events).where("user is not null and ts is not null")
    order = Window.partitionBy("user").orderBy("ts", "seq")
    last = F.last(F.when(F.col("kind") == "select", F.col("composition")), ignorenulls=True).over(order)
    clears = F.lower("text").isin("escape", "backspace") | (F.col("composition") == "") | ~F.col("composition").eqNullSafe(last)
    rows = rows.withColumn("counts", F.col("kind").isin("select", "commit") | ((F.col("kind") == "key") & clears)).where("counts")
    before = F.lag(F.struct("valid", "roman", "text", "ts")).over(order)
    rows = rows.withColumn("p", before).where((F.col("kind") == "commit") & F.col("p.valid") & (F.col("p.text") == F.col("text")))
    rows = rows.where(F.col("ts").cast("double") - F.col("p.ts").cast("double") <= SECONDS)
    return rows.select("user", F.col("p.roman").alias("roman"), F.col("p.text").alias("native"), "ts")


def _confirm(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending = json.loads(state.get[0]) if state.exists else None
    found = []
    for e in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples():
        if e.kind == "select":
            pending = {"roman": e.roman, "text": e.text, "composition": e.composition, "at": e.ts.isoformat()} if e.valid else None
        elif e.kind == "commit":
            if pending and e.text == pending["text"] and (e.ts - pd.Timestamp(pending["at"])).total_seconds() <= SECONDS:
                found.append((key[0], pending["roman"], pending["text"], e.ts))
            pending = None
        elif pending and (e.text.lower() in ("escape", "backspace") or e.composition != pending["composition"] or not e.composition):
            pending = None
    if pending:
        state.update((json.dumps(pending),))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(found, columns=["user", "roman", "native", "ts"])


def confirm_stream(events: DataFrame) -> DataFrame:
    """As ``confirmed`` on a stream: state is one selection of bounded size for each user with one pending, and none else.

    Events of a user must arrive in order over batches; within a batch they are sorted.
    """
    rows = _prepared(events).where("user is not null and ts is not null")
    return rows.groupBy("user").applyInPandasWithState(_confirm, CONFIRMED, "pending string", "append", GroupStateTimeout.NoTimeout)


def _learn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    store = json.loads(state.get[0]) if state.exists else {"preferred": None, "natives": {}}
    natives = store["natives"]
    latest = None
    for e in pd.concat(list(batches)).sort_values(["ts", "native"]).itertuples():
        n = min(MOST_COUNT, natives.get(e.native, [0])[0] + 1)
        natives[e.native] = [n, e.ts.isoformat()]
        latest = e.ts
        if n >= PROMOTION:
            store["preferred"] = e.native
        for old in sorted(natives, key=lambda x: natives[x][1])[: max(0, len(natives) - MOST_NATIVES)]:
            del natives[old]
    if store["preferred"] not in natives:
        store["preferred"] = None
    state.update((json.dumps(store),))
    yield pd.DataFrame([(key[0], store["preferred"], len(natives), latest)], columns=["roman", "preferred", "natives", "ts"])


def learn_stream(selections: DataFrame) -> DataFrame:
    """(roman, preferred, natives, ts) after each batch: the second selection of a native promotes it.

    At most eight natives are kept a roman, the latest used. The rows are updates by roman. The state
    is the store itself: its size is that of the romans ever selected, by hand, and not of the stream;
    ``learning.compact`` cuts a written store to the romans used last.
    """
    return selections.groupBy("roman").applyInPandasWithState(_learn, LEARNT, "store string", "update", GroupStateTimeout.NoTimeout)


# Names of the keys that commit with a mark.
MARKS = {
    "space": " ", "period": ".", "kp_decimal": ".", "kp_period": ".", "comma": ",", "kp_separator": ",", "semicolon": ";", "apostrophe": "'",
    "quotedbl": '"', "slash": "/", "backslash": "\\", "minus": "-", "kp_subtract": "-", "equal": "=", "grave": "`", "bracketleft": "[",
    "bracketright": "]", "exclam": "!", "question": "?", "colon": ":", "parenleft": "(", "parenright": ")",
}


def mark(key: Column) -> Column:
    """The mark that a key commits with, or null; keys with a control, alt or command modifier have none."""
    held = F.lower(key).rlike(r"(?:control|ctrl|alt|option|super|meta|command|cmd)\+")
    bare = F.regexp_replace(F.regexp_replace(F.lower(key), r"\Arelease\+", ""), r"\Ashift\+", "")
    named = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    single = F.when(bare.rlike(r"""\A[.,;:'"!?/\\\-_=`\[\]()]\z"""), bare)
    return F.when(~held, F.coalesce(F.try_element_at(named, bare), F.when(key == " ", " "), single))


def commits(keys: DataFrame) -> DataFrame:
    """(user, ts, place, text): for a mark typed over a menu, the best candidate and then the mark.

    ``keys(user, ts, key, candidate)``; without a candidate the key passes and gives no row.
    """
    rows = keys.withColumn("m", mark(F.col("key"))).where("m is not null and candidate is not null")
    return rows.select("user", "ts", F.posexplode(F.array("candidate", "m")).alias("place", "text"))
