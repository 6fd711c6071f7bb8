"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of 10 words are the sets to be contained. Words are ordered by rarity over
all documents; exact containment of a whole window needs only one prefix token, so each window
joins by its rarest word alone. Position fixes where the window would begin, length bounds it
inside the document, and the words in that span are then compared one by one. Where the windows are too large to
broadcast, a position travels with its neighbour words alone; the words of a document travel once, and only of those
in which the neighbours of some position agree too.

Only A-Z are lower-cased; words are runs of letters, digits and anything above U+007F. Null and
empty texts have no words. Rows that repeat give repeated results; rows that share a doc_id but
not a text are judged apart. Null ids are kept. An item id that occurs twice counts once. Without
items nothing is hit; without documents the result is empty. Very long texts are read whole. Of words equally rare
the smallest leads its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_OF_EITHER_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 8 << 20


def tokens(c: Column) -> Column:
    return F.filter(_pieces(ascii_lower(c)), lambda w: w != "")


def _pieces(lowered: Column) -> Column:
    """The words, with an empty piece before or after them where the text begins or ends with a gap."""
    return F.split(lowered, NOT_WORD)


def _n_words(pieces: Column) -> Column:
    gap = lambda i: (F.get(pieces, i) == "").cast("long")
    return F.size(pieces) - gap(F.lit(0)) - F.when(F.size(pieces) > 1, gap(F.size(pieces) - 1)).otherwise(0)


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, win: all distinct windows of each item; a short item is one window."""
    ws = items.select("item_id", tokens(text()).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (size - 1)))
    return ws.select("item_id", F.explode(starts).alias("at"), "ws").select("item_id", F.slice("ws", F.col("at"), F.lit(size)).alias("win")).distinct()


def _found(pairs: DataFrame) -> DataFrame:
    """Of (_key, _ws, start, win, items) those whose words are those of the window."""
    start = F.col("start")
    same = F.slice("_ws", F.when(start >= 0, start + 1).otherwise(1), F.size("win")) == F.col("win")
    return pairs.where((start >= 0) & (start + F.size("win") <= F.size("_ws"))).where(same).select("_key", "items", "start", F.size("win").alias("n"))


def _by_shuffle(docs: DataFrame, by_window: DataFrame) -> DataFrame:
    """(_key, _ws, start, win, items), each once, where the words around the leading one are those of the window."""
    around = F.transform("_ws", lambda w, i: F.struct(w.alias("w"), F.get("_ws", i - 1).alias("before"), F.get("_ws", i + 1).alias("after")))
    at = docs.select("_key", F.size("_ws").alias("_n"), F.posexplode(around).alias("pos", "x")).select("_key", "_n", "pos", "x.*")
    start, off, n = F.col("pos") - F.col("off"), F.col("off"), F.size("win")
    near = ((off == 0) | (F.get("win", off - 1) == F.col("before"))) & ((off == n - 1) | (F.get("win", off + 1) == F.col("after")))
    maybe = at.join(by_window, "w").where((start >= 0) & (start + n <= F.col("_n")) & near).select("_key", start.alias("start"), "win", "items").distinct()
    texts = docs.join(maybe.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    return maybe.join(texts, "_key")


def hits(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per occurrence of a window: _key of the document, item_id, first word position from 0, length.

    docs has _key and _ws (its words; an empty piece at either end does no harm). The windows are broadcast only if their measured size
    is under BROADCAST_BYTES."""
    wins = item_windows(items, size)
    n_bytes = items.select(F.sum(F.octet_length(text()) * size + 64)).first()[0] or 0
    small = n_bytes <= BROADCAST_BYTES
    vocab, words_ = wins.select(F.explode("win").alias("w")).distinct(), docs.select(F.explode("_ws").alias("w"))
    # the larger the item side, the better words are counted before they meet it
    rarity = words_.join(F.broadcast(vocab), "w", "left_semi").groupBy("w").count() if small else words_.groupBy("w").count().join(vocab, "w", "left_semi")
    ranked = (
        wins.select("item_id", "win", F.posexplode("win").alias("off", "w"))
        .join(rarity, "w", "left")
        .groupBy("item_id", "win")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "w", "off")).alias("r"))
        .where("r.n > 0")
        .select("item_id", "win", F.col("r.w").alias("w"), F.col("r.off").alias("off"))
    )
    by_window = ranked.groupBy("w", "off", "win").agg(F.collect_set("item_id").alias("items"))
    if not small:
        return _found(_by_shuffle(docs, by_window))
    at = docs.select("_key", "_ws", F.posexplode("_ws").alias("pos", "w"))
    return _found(at.join(F.broadcast(by_window), "w").withColumn("start", F.col("pos") - F.col("off")))


def _key() -> Column:
    return F.struct(F.col("doc_id").alias("i"), F.xxhash64(text()).alias("h")).alias("_key")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(), _pieces(ascii_lower(text())).alias("_ws"))


def _per_document(found: DataFrame) -> DataFrame:
    spans = F.transform("s", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))
    return (
        found.groupBy("_key")
        .agg(F.collect_set(F.struct("start", "n")).alias("s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
        .select("_key", F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"), F.transform("ids", lambda x: x.cast("string")).alias("ids"))
    )


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), contaminated: one row per document row."""
    keyed = _keyed(docs)
    found = _per_document(hits(keyed, items, size))
    base = docs.select(_key(), F.split(text(), NOT_WORD_OF_EITHER_CASE).alias("_ws")).select("_key", _n_words(F.col("_ws")).cast("long").alias("n_words"))
    out = base.join(found, base["_key"].eqNullSafe(found["_key"]), "left").select(base["_key"], "n_words", "n_hit", "ids")
    return out.select(
        F.col("_key.i").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.array_sort("ids"), F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    bad = hits(_keyed(docs), items, size).select(F.col("_key.i").alias("_i"), F.col("_key.h").alias("_h")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_i"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_h"]), "left_anti")
