"""Quality rules: base counts, then distribution divergence against language references.

For each document the character-class histogram and the histogram of its language's common
words are compared by Jensen-Shannon distance (base 2, so 0 to 1) with the reference of its
language, made from all documents of that language that pass the base rules: for common words
the summed histogram, for character classes the median share of each class (exact, in steps of 1 / STEPS: counts
by step are summed, so no order of merging matters), which junk among the documents hardly moves. The class that no rule names holds all other letters. Documents under the minimum lengths are not judged by divergence.

Defined results: null text counts as empty (no words, base_failed). Null or unknown languages
are compared with the sum over all languages, without common words. Repeated rows stay. Other
columns pass through apply_rules() untouched. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, let, text

# The commonest function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "that", "is", "was", "he", "for", "it", "with", "as", "on", "be", "at", "by", "this", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
# Character classes, as the characters that each keeps.
CHAR_CLASSES = {
    "upper": "A-Z",
    "digit": "0-9",
    "stop": ".,;:!?'\"()\\-",
    "symbol": "#*$%&|<>=+/\\\\@^~`{}\\[\\]_",
}

STEPS = 1 << 16
MIN_WORDS = 50
MIN_COMMON = 10
MAX_CHAR_DISTANCE = 0.20
MAX_WORD_DISTANCE = 0.65


def _kept_chars(t: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(t, f"[^{keep}]+", ""))


def words(t: Column) -> Column:
    return let(F.btrim(t, F.lit(" \t\n\x0b\x0c\r")), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, WORD_GAP)))


def _repeated(ws: Column, size: int) -> Column:
    """Words inside a window of `size` words that occurs twice or more."""

    def covered(starts: Column) -> Column:
        spans = F.transform(starts, lambda s, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - s, F.lit(size))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def doubled(pairs: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        return let(F.array_sort(F.transform(F.filter(pairs, lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["at"])), covered)

    def windows(hs: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(hs) - size), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(size)]))
        return let(
            each,
            lambda ids: F.when(F.size(F.array_distinct(ids)) == F.size(ids), F.lit(0)).otherwise(
                let(F.array_sort(F.transform(ids, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), doubled)
            ),
        )

    return F.when(F.size(ws) < size, F.lit(0)).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), windows))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and one row of counts per document; text is read once."""
    t = F.col("_t")
    listed = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = F.split(F.lower(t), r"[\x00-\x60\x7B-\xBF]+")
    counts = lambda ws, mine: F.transform(mine, lambda v: F.size(F.filter(ws, lambda w: w == v)).cast("long"))
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text().alias("_t"), words(text()).alias("_w"))
    base = base.withColumn("_mine", F.coalesce(F.try_element_at(listed, F.coalesce("lang", F.lit(""))), F.array().cast("array<string>")))
    return base.select(
        "doc_id",
        "lang",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, WORD_GAP, "")).cast("long").alias("word_chars"),
        _kept_chars(t, "#*$%&|<>").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_w"), 5).cast("long").alias("n_repeat_words"),
        F.array(*[_kept_chars(t, k).cast("long") for k in CHAR_CLASSES.values()]).alias("_chars"),
        F.when(F.size("_mine") == 0, F.array().cast("array<bigint>"))
        .otherwise(let(F.col("_mine"), lambda m: let(F.filter(plain, lambda w: F.array_contains(m, w)), lambda ws: counts(ws, m))))
        .alias("_common"),
    ).withColumn("_chars", F.concat("_chars", F.array(F.greatest(F.lit(0), F.col("word_chars") - F.aggregate("_chars", F.lit(0).cast("long"), lambda a, x: a + x)))))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two arrays of counts; null where either is all zero."""

    def share(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(x, lambda v: v / F.when(s > 0, s)))

    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.when(a.isNotNull(), F.lit(0.0)))
    terms = F.zip_with(share(p), share(q), lambda a, b: 0.5 * (part(a, (a + b) / 2) + part(b, (a + b) / 2)))
    return let(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v), lambda x: F.sqrt(F.when(x < 0, 0.0).otherwise(x)))


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.coalesce(F.get(column, F.lit(i)), F.lit(0))) for i in range(n)])


def _steps(good: DataFrame, key: Column) -> DataFrame:
    """_key, _class, _step, _n: documents by the step of each class's share; at most STEPS + 1 rows a class and key."""
    steps = F.transform("_chars", lambda c: F.floor(c * STEPS / F.col("word_chars")))
    each = good.select(key.alias("_key"), F.posexplode(steps).alias("_class", "_step"))
    return each.groupBy("_key", "_class", "_step").agg(F.count("*").alias("_n"))


def _medians(steps: DataFrame) -> DataFrame:
    """_key, _ref_chars: the lower median of each class, in the order of the classes."""
    w = Window.partitionBy("_key", "_class")
    upto, every = F.sum("_n").over(w.orderBy("_step")), F.sum("_n").over(w)
    half = steps.select("_key", "_class", "_step", (2 * upto >= every).alias("_past")).where("_past").groupBy("_key", "_class").agg(F.min("_step").alias("_step"))
    listed = half.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_class", "_step"))).alias("_m"))
    return listed.select("_key", F.transform("_m", lambda x: x["_step"] / STEPS).alias("_ref_chars"))


def judged(feats: DataFrame) -> DataFrame:
    """Adds base_failed, char_distance, word_distance and kept. The references are one row per
    language, made from all documents; Spark picks the join by their size."""
    feats = feats.withColumn("base_failed", base_failed())
    known = F.coalesce(F.col("lang").isin(*COMMON_WORDS), F.lit(False))
    good = feats.where(~F.col("base_failed"))
    steps = _steps(good, F.when(known, F.col("lang")))
    pooled = _medians(steps.groupBy(F.lit("").alias("_key"), "_class", "_step").agg(F.sum("_n").alias("_n")))
    words_ = good.where(known).groupBy(F.col("lang").alias("_key")).agg(_sums("_common", max(map(len, COMMON_WORDS.values()))).alias("_ref_common"))
    by_lang = _medians(steps.where("_key is not null")).join(words_, "_key")
    pooled = pooled.select("_key", "_ref_chars", F.array().cast("array<bigint>").alias("_ref_common"))
    out = feats.withColumn("_key", F.when(known, F.col("lang")).otherwise("")).join(by_lang.unionByName(pooled), "_key", "left")
    out = out.withColumn("char_distance", F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("_chars"), F.col("_ref_chars"))))
    seen = F.aggregate("_common", F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("word_distance", F.when((F.col("n_words") >= MIN_WORDS) & (seen >= MIN_COMMON), js_distance(F.col("_common"), F.col("_ref_common"))))
    far = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("_key", "_ref_chars", "_ref_common", "_chars", "_common")


def quality(docs: DataFrame) -> DataFrame:
    return judged(cut(features(docs), "quality"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    key = lambda: F.xxhash64(text())
    feats = cut(features(docs.withColumn("doc_id", F.struct(F.col("doc_id").alias("i"), key().alias("h")))), "quality")
    bad = judged(feats).where(~F.col("kept")).select(F.col("doc_id.i").alias("_i"), F.col("doc_id.h").alias("_h")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_i"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_h"]), "left_anti")
