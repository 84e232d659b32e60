"""Quality rules: document statistics and a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words are hashed into a fixed number of
buckets. One multinomial is estimated on the trusted documents (those labelled
good) and one on the raw corpus; a document's score is its summed
log-likelihood ratio per n-gram. The decision is a fixed threshold on that
score and never a draw.

Trusted documents would be known by their own words and so raise the
threshold over others, which reject good documents then. Every document, by a
hash of its id, belongs to a fold, and its score is that of the trusted
documents of the other folds alone.

Documents are read twice: once to count n-grams, once to score. The model is
one long per fold and bucket, whatever the size of the corpus; thresholds come
from a histogram of bounded size over all labelled documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialise
from .common import let, table, words_of

BUCKETS = 1 << 17
FOLDS = 2
#: Counts added to every bucket of both multinomials, the raw one scaled to the size of the trusted.
SMOOTH = 1
#: Scores are whole numbers of 2^-20 nats, so sums do not depend on order.
UNIT = 1 << 20
#: Histogram bins of the score, per nat, and the largest score told apart.
BINS, REACH = 256, 16
#: A rejected good document weighs as much as so many kept bad ones.
GOOD_WEIGHT = 10


def repeat_words(words: Column, window: int = 5) -> Column:
    """The number of words that lie in a ``window``-word sequence found at least twice in ``words``."""
    n = F.size(words)
    hashes = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(found: Column) -> Column:
        marked = F.filter(found, lambda x, k: x["h"].eqNullSafe(F.get(found, k - 1)["h"]) | x["h"].eqNullSafe(F.get(found, k + 1)["h"]))
        starts = F.sort_array(F.transform(marked, lambda x: x["i"]))
        # Each start covers up to the next one; least() skips the null after the last.
        steps = let(starts, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(window), b - a)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    return let(hashes, of).cast("long")


def statistics(text: Column, words: Column) -> list[Column]:
    """Columns n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
    ]


def grams(words: Column, buckets: int) -> Column:
    """Bucket numbers of all words and of all pairs of neighbouring words."""

    def place(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: place(a, b))
    return F.concat(F.transform(words, lambda w: place(w)), pairs)


def fold_of(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(FOLDS)).cast("int")


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, most_broadcast: int) -> list[int]:
    """The log-likelihood ratio of every bucket in units, from all documents, for the documents of each fold after another."""
    good = broadcast_if_small(trusted.select(F.col(id_col).alias("_x3_id")).distinct(), most_broadcast).withColumn("_x3_good", fold_of(F.col("_x3_id")))
    words = docs.select(F.col(id_col).alias("_x3_id"), words_of(F.col(text_col)).alias("_x3_w")).join(good, "_x3_id", "left")
    seen = words.select("_x3_good", F.explode(grams(F.col("_x3_w"), buckets)).alias("g")).groupBy("g")
    counts = seen.agg(F.count(F.lit(1)).alias("raw"), *[F.count_if(F.col("_x3_good") == k).alias(f"good{k}") for k in range(FOLDS)]).collect()
    raw, out = sum(r["raw"] for r in counts), [0] * (FOLDS * buckets)
    for k in range(FOLDS):
        others = [f"good{j}" for j in range(FOLDS) if j != k]
        target = sum(r[x] for r in counts for x in others)
        for r in counts if target else ():
            out[k * buckets + r["g"]] = round(UNIT * math.log((sum(r[x] for x in others) + SMOOTH) / (r["raw"] * target / raw + SMOOTH)))
    return out


def threshold(scored: DataFrame, labels: DataFrame, id_col: str, good: Column) -> float:
    """The score at which keeping costs least over all labelled documents; minus infinity without documents of both kinds."""
    place = F.floor(F.least(F.greatest(F.col("_x3_score"), F.lit(-float(REACH))), F.lit(float(REACH))) * BINS).cast("int")
    told = labels.select(F.col(id_col).alias("_x3_id"), good.alias("good")).where(F.col("good").isNotNull())
    rows = scored.where(F.col("_x3_score").isNotNull()).select(F.col(id_col).alias("_x3_id"), place.alias("bin")).join(told, "_x3_id").groupBy("bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("bin").collect()
    if not sum(r["good"] for r in rows) or not sum(r["bad"] for r in rows):
        return -math.inf
    cost, best, at = sum(r["bad"] for r in rows), sum(r["bad"] for r in rows), -math.inf
    for r in rows:  # rejecting everything up to this bin
        cost += GOOD_WEIGHT * r["good"] - r["bad"]
        if cost < best:
            best, at = cost, (r["bin"] + 1) / BINS
    return at


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: Column | None = None, buckets: int = BUCKETS, most_broadcast: int = 2_000_000, carry: bool = False) -> DataFrame:
    """Statistics and verdict of every row of ``docs``, one row each.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, score, base_failed, kept``, after all input columns if
    ``carry`` (input columns of those names are replaced). ``score`` is nats per n-gram,
    null for a text without words. A null text counts as none and fails. Ids
    missing from ``labels`` are scored like all others. Without labelled good
    documents every score is 0, and without both kinds only ``base_failed``
    decides. Empty tables give an empty result; repeated rows are judged
    alike; a text of any length is counted and scored whole.
    """
    good = F.col("quality") == 1 if good is None else good
    model = ratios(docs, labels.where(good), id_col, text_col, buckets, most_broadcast)
    llr = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    passed = [c for c in docs.columns if c not in (*names, "score", "base_failed", "kept")] if carry else [id_col]
    rows = docs.select(*passed, F.coalesce(F.col(text_col), F.lit("")).alias("_x3_text"), (fold_of(F.col(id_col)) * buckets).alias("_x3_at")).withColumn("_x3_words", words_of(F.col("_x3_text")))
    words, summed = F.col("_x3_words"), lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(llr, b + F.col("_x3_at"))) / F.lit(float(UNIT)) / F.size(g)
    score = F.when(F.size(words) > 0, let(grams(words, buckets), summed))
    scored = materialise(rows.select(*passed, *statistics(F.col("_x3_text"), words), score.alias("_x3_score")), "scored")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    at = threshold(scored, labels, id_col, good)
    return scored.select(*passed, *names, F.col("_x3_score").alias("score"), failed.alias("base_failed"), (~failed & (F.col("_x3_score") >= F.lit(at))).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
