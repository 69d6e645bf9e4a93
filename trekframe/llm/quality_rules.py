"""Quality rules with thresholds that follow each language and source.

Features of the whole text are computed inside the row (array functions, no
shuffle of words). Each feature's distribution is kept for every (language,
source) as a log-bucketed quantile sketch: counts of buckets whose bounds grow
by a fixed ratio, so quantiles have a proven relative error (``ERROR``), and
two sketches merge exactly by adding counts, in any order; those of a language
and of all come from merging.

A threshold comes from the quantiles of the values above 0, on a logarithmic
scale. The upper one is q40 + REACH (q40 - q20): six standard deviations above
the mean if values were log-normal. It looks at the lower half alone, so junk
above, be it a third of a source, hardly moves it; the lower one, likewise, is
q60 - REACH (q80 - q60). No constant of any feature takes part. Small groups
are shrunk, smoothly: a source's threshold is the mean of its own, weighted by
its rows, and its language's, weighted by ``PRIOR_ROWS``; and so is a
language's with that of all. A feature without spread in a group says nothing
there, and the wider group's threshold holds alone.

Defined cases: null text has no words and fails the base rule; null language
or source are groups of their own; ties need no order (counts only); repeated
rows count as often as they occur; an empty table gives an empty result; extra
columns are kept by ``quality_filter`` and unread otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.llm.common import bind, words_of, written

#: Relative error of a sketch's quantiles.
ERROR = 0.0025
#: Rows that the wider group's threshold counts for.
PRIOR_ROWS = 100
#: Six standard deviations of a normal distribution, from q40 in units of q40 - q20.
REACH = 10.6
#: (feature, two-sided): characters a word, marks a word, capitals a character, share of repeated lines, share of words in repeated windows.
FEATURES = (("word_len", True), ("mark_share", False), ("upper_share", False), ("dup_line_share", False), ("repeat_share", False))
_AT = {"q20": 0.2, "q40": 0.4, "q60": 0.6, "q80": 0.8}

_WORD = r"[^\x20\x09-\x0D]"


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = bind(
            placed,
            lambda t: F.transform(
                F.filter(t, lambda x, i: F.coalesce(x["h"] == F.get(t, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(t, i - 1)["h"], F.lit(False))),
                lambda x: x["i"],
            ),
        )
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"))
        return F.aggregate(F.sort_array(again), zero, step)["n"]

    return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def base_features(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_marks and n_upper (long)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD))
    return bind(
        words_of(text),
        lambda w: bind(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(ls).cast("long").alias("n_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("n_marks"),
                F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            ),
        ),
    )


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _shares(f: Column) -> dict[str, Column]:
    n = F.greatest(f["n_words"], F.lit(1)).cast("double")
    return {
        "word_len": f["word_chars"] / n,
        "mark_share": f["n_marks"] / n,
        "upper_share": f["n_upper"] / F.greatest(f["word_chars"], F.lit(1)).cast("double"),
        "dup_line_share": f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1)).cast("double"),
        "repeat_share": f["n_repeat_words"] / n,
    }


def _gamma() -> float:
    return (1 + ERROR) / (1 - ERROR)


def sketch(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Mergeable quantile sketches: keys, feature, bucket, n. Bucket null holds values of 0 and below."""
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), F.when(v > 0, F.ceil(F.ln(v) / F.lit(math.log(_gamma()))).cast("int")).alias("bucket")) for k, v in values.items()]))
    return rows.select(*keys, pairs).groupBy(*keys, "feature", "bucket").agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches over fewer keys: counts of equal buckets added."""
    return sketches.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))


def bucket_log(bucket: Column) -> Column:
    """The logarithm of the value that stands for a bucket."""
    return bucket * F.lit(math.log(_gamma())) + F.lit(math.log(2 / (_gamma() + 1)))


def sketch_quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, feature, rows, and a column a quantile: its logarithm, null where it isn't above 0."""
    order = Window.partitionBy(*keys, "feature").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "feature")
    seen = sketches.select(*keys, "feature", "bucket", F.sum("n").over(order).alias("seen"), F.sum("n").over(whole).alias("rows"))
    place = lambda q: F.min(F.when(F.col("seen") >= q * F.col("rows"), F.struct("seen", "bucket")))["bucket"]
    return seen.groupBy(*keys, "feature").agg(F.max("rows").alias("rows"), *[bucket_log(place(q)).alias(k) for k, q in at.items()])


def _log(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def _fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, rows (with a value above 0), low and high: fences on the logarithmic scale, null without spread."""
    q = sketch_quantiles(sketches.where("bucket is not null"), keys, _AT)
    up, down = F.col("q40") - F.col("q20"), F.col("q80") - F.col("q60")
    return q.select(*keys, "feature", F.col("rows").cast("double").alias("rows"), F.when(down > 0, F.col("q60") - REACH * down).alias("low"), F.when(up > 0, F.col("q40") + REACH * up).alias("high"))


def _shrunk(own: Column, wider: Column, rows: Column) -> Column:
    """A group's fence drawn towards the wider group's, the more the fewer rows it has."""
    mean = (rows * own + PRIOR_ROWS * wider) / (rows + PRIOR_ROWS)
    return F.coalesce(mean, wider, own)


def thresholds(rows: DataFrame, lang: str, source: str, features: str) -> DataFrame:
    """q_lang, q_source, and q_low_ and q_high_ of each feature, on the logarithmic scale, for each pair that occurs."""
    ok = rows.where(~base_failed(F.col(features)))
    every = rows.select(F.col(lang).alias("q_lang"), F.col(source).alias("q_source")).distinct()
    fine = sketch(ok.select(F.col(lang).alias("q_lang"), F.col(source).alias("q_source"), F.col(features)), ["q_lang", "q_source"], _shares(F.col(features)))
    fine = written(fine, "quality-sketches")
    by_lang = merge_sketches(fine, ["q_lang"])
    one = _fences(fine, ["q_lang", "q_source"]).select(F.struct("q_lang", "q_source").alias("group"), F.col("feature").alias("f1"), F.col("rows").alias("n1"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    two = _fences(by_lang, ["q_lang"]).select(F.col("q_lang").alias("lang2"), F.col("feature").alias("f2"), F.col("rows").alias("n2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    three = _fences(merge_sketches(by_lang.withColumn("q_all", F.lit(0)), ["q_all"]), ["q_all"]).select(F.col("feature").alias("f3"), F.col("low").alias("l3"), F.col("high").alias("h3"))
    wanted = every.select("q_lang", "q_source", F.explode(F.array(*[F.lit(k) for k, _ in FEATURES])).alias("feature"))
    found = (
        wanted.join(one, F.col("q_lang").eqNullSafe(F.col("group.q_lang")) & F.col("q_source").eqNullSafe(F.col("group.q_source")) & (F.col("feature") == F.col("f1")), "left")
        .join(two, F.col("q_lang").eqNullSafe(F.col("lang2")) & (F.col("feature") == F.col("f2")), "left")
        .join(F.broadcast(three), F.col("feature") == F.col("f3"), "left")  # a row a feature
    )
    sides = {side: _shrunk(F.col(f"{c}1"), _shrunk(F.col(f"{c}2"), F.col(f"{c}3"), F.col("n2")), F.col("n1")) for side, c in (("low", "l"), ("high", "h"))}
    limits = found.select("q_lang", "q_source", "feature", *[v.alias(k) for k, v in sides.items()])
    of = lambda name, side: F.max(F.when(F.col("feature") == name, F.col(side)))
    return limits.groupBy("q_lang", "q_source").agg(*[of(k, side).alias(f"q_{side}_{k}") for k, _ in FEATURES for side in ("low", "high")])


def _verdict(features: Column) -> Column:
    ok = F.lit(True)
    for (name, both), value in zip(FEATURES, _shares(features).values()):
        ok = ok & F.coalesce(_log(value) <= F.col(f"q_high_{name}"), F.lit(True))
        if both:
            ok = ok & F.coalesce(_log(value) >= F.col(f"q_low_{name}"), F.lit(True))
    return ~base_failed(features) & ok


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: its id, the features, base_failed and kept. The features, without texts, are written once and read for both the sketches and the filter."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), base_features(F.col(text_col)).alias("f")), "quality-features")
    limits = written(thresholds(rows, "lang", "source", "f").coalesce(1), "quality-thresholds")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("q_lang")) & F.col("source").eqNullSafe(F.col("q_source")), "left")
    f = F.col("f")
    return joined.select("doc_id", *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(f).alias("base_failed"), _verdict(f).alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, columns as they came. Rows and their features are written once and read for both the sketches and the filter; texts aren't shuffled."""
    rows = docs.select(F.struct("*").alias("doc"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), base_features(F.col(text_col)).alias("f"))
    rows = written(rows, "quality-rows", compression="zstd")
    limits = written(thresholds(rows, "lang", "source", "f").coalesce(1), "quality-thresholds")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("q_lang")) & F.col("source").eqNullSafe(F.col("q_source")), "left")
    return joined.where(_verdict(F.col("f"))).select("doc.*")
