"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / weight, with u from a hash of
its id (so reruns agree) and weight its quality. A source whose target exceeds
its size first takes complete epochs of all its documents, then the rest in the
order of the keys until the budget of words is used up.

Sorting a source that holds a third of all rows would put a third of the rows
into one task. So keys fall into ``BUCKETS`` ordered buckets; words are summed
by (source, bucket), the bucket in which the budget ends is found from these
sums, and only that bucket's documents are sorted. What the mix then needs is
one row a source (epochs, and the key and id at which it stops), joined to the
documents without shuffling texts.

Ranking the sources by name and finding the targets works on one row a source,
after aggregation, in one task: it grows with the number of sources only.

Defined cases: null text has size 0; null source ranks last; documents that
agree in source, key and id (repeated rows) are one unit at the boundary and
share what is taken of it; a source without words has target 0; null ids share
one key value and count as id 0 in ties; an empty table gives an empty result;
extra columns are unread, and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.llm.common import n_words_of, written

#: Ordered key ranges of a source, for each doubling of the key.
BUCKETS = 512
#: Weights by the rank of the source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words taken of all sources together, as a share of their size; of one, as a multiple of its size.
TOTAL, CAP = 1.5, 2.0


def quality_weight(text: Column) -> Column:
    """Document quality in [0.05, 1]: the less of the text is symbols, the more weight."""
    text = F.coalesce(text, F.lit(""))
    share = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("double") / F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.greatest(F.lit(0.05), 1.0 - 5.0 * share)


def sample_key(id_: Column, weight: Column) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from 48 bits of the id's MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(1 << 48))) / weight


def _bucket(key: Column) -> Column:
    return F.floor(BUCKETS * F.log2(key)).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, source_size and target, from one row a source (source, source_size).

    Capping and resharing the excess by weight until nothing is above its cap
    ends where every uncapped source has the same target per weight. In the
    order of cap / weight the capped sources come first, so running sums give it.
    """
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = (total * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level)
    # The first source in this order whose cap isn't below the level sets the level of all that follow.
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(all_rows)
    final = leveled.withColumn("at", first)
    return final.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("w") * F.col("at.level"), F.col("most"))).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col)
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words_of(text).alias("size"), sample_key(F.col(id_col), quality_weight(text)).alias("key")]


def mix_plan(keyed: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """One row a source: p_source, source_size, target, epochs, and where the last, partial epoch stops: cut_key, cut_id, cut_words of the cut_n rows there."""
    parts = written(keyed.withColumn("bucket", _bucket(F.col("key"))).groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    plan = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = written(plan.withColumn("budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "p_source"), "mix-sources")
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("source").eqNullSafe(F.col("p_source"))
    stop = (
        parts.withColumn("upto", running)
        .join(plan.select("p_source", "budget"), same)
        .where((F.col("budget") > F.col("upto") - F.col("words")) & (F.col("budget") <= F.col("upto")))
        .select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), (F.col("budget") - F.col("upto") + F.col("words")).alias("left"))
    )
    units = keyed.withColumn("bucket", _bucket(F.col("key"))).join(stop, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    units = units.groupBy("source", "key", F.coalesce("doc_id", F.lit(0)).alias("id"), "left").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0))
    cut = (
        units.withColumn("upto", upto)
        .where((F.col("left") > F.col("upto") - F.col("size")) & (F.col("left") <= F.col("upto")))
        .select(F.col("source").alias("c_source"), F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), (F.col("left") - F.col("upto") + F.col("size")).alias("cut_words"), F.col("size").alias("cut_size"), F.col("n").alias("cut_n"))
    )
    return plan.join(cut, F.col("p_source").eqNullSafe(F.col("c_source")), "left").drop("c_source", "budget")


def _place(key: Column, id_: Column) -> tuple[Column, Column]:
    """Whether a document comes before the cut, and whether it is at it."""
    id_ = F.coalesce(id_, F.lit(0))
    before = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (id_ < F.col("cut_id")))
    return F.coalesce(before, F.lit(False)), F.coalesce((key == F.col("cut_key")) & (id_ == F.col("cut_id")), F.lit(False))


def mix_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken: the words that the mix takes, the last document of a source in part."""
    keyed = written(docs.select(*_keyed(docs, id_col, text_col, source_col)), "mix-keys")
    plan = written(mix_plan(keyed, weights, total, cap).coalesce(1), "mix-plan")
    before, at = _place(F.col("key"), F.col("doc_id"))
    extra = F.when(before, F.col("size")).when(at, F.least(F.col("size"), F.floor(F.col("cut_words") / F.col("cut_n")))).otherwise(0)
    joined = keyed.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """The mixed corpus, columns as they came: whole documents, each as often as it is taken; the document at a source's cut is taken if at least half of it is."""
    keyed = written(docs.select(*_keyed(docs, id_col, text_col, source_col)), "mix-keys")
    plan = written(mix_plan(keyed, weights, total, cap).coalesce(1), "mix-plan")
    rows = docs.select(F.struct("*").alias("doc"), *[c.alias(n) for c, n in zip(_keyed(docs, id_col, text_col, source_col), ("m_id", "m_source", "m_size", "m_key"))])
    before, at = _place(F.col("m_key"), F.col("m_id"))
    half = at & (2 * F.col("cut_words") >= F.col("cut_size"))
    copies = F.col("epochs") + F.when(before | half, 1).otherwise(0)
    joined = rows.join(plan, F.col("m_source").eqNullSafe(F.col("p_source")))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("doc.*")
