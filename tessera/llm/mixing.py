"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight, so that a better document tends to come earlier;
within a source the documents are taken in the order of their keys until the running sum of sizes meets the source's
budget. A budget of at least the whole source takes complete epochs first and spends only the rest on that order.

The running sum never needs a source in one place: keys are dealt to ``BUCKETS`` fixed buckets, sums of buckets say in
which one the budget ends, and only that bucket's documents are put in exact order.

Defined results: null text has size 0; a null source is a source of its own, last in order; ties of keys go by doc_id.
Rows that repeat a doc_id draw the same key and are each taken on their own. Empty tables give empty tables; other
columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut_lineage, free

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKETS = 4096


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """1 + the share of letters of any script, digits and blanks in eighths: whole numbers, so that every engine agrees."""
    plain = F.length(text) - F.length(F.regexp_replace(text, r"[\p{L}\p{M}0-9 \n]+", ""))
    return F.coalesce(1 + F.floor(plain * 8 / F.greatest(F.length(text), F.lit(1))), F.lit(1)).cast("int")


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from the document's id alone: reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 48)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Split ``share`` of all sizes by weight; a target stops at ``most`` times its size and the rest is dealt again."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target). The driver sees one row per source, never documents."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    rows.sort(key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    found = targets([r.source_size for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, most)
    return sized.sparkSession.createDataFrame([(r.source, r.source_size, t) for r, t in zip(rows, found)], "source string, source_size long, target double")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words of each document that the mix takes, repeats counted.

    The document in which a budget ends is taken as far as the budget goes, so each source meets its target to a word.
    """
    u = uniform(F.col("doc_id"), seed)
    drawn = docs.select("doc_id", F.col("source").cast("string"), words(F.col("text")).alias("size"), (-F.log(u) / quality(F.col("text"))).alias("key"))
    sized = cut_lineage(drawn.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * 4)) * BUCKETS).cast("int")))
    goal = source_targets(sized, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    # The bucket of each source in which its budget ends, and what is left for it there.
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(run), F.lit(0)))
    ends = sums.join(_renamed(goal), F.col("source").eqNullSafe(F.col("g_source"))).where("before <= rest AND rest < before + sum")
    ends = ends.select(F.col("source").alias("e_source"), F.col("bucket").alias("end"), (F.col("rest") - F.col("before")).alias("room"))

    far = goal.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").select(F.col("source").alias("g_source"), "source_size", "target", "epochs", "rest", "end", "room")
    # One row per source: what the driver has just held is small enough to send to every task.
    rows = sized.join(F.broadcast(far), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where("bucket = end").withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = last.withColumn("part", F.least("size", F.greatest(F.col("room") - F.col("before"), F.lit(0)))).drop("before")
    rest = rows.where("end IS NULL OR bucket <> end").withColumn("part", F.when(F.col("end").isNotNull() & (F.col("bucket") < F.col("end")), F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    return rest.unionByName(last).select("doc_id", "source", "size", "source_size", "target", taken)


def _renamed(goal: DataFrame) -> DataFrame:
    return goal.select(F.col("source").alias("g_source"), "rest")


def repeat(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document as often as its share of epochs, a document begun counts as whole."""
    doc, times, copy = (free(docs, n) for n in ("__doc", "__times", "__copy"))
    keep = mix(docs, **options).where("taken > 0").groupBy(F.col("doc_id").alias(doc)).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(times))
    rows = docs.join(keep, F.col("doc_id").eqNullSafe(F.col(doc)))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; ``source`` comes along."""
    return mix(docs)

