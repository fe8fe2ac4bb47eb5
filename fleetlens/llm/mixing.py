"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row gets an exponential key ``-ln(u) / weight`` (u from the md5 of id and text, so that
reruns agree); within its source, rows are taken in key order until the prefix sum of sizes reaches the
source's budget.  Complete epochs come first: a source whose target is at least its size gives
every row once (or twice), and only the rest of the target is sampled.  The row at the edge
is taken if more than half of it fits, so taken sizes end within half a row of the target.

The prefix sum needs no global sort: sizes are added up per source and key bucket (partial
aggregation), the sums of whole buckets are prefix-summed, the bucket in which the budget ends is cut
into as many buckets again, and only the rows of the one in which the budget ends then are sorted.  Buckets are equal steps of the
key's logarithm: whatever the weights are, that logarithm has a density of at most 1/e, so that no bucket
is expected to hold more than 0.043 % of its source's rows (of these, the second cut leaves a 16,384th).
A source with most of all rows therefore costs no more than its share.

Defined results: null sources are a source of their own, last in order; null sizes count 0 and
null weights 1; rows of size 0 follow their source's epochs; repeated rows are sampled each on their
own (equal keys, so which of them is taken does not matter); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BUCKETS = 1 << 14
#: Logarithms of keys that the buckets cover; those outside (six in a million) go to the first and last.
LOG_KEYS = (-12.0, 7.0)


def _coarse() -> Column:
    return F.floor(F.col("_bucket") / BUCKETS).cast("int")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Documents with many symbol characters weigh less: 1 - 4 x their share, 0.05 at least; 1 for empty texts."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 4 * F.try_divide(symbols.cast("double"), n.cast("double"))), F.lit(1.0))


def exponential_key(ident: Column, text: Column, weight: Column) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from 48 bits of a hash of id and text."""
    digest = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The rows the operator works on: ``_source``, ``_size``, ``_key`` and ``_bucket`` beside the struct ``_row``
    of the columns ``keep`` (default: all), which can't clash with them, and the id as ``_id``."""
    t, weight = F.col(text), quality_weight(F.col(text))
    cols = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    rows = docs.select(F.struct(*cols).alias("_row"), F.col(id_col).alias("_id"), F.col(source).alias("_source"),
                       word_count(t).alias("_size"), exponential_key(F.col(id_col), t, weight).alias("_key"))
    step = (F.log("_key") - LOG_KEYS[0]) * (BUCKETS * BUCKETS / (LOG_KEYS[1] - LOG_KEYS[0]))  # fine buckets; their order is that of the keys
    return rows.withColumn("_bucket", F.least(F.greatest(F.floor(step), F.lit(0)), F.lit(BUCKETS * BUCKETS - 1)).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(``_source``, ``source_size``, ``target``) from one row per source.

    Weights repeat over the sources by code point, null last.  The total is shared by weight; targets stop
    at ``cap`` times their source's size and the excess goes to the others by weight.  With sources
    by cap / weight, those before the first whose cap exceeds its share of the rest are
    at their cap, the others share the rest; one window over as many rows as there are sources.
    """
    order = W.orderBy(F.col("_source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    rows = (sizes.withColumn("w", w).withColumn("n", n).withColumn("cap", F.col("source_size") * float(cap)))
    full = W.partitionBy(F.lit(0))
    by = W.orderBy(F.col("cap") / F.col("w"), "n")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(full) * float(share)).withColumn("all_w", F.sum("w").over(full))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                           / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("capped", F.min((F.col("cap") <= F.col("level") * F.col("w")).cast("int")).over(by) == 1)
    rows = rows.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "n", "level"))).over(full)["level"])
    return rows.select("_source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _edges(sums: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of ``plan`` the bucket of ``sums`` (``_source``, ``_at``, ``size``) in which its ``rest`` ends, as ``edge``, and the
    size before it, ``before``; sources in which it ends nowhere have no row."""
    own = plan.select(F.col("_source").alias("_s"), "rest", F.col("before").alias("_from"))
    in_order = W.partitionBy("_source").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = sums.withColumn("upto", F.sum("size").over(in_order)).join(own, F.col("_source").eqNullSafe(F.col("_s")))
    upto = F.col("_from") + F.col("upto")
    return (ends.filter((upto > F.col("rest")) & (upto - F.col("size") <= F.col("rest")))
            .select("_s", F.col("_at").alias("edge"), (upto - F.col("size")).alias("before")))


def budgets(rows: DataFrame) -> DataFrame:
    """One row per source of ``rows`` (as :func:`measured` gives them): its target, complete epochs, the
    rest to sample, and the fine bucket ``edge`` in which that rest ends, with the size ``before`` it."""
    sums = written(rows.groupBy("_source", _coarse().alias("_at")).agg(F.sum("_size").alias("size")), "mix-sums")
    plan = targets(sums.groupBy("_source").agg(F.sum("size").alias("source_size")))
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("before", F.lit(0).cast("long"))
    coarse = _edges(sums, plan)
    same = F.col("_source").eqNullSafe(F.col("_s"))
    plan = written(plan.drop("before").join(coarse, same, "left").drop("_s"), "mix-coarse")
    own = plan.select(F.col("_source").alias("_s"), "edge")
    fine = (rows.select("_source", "_bucket", "_size").join(own, same & (_coarse() == F.col("edge")))
            .groupBy("_source", F.col("_bucket").alias("_at")).agg(F.sum("_size").alias("size")))
    return plan.drop("edge", "before").join(_edges(fine, plan), same, "left").drop("_s")


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies`` (how often the mix takes the row);
    equal keys are ordered by id and size.  Only rows of a source's edge bucket are shuffled."""
    own = plan.withColumnRenamed("_source", "_s")
    with_plan = rows.join(own, F.col("_source").eqNullSafe(F.col("_s")))
    inside = F.col("_bucket").eqNullSafe(F.col("edge"))
    by = W.partitionBy("_source").orderBy("_key", "_id", "_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("before") + F.sum("_size").over(by) - F.col("_size") / 2
    sampled = F.col("rest") > 0  # else rows of size 0 would come once more than their source's epochs
    edge = with_plan.filter(inside).withColumn("copies", F.col("epochs") + ((middle <= F.col("rest")) & sampled).cast("long"))
    under = F.coalesce((F.col("_bucket") < F.col("edge")) & sampled, F.lit(True))  # sources without words have no edge
    clear = with_plan.filter(~inside).withColumn("copies", F.col("epochs") + under.cast("long"))
    return clear.unionByName(edge).select(*rows.columns, "source_size", "target", "copies")
