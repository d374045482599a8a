"""Mixing sources to target weights: weighted fair queueing over shuffled documents (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, bucket_of, buckets_for, durable, hot_join, running_sum, small, sums_before, table, unit_hash

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Items that one task orders to find the cut; parts that a larger range is divided into.
CUT_ROWS, FINER = 50_000, 1_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS + "+"))).cast("long")


def source_targets(sizes: DataFrame, epochs: int, budget: float | None = None) -> DataFrame:
    """(_skey, source_size, weight) to these and ``target``: shares of the budget by weight, none above epochs x its size.

    The excess of sources that hit their ceiling is shared again by weight until none is above. In the order of ceiling
    over weight the sources at their ceiling come first, so the common level is found with running sums over this table,
    which has one row for each source. It is the level of the first row that is not above its ceiling: after it the sums
    take sources as full that are not, and the level only falls.
    """
    ceiling = F.lit(epochs) * F.col("source_size")
    everything = Window.partitionBy()
    ordered = Window.orderBy((ceiling / F.col("weight")), "_skey")
    total = F.sum("source_size").over(everything) if budget is None else F.lit(budget)
    rows = (
        sizes.withColumn("_total", total)
        .withColumn("_full", F.coalesce(F.sum(ceiling).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
        .withColumn("_level", F.max(F.when(F.col("_level") <= ceiling / F.col("weight"), F.col("_level"))).over(everything))
    )
    target = F.least(F.coalesce(F.col("_level") * F.col("weight"), ceiling.cast("double")), ceiling.cast("double"))
    return rows.select("_skey", "source_size", target.alias("target"))


def source_key(source: str) -> Column:
    """Orders sources by code point, null last."""
    return F.concat(F.when(F.col(source).isNull(), "1").otherwise("0"), F.coalesce(F.col(source), F.lit("")))


def crossing(cells: DataFrame, budget: float):
    """The first cell whose values and those ``before`` it are above the budget, or None."""
    return cells.filter(F.col("before") + F.col("n") > budget).orderBy("cell").limit(1).first()


def queue(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, source, size, _skey, _place, source_size, target, epochs_taken) for every row of ``docs``.

    Each document gets a virtual finish time: the tokens of its source up to and with it, in a shuffled order that a hash
    of key and size fixes, over the source's target; a further epoch adds the source's size. Items (document, epoch) are sorted
    by finish time over all sources and cut at the budget, which is the sum of all sizes. The sort is by ranges: ranges
    that lie wholly before the cut need only their sums; rows are ordered in the one range that holds it.

    Null sources form a source of their own, the last in order; rows alike in all columns are separate items; empty
    documents take nothing. A source without words, or an empty table, has targets of 0.
    """
    base = durable(
        docs.select(key, source, size.alias("size"))
        .withColumn("_skey", source_key(source))
        .withColumn("_place", unit_hash(F.lit("mix"), key, "size"))
    )
    rows = base.count()
    sizes = base.groupBy("_skey").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("_skey")) - 1) % len(weights)
    sizes = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    targets = durable(source_targets(sizes, epochs))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0

    queued = running_sum(base, "_skey", "_place", [key, "size"], F.col("size"), buckets_for(rows), "_before", more=targets)
    times = [F.try_divide(F.lit(e) * F.col("source_size") + F.col("_before") + F.col("size"), F.col("target")) for e in range(epochs)]
    items = F.array(*[F.struct(t.alias("finish"), F.col("_skey").alias("skey"), F.col("_place").alias("place"), F.col(key).alias("key"), F.lit(e).alias("epoch"), F.col("size").alias("size")) for e, t in enumerate(times)])
    queued = durable(queued.withColumn("_items", items))

    ranges = buckets_for(rows * epochs)
    cells = queued.select(F.explode("_items").alias("i")).filter(F.col("i.finish").isNotNull() & (F.col("i.size") > 0))
    cells = cells.withColumn("cell", bucket_of(F.col("i.finish") / 2, 2 * ranges))
    found = durable(cells.groupBy("cell").agg(F.sum("i.size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("i.finish").alias("low"), F.max("i.finish").alias("high")))
    cut = crossing(sums_before(found, [], "cell", "n", 2 * ranges, "before"), budget)
    if cut is None:
        kept = F.col("_items")
    else:
        inside = cells.filter(F.col("cell") == cut["cell"])
        while cut["rows"] > CUT_ROWS and cut["high"] > cut["low"]:
            # finer and finer ranges; items of one source and epoch never finish at the same time
            fine = F.least(F.floor((F.col("i.finish") - cut["low"]) / ((cut["high"] - cut["low"]) / FINER)), F.lit(FINER - 1))
            inside = inside.withColumn("cell", fine)
            found = inside.groupBy("cell").agg(F.sum("i.size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("i.finish").alias("low"), F.max("i.finish").alias("high"))
            before = cut["before"]
            cut = crossing(sums_before(found, [], "cell", "n", FINER, "before").withColumn("before", F.col("before") + before), budget)
            inside = inside.filter(F.col("cell") == cut["cell"])
        inside = inside.withColumn("upto", F.sum("i.size").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) + cut["before"])
        first_out = inside.filter(F.col("upto") > budget).agg(F.min("i").alias("i"))
        i = first_out.first()["i"]
        bound = F.struct(*[F.lit(i[f.name]).cast(f.dataType).alias(f.name) for f in inside.schema["i"].dataType])
        kept = F.filter("_items", lambda x: x < bound)
    n = F.size(F.filter(kept, lambda x: x["finish"].isNotNull()))
    return queued.select(key, source, "size", "_skey", "_place", "source_size", "target", n.alias("epochs_taken"))


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """(key, source, size, source_size, target, taken, epochs_taken) for every row of ``docs``; see ``queue``."""
    rows = queue(docs, size, key=key, source=source, **settings)
    return rows.select(key, source, "size", "source_size", "target", (F.col("epochs_taken") * F.col("size")).cast("long").alias("taken"), "epochs_taken")


def mixed_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", epochs: int = MOST_EPOCHS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns as they came.

    A source is taken in the order of its queue, so that all there is to know is, for each source and epoch, the first item
    that is left out: a table of one row for each source, which is sent to every task; no text moves. Where that item has
    rows alike in key and size, all of these are left out, so that the budget holds.
    """
    item = F.struct(F.col("_place").alias("place"), F.col("_k").alias("key"), F.col("_n").alias("size"))
    queued = queue(docs, word_count(F.col(text)), epochs=epochs, key=key, source=source).withColumnsRenamed({key: "_k", "size": "_n"})
    out = [F.min(F.when(F.col("epochs_taken") <= e, item)).alias(f"_out{e}") for e in range(epochs)]
    bounds = durable(queued.filter(F.col("target") > 0).groupBy("_skey").agg(F.count(F.lit(1)).alias("_rows"), *out))
    sized = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_k"), word_count(F.col(text)).alias("_n"), source_key(source).alias("_skey"))
    sized = sized.withColumn("_place", unit_hash(F.lit("mix"), "_k", "_n"))
    near = small(bounds)
    met = sized.join(near, "_skey") if near is not bounds else hot_join(sized, bounds, "_skey", "_rows", ["_place"], queued.count())
    times = F.lit(0)
    for e in range(epochs):
        times = times + F.when(F.col(f"_out{e}").isNull() | (item < F.col(f"_out{e}")), 1).otherwise(0)
    return met.withColumn("_times", times).filter("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def op4_mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents with weights 5, 2, 1 repeating over the sources in code point order, null last."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH base AS (
    SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS skey,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '~') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS place
    FROM documents
), sizes AS (SELECT skey, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
weighted AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS weight, sum(source_size) OVER ()::BIGINT AS total FROM sizes),
levels AS (
    SELECT *, (total - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM weighted WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, skey)
), targets AS (
    SELECT skey, source_size, total, least((max(CASE WHEN level <= (3 * source_size)::DOUBLE / weight THEN level END) OVER ()) * weight, (3 * source_size)::DOUBLE) AS target
    FROM levels
), items AS (
    SELECT r, doc_id, skey, size, source_size, total, target, place, e,
           (e * source_size + sum(size) OVER (PARTITION BY skey, e ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::DOUBLE / nullif(target, 0) AS finish
    FROM base JOIN targets USING (skey), range(3) t(e)
), cut AS (
    SELECT *, finish IS NOT NULL AND sum(CASE WHEN finish IS NULL THEN 0 ELSE size END) OVER (ORDER BY finish NULLS LAST, skey, place, doc_id NULLS FIRST, e, size ROWS UNBOUNDED PRECEDING) <= total AS inside
    FROM items
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(CASE WHEN inside THEN size ELSE 0 END)::BIGINT AS taken
FROM cut GROUP BY r
"""
