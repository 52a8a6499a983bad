"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key whose rate is its quality weight. Within a source, keys ascend and sizes are
prefix-summed up to the source's token budget. A budget above the source's size first takes complete epochs of all
its documents; the fraction that is left is selected by key.

A source may hold a third of all rows, so no task sorts a whole source: keys fall into KEY_RANGES ranges of equal
probability, the sums of the ranges are prefix-summed (a short table), and each range is sorted on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft import storage

WORD = r"[^\x20\x09-\x0D]+"
KEY_RANGES = 4096


def word_count(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Targets of sources (source, source_size): share of all sizes by weight, none above ``most`` times its size.

    Sources in code point order, null last, get ``weights`` in turn. The water level is found in one pass over the
    sources, by the size at which each would be full.
    """
    count = len(weights)
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (nth % count + 1).cast("int"))
    ranked = sizes.select("source", "source_size", turn.alias("w"))
    by_level = Window.orderBy(F.col("r"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("r", (F.col("source_size") * most).cast("double") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).cast("double"))
        .withColumn("lam", (F.col("total") - F.col("full")) / F.sum("w").over(after))
        .withColumn("level", F.min(F.when(F.col("r") >= F.col("lam"), F.struct("r", "lam"))).over(everything)["lam"])
    )
    cap = (F.col("source_size") * most).cast("double")
    return level.select("source", "source_size", F.when(F.col("r") < F.col("level"), cap).otherwise(F.least(cap, F.col("level") * F.col("w"))).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    quality: DataFrame | None = None,
    seed: int = 42,
    hashed: bool = False,
) -> DataFrame:
    """What a mix takes of every document: (id_col, size, source_size, target, taken), one row per row of ``docs``.

    size counts words of the whole text, taken the words the mix takes, repeats counted: complete epochs, and one more
    copy of the documents selected for the fraction; the document at the cut is selected if that brings the source
    nearer its target. ``quality`` has a positive weight for some ids (columns id and weight; several rows of an id
    are averaged); other ids and other weights count as 1. A null source is a source of its own, after all others; null and empty texts have size 0 and are never taken. Rows
    repeated with the same id draw the same key, and ties are ordered by id and size. Other columns are not read. An
    empty table gives no rows. ``most`` bounds copies of a document as it bounds a source's target. With ``hashed`` a
    column text_hash, xxhash64 of the text, tells rows of an id apart, and orders ties last.
    """
    own = ["text_hash"] if hashed else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    rows = rows.select("id", "source", "size", *own)
    w = F.lit(1.0)
    if quality is not None:
        rows = rows.join(quality.groupBy("id").agg(F.avg("weight").alias("w")), "id", "left")
        w = F.when((F.col("w") > 0) & (F.col("w") < 1e6), F.col("w")).otherwise(1.0)
    key = -F.log(uniform(F.col("id"), seed)) / w
    rows = rows.select("id", "source", "size", key.alias("key"), *own)
    rows = rows.withColumn("range", F.least(F.lit(KEY_RANGES - 1), F.floor((1 - F.exp(-F.col("key"))) * KEY_RANGES)).cast("int"))
    rows = storage.stored(rows, "mix-rows")

    ranges = storage.stored(storage.in_few_files(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    targets = storage.stored(targets, "mix-targets")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    null_safe = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    plan = starts.join(targets, null_safe(starts, targets, ["source"])).select(
        starts["source"], "range", "before", "source_size", "target"
    )
    joined = rows.join(plan, null_safe(rows, plan, ["source", "range"])).select(
        rows["id"], rows["source"], rows["range"], "size", "key", "before", "source_size", "target", *own
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size", *own).rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    upto = F.col("before") + F.sum("size").over(inside)
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    over = F.col("upto") - F.col("left")
    fraction = (F.col("size") > 0) & ((over <= 0) | ((over < F.col("size")) & (over <= F.col("size") - over)))
    return (
        joined.withColumn("upto", upto)
        .withColumn("epochs", epochs)
        .withColumn("left", left)
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("size") * (F.col("epochs") + F.when(fraction & (F.col("epochs") < most), 1).otherwise(0))).alias("taken"),
            *own,
        )
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for good, 0.5 for bad."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5)
    return labels.select(F.col("doc_id").alias("id"), weight.alias("weight"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the mix of all documents, sources by weights 3, 1, 2 up to 150% of all words."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mix(docs, quality=label_weights(labels))


ORACLE_SQL = r"""
WITH graded AS (
  SELECT doc_id, avg(CASE WHEN quality = 1 THEN 2.0::DOUBLE WHEN quality = 0 THEN 0.5::DOUBLE END) AS w FROM labels GROUP BY doc_id
), d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(d.doc_id::VARCHAR || ':42'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / coalesce(g.w, 1.0::DOUBLE) AS k
  FROM documents d LEFT JOIN graded g ON d.doc_id = g.doc_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, (source_size * 2)::DOUBLE / w AS r, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(source_size * 2) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lam FROM r
), t AS (
  SELECT source, source_size, CASE WHEN r < lv THEN (source_size * 2)::DOUBLE ELSE least((source_size * 2)::DOUBLE, lv * w) END AS target
  FROM (SELECT *, (SELECT arg_min(lam, r) FROM l WHERE r >= lam) AS lv FROM l)
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(2, floor(t.target / t.source_size))::BIGINT ELSE 0 END AS epochs,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), y AS (
  SELECT *, upto - (target - epochs * source_size) AS over_by FROM x
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN epochs < 2 AND size > 0 AND (over_by <= 0 OR (over_by < size AND over_by <= size - over_by)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM y
"""
