"""Exact deduplication by a stateful stream.

A batch pass turns every document into a record (digest, id): with the digest the id is also the content locator, by
which the full text is fetched again, from the input or, where a state goes on over several calls, from the texts that
it holds. The records are a file stream; a streaming aggregation keeps, per digest, the stable identifier of the row
that stays and the number of rows, in RocksDB state on the executors' disks with a changelog in the shared folder, and
never expires it. The state is read back as a table. Where a digest was hit again, the full bytes of each row are
compared with those at the locator; rows whose bytes differ under one digest are grouped anew by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft import storage

#: Rows of one group whose bytes are compared in one task; larger groups are split over salts.
ROWS_A_SALT = 2000
#: Stands for a null id in the locator.
NO_ID = -(2**63)


def sha256_digest(text: Column) -> Column:
    """The SHA-256 of a text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DedupState:
    """Keyed state of a stream of digest records in ``folder``; later calls of :meth:`add` meet what earlier ones left.

    State has a row for each digest ever seen: n (rows), keep_id (largest id; null below any id).
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or storage.new_path(spark, "dedup-state")
        self.records = f"{self.folder}/records"
        self.texts = f"{self.folder}/texts"
        self.checkpoint = f"{self.folder}/checkpoint"

    def add(self, records: DataFrame) -> None:
        """Append records (digest binary, id long) and run the stream over what is new."""
        records.select("digest", "id").write.mode("append").parquet(self.records)
        conf = self.spark.conf
        wanted = {
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        }
        before = {k: conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            conf.set(k, v)
        try:
            stream = self.spark.readStream.schema("digest binary, id long").parquet(self.records)
            grouped = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"))
            query = (
                grouped.writeStream.outputMode("update")
                .format("noop")
                .option("checkpointLocation", self.checkpoint)
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def table(self) -> DataFrame:
        """The state: digest, n, keep_id."""
        state = self.spark.read.format("statestore").load(self.checkpoint)
        n, keep = (f.name for f in state.schema["value"].dataType.fields)
        return state.select("key.digest", F.col(f"value.`{n}`").alias("n"), F.col(f"value.`{keep}`").alias("keep_id"))


def dedup_exact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
    state: DedupState | None = None,
) -> DataFrame:
    """Groups of equal texts over all rows: (id_col, keep_id, group_size, kept, digest), one row per row of ``docs``.

    Texts are equal when their bytes are; null counts as the empty text, which is a text like any other, so that all
    null and empty rows are one group. The row with the largest id stays; a null id is below all others. Of rows
    repeated with the same id and text, one is kept. An empty table gives no rows. Other columns of ``docs``, whatever
    their names, are not read. ``state`` continues a stream of earlier calls: keep_id and group_size then cover their
    rows too, and their texts, which the state's folder holds, are compared with those of this call.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    own = state is None
    state = state or DedupState(spark)
    state.add(base)
    if own:
        records, known = spark.read.schema("digest binary, id long").parquet(state.records), base
    else:
        base.write.mode("append").parquet(state.texts)
        records, known = base.select("digest", "id"), spark.read.schema(base.schema).parquet(state.texts)
    found = records.join(state.table(), "digest", "left")
    decided = storage.stored(found, "dedup-decided")

    # Full bytes are compared where a digest was hit: rows of groups with more than one row against the row at the locator.
    at = lambda c: F.coalesce(F.col(c), F.lit(NO_ID)).alias("at")
    hits = decided.where("n > 1").groupBy("id", "digest").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"))
    salts = F.ceil(F.col("n") / ROWS_A_SALT).cast("int")
    if own:
        hits = hits.select(at("id"), "digest", "n", (~F.col("id").eqNullSafe(F.col("keep_id"))).alias("member"))
    else:
        locators = hits.groupBy("digest").agg(F.max("keep_id").alias("id"), F.max("n").alias("n"))
        hits = hits.select(at("id"), "digest", "n", F.lit(True).alias("member")).unionByName(locators.select(at("id"), "digest", "n", F.lit(False).alias("member")))
    hit_texts = storage.Stored(known.select(at("id"), "digest", "text").join(hits, ["at", "digest"]), "dedup-hits")
    # Rows of the id that stays are members too, as a row with that id may have another text.
    members = hit_texts.df.select("digest", "text", F.pmod(F.xxhash64("at"), salts).cast("int").alias("salt"))
    keepers = hit_texts.df.where("NOT member").groupBy("digest").agg(F.first("text").alias("keep_text"), F.max("n").alias("n"))
    keepers = keepers.select("digest", "keep_text", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    unequal = storage.stored(
        members.join(keepers, ["digest", "salt"]).where(F.col("text") != F.col("keep_text")).select("digest").distinct(),
        "dedup-unequal",
    )
    hit_texts.drop()
    if not unequal.isEmpty():
        clash = lambda rows: rows.join(unequal, "digest").select("id", "digest", "text")
        exact = clash(known).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"))
        redone = clash(base).join(exact, ["digest", "text"]).select("id", "digest", "n", "keep_id")
        decided = decided.join(unequal, "digest", "left_anti").select("id", "digest", "n", "keep_id").unionByName(redone)
    if own:
        storage.delete(spark, state.folder)
    nth = F.row_number().over(Window.partitionBy("digest", "id", "keep_id").orderBy("n"))
    return decided.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"),
        "digest",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document with the row that stays for its text."""
    found = dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
