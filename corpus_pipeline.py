"""From documents to training sequences: quality, exact copies, near copies, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft import storage
from gridweft.llm import exact_dedup, mixing, near_dedup, packing, quality


#: Stands for a null id, so that null joins with null.
NO_ID = -(2**63)


class _Numbered:
    """Documents with numbers for names, c0, c1 and so on, so that no column of theirs clashes with one of an operator's."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.own = [f"c{i}" for i in range(len(self.columns))]
        self.df = docs.toDF(*self.own)
        self.id, self.text, self.source = (self.own[self.columns.index(c)] for c in ("doc_id", "text", "source"))

    def keyed(self, mark: Column) -> DataFrame:
        """With the columns id, null as NO_ID, and mark in front."""
        return self.df.select(F.coalesce(F.col(self.id).cast("long"), F.lit(NO_ID)).alias("id"), mark.alias("mark"), *self.own)

    def named(self, df: DataFrame) -> DataFrame:
        """The documents' columns under their names again."""
        return df.select(*self.own).toDF(*self.columns)


def _decided(rows: DataFrame, mark: str, *more: Column) -> DataFrame:
    """(id, mark, ...) of an operator's rows, to join with keyed documents."""
    return rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col(mark).alias("mark"), *more)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier grades as good; what it rejects goes.

    Null and empty texts have the features of a text without words and are judged by them; repeated rows are judged
    alike. Labels count once an id, with their lowest grade; without labels all documents stay. No rows give no rows.
    """
    rows = _Numbered(docs)
    model = quality.train(docs, quality.label_grades(_labels(spark, sf_dir)), 3)
    return rows.named(quality.grade(rows.df, model, 2, rows.id, rows.text, carry=True).where("selected"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest id.

    Null counts as the empty text, so that of all such documents one stays. A null id is below all others. Of rows that
    share id and text any one stays, whole. No rows give no rows.
    """
    rows = _Numbered(docs)
    kept = _decided(exact_dedup.dedup_exact(docs).where("kept"), "digest")
    digest = exact_dedup.sha256_digest(F.coalesce(F.col(rows.text), F.lit("")))
    return rows.named(rows.keyed(digest).join(kept, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"]))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, on five-word shingles at a similarity of 0.8: the smallest id.

    Null and empty texts are near nothing and stay. A null id is above all others, and texts without an id are
    documents of their own; rows that share an id are one document and stay or go together. No rows give no rows.
    """
    rows = _Numbered(docs)
    kept = _decided(near_dedup.near_groups(docs, hashed=True).where("kept"), "text_hash").distinct()
    return rows.named(rows.keyed(F.xxhash64(rows.text)).join(kept, ["id", "mark"], "left_semi"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; documents that it doesn't take go.

    Null and empty texts have no words and are never taken. A null source is a source of its own. Ties of the sampling
    key are ordered by id, size and text; rows that share id and text are each taken as often as the one that is taken
    most. No rows give no rows.
    """
    rows = _Numbered(docs)
    mixed = mixing.mix(docs, quality=mixing.label_weights(_labels(spark, sf_dir)), hashed=True).where("taken > 0")
    copies = _decided(mixed, "text_hash", F.expr("taken div size").cast("int").alias("copies")).groupBy("id", "mark").agg(F.max("copies").alias("copies"))
    taken = rows.keyed(F.xxhash64(rows.text)).join(copies, ["id", "mark"])
    return rows.named(taken.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens.

    Null and empty texts are one token, the end of a document. Repeated rows are packed as often as they occur. No rows
    give no rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("minhash near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = storage.stored(docs, "pipeline")
    return docs


#: SQL can't express the classifier and the packing; the tests hold the stages against brute force.
ORACLE_SQL = None
