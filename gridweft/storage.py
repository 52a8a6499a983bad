"""Tables in the shared folder that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests, local runs) a new temporary folder, set once."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gridweft-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path with everything below it; a missing path is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Codec of stored tables.
COMPRESSION = "zstd"
#: Rows that a file of in_few_files() holds, about.
ROWS_A_FILE = 4_000_000


def in_few_files(df: DataFrame, rows: int = 0) -> DataFrame:
    """The rows in a sixteenth of the shuffle partitions, or in more where a counted number of rows asks for it, up to all.

    Without ``rows`` for tables whose size a parameter bounds.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, most // 16, min(most, -(-rows // ROWS_A_FILE))))


class Stored:
    """A DataFrame written once as Parquet in the shared folder; ``df`` reads it back.

    With ``by``, a text column that isn't null, there is a folder for each of its values, and a read that selects values
    lists those folders alone. Rows of a value are brought together first, large values as several files.

    With ``keys`` it is a table in as many buckets of these columns as there are shuffle partitions, so that joins and
    groups on them need no shuffle of it. The table is external, its name is new, and ``drop`` takes it out of the
    catalog. The rows are dealt to their buckets first unless ``dealt`` says that they come from a group by the keys.
    """

    def __init__(self, df: DataFrame, name: str, by: str | None = None, keys: Sequence[str] = (), dealt: bool = False):
        self.spark = df.sparkSession
        self.path, self.table = new_path(self.spark, name), None
        if keys:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.table = f"gridweft_{uuid.uuid4().hex}"
            rows = df if dealt else df.repartition(buckets, *keys)
            rows.write.option("compression", COMPRESSION).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", self.path).saveAsTable(self.table)
            self.df = self.spark.table(self.table)
        elif by:
            df.hint("rebalance", by).write.option("compression", COMPRESSION).partitionBy(by).parquet(self.path)
            # An empty text comes back as null.
            self.df = self.spark.read.schema(df.schema).parquet(self.path).select(*[F.coalesce(by, F.lit("")).alias(by) if c == by else c for c in df.columns])
        else:
            df.write.option("compression", COMPRESSION).parquet(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The DataFrame, computed now and read back from the shared folder."""
    return Stored(df, name, by).df


def bucketed(df: DataFrame, name: str, *keys: str, dealt: bool = False) -> DataFrame:
    """The DataFrame, computed now and read back in buckets of its keys."""
    return Stored(df, name, keys=keys, dealt=dealt).df
