"""Tables in between of loops, in the folder that driver and executors share, and tables that no join may broadcast."""

from __future__ import annotations

import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may lack one and gets a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='meshloom-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def large(df: DataFrame) -> DataFrame:
    """``df`` with as many rows as the mesh, which joins must shuffle.

    Spark takes a table's size from its compressed files and doesn't see what ``explode`` adds: it would gather
    millions of rows on the driver to broadcast them.
    """
    return df.hint("merge")


def met(df: DataFrame) -> DataFrame:
    """``df`` with a row for each node, which joins shuffle and keep as a hash table for each task, so that edges need no sort."""
    return df.hint("shuffle_hash")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table by Spark's own access to files."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


#: Bytes of a kept table's files up to which Spark may broadcast it.
SMALL = 1 << 20


#: Rows of a loop's largest table for each partition of its shuffles, and the bytes up to which Spark merges them.
ROWS, MERGED = 250_000, 4 << 20


def own_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session with the settings of the user's but these; the user's stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in settings.items():
        own.conf.set(key, value)
    return own


def many(spark: SparkSession, rows: int) -> int | None:
    """How many partitions a shuffle of so many rows needs beyond the session's own, None if these do."""
    want = -(-rows // ROWS)
    return want if want > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


class Tables:
    """Tables written in a ``with`` block, which cut the lineage of a loop; all but those that ``stay`` are deleted at its end, also after an error."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def kept(self, df: DataFrame, stay: bool = False, hinted: bool = True) -> DataFrame:
        """``df``, written and read again; not ``hinted`` if its joins hint how the other side is met."""
        path = f"{shared_folder(self.spark)}/mesh-{uuid.uuid4().hex}"
        if not stay:
            self.paths.append(path)
        df.write.parquet(path)
        return self.read(path, df, hinted)

    def read(self, path: str, df: DataFrame, hinted: bool = True) -> DataFrame:
        made = self.spark.read.schema(df.schema).parquet(path)
        return large(made) if hinted and self.bytes_of(path) > SMALL else made

    def widened(self, df: DataFrame) -> DataFrame:
        """``df``, the table kept last without a hint, in a session whose shuffles have a partition for each ROWS of its rows; so are tables kept from now on."""
        want = many(self.spark, df.count())
        if want is None:
            return df
        self.spark = own_session(self.spark, **{"spark.sql.shuffle.partitions": str(want), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(MERGED)})
        return self.read(self.paths[-1], df, hinted=False)

    def bytes_of(self, path: str) -> int:
        to = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return to.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(to).getLength()

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []
