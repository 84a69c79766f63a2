"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A local session with the defaults that tests and benchmarks use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lectern")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=defaults | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where it is unset, as in tests on one machine, a folder in the warehouse serves.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and with its lineage cut; its partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that the steps of one operator write in the shared folder and read again.

    Unlike a checkpoint, a table has a size of its own: a plan over a loop's tables is as small
    as its first one's, and joins are planned by what is there. `drop` deletes all tables but
    those that the result reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/tables/{uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = (path, made)
        return made

    def drop(self, *keep: DataFrame) -> None:
        kept = {id(df) for df in keep}
        sc = self.spark.sparkContext
        for key in [k for k in self.paths if k not in kept]:
            place = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop(key)[0])
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again."""
    return Scratch(df.sparkSession).save(df)
