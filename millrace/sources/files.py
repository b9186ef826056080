"""Text, gzip, parquet and custom files; listings; named intermediates; a registry of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """line: every line of every file below path (a folder, file or glob); .gz by suffix. Names that begin with . or _
    are passed over. Small files are read together, as spark.sql.files.openCostInBytes and maxPartitionBytes say."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(F.col("value").alias("line"))


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length of the files below path, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length")


def read_with(spark: SparkSession, path: str, reader: Callable[[bytes], Iterator[tuple]], schema: str, pattern: str | None = None) -> DataFrame:
    """Records that a user's function makes of each whole file; files are never cut."""

    def run(batches):
        import pandas as pd

        names = [c.strip().split()[0] for c in schema.split(",")]
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(list(reader(bytes(content))), columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        files = files.option("pathGlobFilter", pattern)
    return files.load(path).select("content").mapInPandas(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Buckets:
    """Named intermediates: views, computed once if kept."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """Stores rows under a name and passes them on."""
        df = df.persist() if keep else df
        df.createOrReplaceTempView(name)
        return df

    def read(self, *names: str) -> DataFrame:
        """One intermediate, or several united."""
        out = self.spark.table(names[0])
        for n in names[1:]:
            out = out.unionByName(self.spark.table(n))
        return out


SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    """Registers a source function (spark, **options) -> DataFrame."""

    def add(f):
        SOURCES[name] = f
        return f

    return add


def read(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"no source {name}")
    return SOURCES[name](spark, **options)


source("text")(lambda spark, path, **o: read_lines(spark, path, **o))
source("files")(lambda spark, path, **o: list_files(spark, path, **o))
source("bucket")(lambda spark, names: Buckets(spark).read(*names))
source("row")(lambda spark, values, names=None: spark.createDataFrame([tuple(values)], list(names or [f"c{i}" for i in range(len(values))])))
