"""Reading and replacing tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by name, or a Parquet folder when the name is a path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_jdbc(
    spark: SparkSession, url: str, table: str, split_column: str, low, high, parts: int, **options
) -> DataFrame:
    """A database table read by `parts` tasks over ranges of split_column."""
    return spark.read.jdbc(
        url,
        table,
        column=split_column,
        lowerBound=low,
        upperBound=high,
        numPartitions=parts,
        properties={key: str(value) for key, value in options.items()},
    )


def replace_table(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write df as a table (or Parquet folder), replacing an old one, and return it read back.

    The rows are written beside the old ones first and take their name only when all are there: df may
    read the table that it replaces, and a run that fails leaves the old rows. The old ones are removed
    last; if taking the name fails, they get it back. A folder (a name with "/") is renamed by its file
    system, on object stores a copy.
    """
    mark = uuid.uuid4().hex
    staged, old = f"{name.rstrip('/')}__staged_{mark}", f"{name.rstrip('/')}__old_{mark}"
    writer = df.write.partitionBy(*partition_by)
    place = _Folders(df.sparkSession) if "/" in name else _Tables(df.sparkSession)
    try:
        place.write(writer, staged)
    except BaseException:
        place.drop(staged)
        raise
    there = place.exists(name)
    if there:
        place.rename(name, old)
    try:
        place.rename(staged, name)
    except BaseException:
        if there:
            place.rename(old, name)
        place.drop(staged)
        raise
    if there:
        place.drop(old)
    return read_table(df.sparkSession, name)


class _Tables:
    """Catalog tables under changing names."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def write(self, writer, name):
        writer.format("parquet").saveAsTable(name)

    def exists(self, name) -> bool:
        return self.spark.catalog.tableExists(name)

    def rename(self, name, new):
        self.spark.sql(f"ALTER TABLE {name} RENAME TO {new}")

    def drop(self, name):
        drop_table(self.spark, name)


class _Folders:
    """Parquet folders under changing names, by the file system that Spark uses for them."""

    def __init__(self, spark: SparkSession):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.spark = spark

    def _path(self, name):
        path = self.hadoop.Path(name)
        return path.getFileSystem(self.conf), path

    def write(self, writer, name):
        writer.parquet(name)

    def exists(self, name) -> bool:
        system, path = self._path(name)
        return system.exists(path)

    def rename(self, name, new):
        system, path = self._path(name)
        if not system.rename(path, self.hadoop.Path(new)):
            raise OSError(f"{name} can't be renamed to {new}")
        self.spark.catalog.refreshByPath(new)

    def drop(self, name):
        system, path = self._path(name)
        system.delete(path, True)


def index_table_name(source: str | None) -> str:
    """Default output name of the heat index: <source>_ibm, or ibm_result for a derived frame."""
    return f"{source}_ibm" if source else "ibm_result"


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
