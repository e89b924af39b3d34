"""Case tables on plain Parquet: entities, edges and audit, in folders by a hash of the case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import schema
from threadloom.operators.cutting import Workspace

LAYOUT = {
    "entities": (schema.ENTITIES, "case_id"),
    "edges": (schema.EDGES, "src_case"),
    "audit": (schema.AUDIT, "case_id"),
}
# folders per table: each holds the cases of one hash, so many small cases share files
BUCKETS = 64


class CaseStore:
    """Reads and writes the stored tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        shape, _ = LAYOUT[table]
        path = self._path(table)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(T.StructType([*shape.fields, T.StructField("bucket", T.IntegerType())])).parquet(path).drop("bucket")

    def append(self, table: str, rows: DataFrame) -> None:
        self._write(table, rows, "append")

    def replace_cases(self, table: str, rows: DataFrame, cleared: DataFrame | None = None) -> None:
        """Give the cases in ``rows``, and the emptied ones of ``cleared`` (case_id), these rows and no others.

        Only the folders of those cases are rewritten. Their other cases are read and written again,
        through a table of their own, since a folder cannot be read while it is replaced.
        """
        _, key = LAYOUT[table]
        cases = rows.select(F.col(key).alias("gone"))
        if cleared is not None:
            cases = cases.unionByName(cleared.select(F.col("case_id").alias("gone")))
        work = Workspace(self.spark, "store")
        cases = work.cut(cases.distinct(), "cases")
        touched = cases.select(_bucket("gone").alias("folder")).distinct()
        stored = self.read(table)
        others = stored.join(touched, _bucket(key) == F.col("folder"), "left_semi").join(cases, F.col(key) == F.col("gone"), "left_anti")
        after = work.cut(others.unionByName(rows.select(*stored.columns)), "after")
        emptied = touched.join(after.select(_bucket(key).alias("folder")).distinct(), "folder", "left_anti")
        self._write(table, after, "overwrite")
        for row in emptied.collect():  # at most BUCKETS
            self._remove(f"{self._path(table)}/bucket={row['folder']}")

    def _remove(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def _write(self, table: str, rows: DataFrame, mode: str) -> None:
        shape, key = LAYOUT[table]
        names = [f.name for f in shape.fields]
        # a few writers per folder: cluster by bucket, but let a hot case spread over several files
        spread = F.pmod(F.xxhash64(*[c for c in names if c not in (key, "props")]), F.lit(8))
        (
            rows.select(*names, _bucket(key).alias("bucket"))
            .repartition("bucket", spread)
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(self._path(table))
        )


def _bucket(case: str) -> Column:
    return F.pmod(F.xxhash64(F.col(case)), F.lit(BUCKETS)).cast("int")
