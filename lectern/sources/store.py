"""Tenant tables as Parquet: insert-or-ignore, replace and delete by file."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.schema import TABLES


#: Folders of a tenant in each table; a file lies in one of them by its id, so their number does not grow with the files.
BUCKETS = 64


class Store:
    """Six tables under ``root``, each partitioned by tenant and bucket of files.

    A file is replaced or dropped by writing its bucket anew without it. ``files`` is also the journal: a file's row in status ``wait`` is
    written before its other rows and that in status ``ok`` after them, so what a broken run left is known and goes before the file
    is stored again (K18, K25, Q22). One writer a tenant at a time is presumed (Q21).
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _located(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._located(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._located(path)
        fs.delete(p, True)

    def work(self) -> str:
        """A folder of its own for tables between two steps; the caller removes it."""
        return f"{self.root}/_work/{uuid.uuid4().hex}"

    def id_of(self, tenant: str, name: Column) -> Column:
        return F.xxhash64(F.lit(tenant), name).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.col("id" if name == "files" else "file_id"), F.lit(self.buckets)).cast("int")

    def _stored(self, name: str) -> DataFrame:
        schema = T.StructType([*TABLES[name].fields, T.StructField("_bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path(name)) if self._exists(self.path(name)) else self.spark.createDataFrame([], schema)

    def table(self, name: str, tenant: str | None = None) -> DataFrame:
        df = self._stored(name) if tenant is None else self._stored(name).filter(F.col("tenant") == tenant)
        return df.select(TABLES[name].names)

    def files(self, tenant: str) -> DataFrame:
        """``file_id, name`` of the complete files."""
        return self.table("files", tenant).filter("status = 'ok'").select(F.col("id").alias("file_id"), "name")

    def of_files(self, name: str, tenant: str, ids: DataFrame) -> DataFrame:
        """A table's rows of some files (``file_id``); only their buckets are read."""
        hit = [r[0] for r in ids.select(self._bucket("chunks")).distinct().collect()]  # bounded by the number of buckets
        some = self._stored(name).filter((F.col("tenant") == tenant) & F.col("_bucket").isin(hit))
        return some.join(ids, "file_id", "left_semi").select(TABLES[name].names)

    def file_id(self, tenant: str, name: str, status: str = "ok") -> int:
        """Id of a file in a status, 0 if there is none."""
        return self.table("files", tenant).filter((F.col("name") == name) & (F.col("status") == status)).agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; tasks are dealt by bucket, and large buckets split, so that a batch adds few files."""
        ordered = rows.select([F.col(f.name).cast(f.dataType) for f in TABLES[name]])
        ordered.withColumn("_bucket", self._bucket(name)).hint("rebalance", "_bucket").write.mode("append").partitionBy("tenant", "_bucket").parquet(self.path(name))

    def mark(self, tenant: str, names: DataFrame, status: str) -> None:
        """A row in a status for each of ``file_id, name``."""
        self.append("files", names.select(F.lit(tenant).alias("tenant"), F.col("file_id").alias("id"), "name", F.lit(status).alias("status")))

    def drop(self, tenant: str, ids: DataFrame) -> None:
        """Take the rows of files (``file_id``) out of all tables, children first (K9): their buckets are written without them, then put in place."""
        ids = ids.select("file_id").distinct()
        hit = [r[0] for r in ids.select(self._bucket("chunks")).distinct().collect()]  # bounded by the number of buckets
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tenant)
        work = self.work()  # goes only when all is in place: after a failure it holds what had been rewritten
        for table in reversed(TABLES) if hit else ():
            key = "id" if table == "files" else "file_id"
            old = self._stored(table).filter((F.col("tenant") == tenant) & F.col("_bucket").isin(hit))
            old.join(ids.withColumnRenamed("file_id", key), key, "left_anti").write.partitionBy("tenant", "_bucket").parquet(f"{work}/{table}")
            for b in hit:
                place = f"tenant={escaped}/_bucket={b}"
                self.remove(f"{self.path(table)}/{place}")
                if self._exists(f"{work}/{table}/{place}"):
                    fs, target = self._located(f"{self.path(table)}/{place}")
                    fs.mkdirs(target.getParent())
                    if not fs.rename(self._located(f"{work}/{table}/{place}")[1], target):
                        raise OSError(f"{work}/{table}/{place} was not put in place")
        self.remove(work)

    def delete(self, tenant: str, name: str) -> None:
        """Drop one file (K26). An unknown name is no error."""
        self.drop(tenant, self.spark.range(1).select(self.id_of(tenant, F.lit(name)).alias("file_id")))

    def begin(self, tenant: str, names: DataFrame) -> None:
        """Journal files (``file_id, name``) that are about to be stored; what broken runs left of them goes first."""
        waiting = self.table("files", tenant).filter("status = 'wait'").select(F.col("id").alias("file_id"))
        broken = waiting.join(names, "file_id", "left_semi").join(self.files(tenant), "file_id", "left_anti")
        if not broken.isEmpty():
            self.drop(tenant, names)
        self.mark(tenant, names, "wait")

    def put(self, tenant: str, name: str, tables: dict[str, DataFrame]) -> str:
        """Store a file's rows; nothing to do if it is complete."""
        if not name:
            return "ko"
        if self.file_id(tenant, name):
            return "ok"
        new = self.spark.range(1).select(self.id_of(tenant, F.lit(name)).alias("file_id"), F.lit(name).alias("name"))
        self.begin(tenant, new)
        file_id = new.head()["file_id"]
        for table, rows in tables.items():
            self.append(table, rows.withColumn("tenant", F.lit(tenant)).withColumn("file_id", F.lit(file_id)))
        self.mark(tenant, new, "ok")
        return "ok"


def insert_ignore(table: DataFrame, rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``table`` with the rows whose keys it lacks, the first of each key."""
    from lectern.operators.vector import first_in

    fresh = first_in(rows, by, [order]).join(table.select(*by), by, "left_anti")
    return table.unionByName(fresh.select(table.columns))
