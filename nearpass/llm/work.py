"""Intermediate tables in the shared folder, and small helpers the operators share."""

from __future__ import annotations

import gc
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearpass.session import run_folder

# Rows of whole texts that a Python worker holds at a time; a table of long texts needs fewer than Spark's default.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
_kept: list[Work] = []
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as `--py-files` would, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    folder = tempfile.TemporaryDirectory()  # the driver's own; Spark serves the file from here until the end
    path = Path(folder.name) / "nearpass.zip"
    path.write_bytes(data.getvalue())
    context.addPyFile(str(path))
    _shipped[context.applicationId] = folder


class Work:
    """A folder below `spark.checkpoint.dir` for the tables of one operator run.

    A saved table survives lost executors and cuts the plan.  `drop` removes a
    table that nothing reads any more; `release` removes what finished runs left.
    """

    def __init__(self, spark: SparkSession, passing: bool = True):
        ship(spark)
        spark.conf.set(*BATCH)
        self.spark, self.folder, self._n = spark, run_folder(spark), 0
        if passing:
            _kept.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self._n}"
        self._n += 1
        schema = df.schema
        df.write.parquet(path)
        del df
        gc.collect()
        self.spark._jvm.System.gc()  # lets Spark's cleaner remove the shuffle files of what has been written
        saved = self.spark.read.schema(schema).parquet(path)
        saved._work_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self.spark, table._work_path)

    def close(self) -> None:
        _delete(self.spark, self.folder)
        if self in _kept:
            _kept.remove(self)


def forget() -> None:
    """From now on `release` leaves alone what earlier runs wrote."""
    _kept.clear()


def release() -> None:
    """Remove the tables of the runs since `forget`; their results must have been written elsewhere."""
    for work in list(_kept):
        work.close()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where the table has such a column (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text alone, under names that cannot clash; a null text is empty."""
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def salted_rank(df: DataFrame, by: list[str], order: list[str], salt: Column, name: str) -> DataFrame:
    """Gapless numbers from 0 inside each group of `by`.

    A group is numbered in parts: by salt, and inside a part by `order`.  Only
    one part of a group is sorted in one task, so a hot group is shared by as
    many tasks as it has salts.
    """
    rows = df.withColumn("_salt", salt)
    parts = rows.groupBy(*by, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_salt", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*by, "_salt").orderBy(*order)
    rows = rows.withColumn("_place", F.row_number().over(inside) - 1)
    return rows.join(parts, [*by, "_salt"]).withColumn(name, F.col("_place") + F.col("_ahead")).drop(
        "_salt", "_place", "_ahead"
    )


BITS = 1 << 23


def _marked(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows and a last column: false if the key is certainly not in `others`, by a bitmap of fixed size."""
    n_place, n_word, n_bits, n_maybe = fresh(rows, "_place", "_word", "_bits", "_maybe")
    place = F.pmod(F.xxhash64(key), F.lit(BITS))
    bit = F.expr(f"shiftleft(1L, CAST({n_place} & 63L AS INT))")
    words = others.select(place.alias(n_place)).groupBy(F.shiftright(n_place, 6).alias(n_word)).agg(F.bit_or(bit).alias(n_bits))
    placed = rows.withColumn(n_place, place).withColumn(n_word, F.shiftright(n_place, 6))
    maybe = F.coalesce(F.col(n_bits).bitwiseAND(bit) != 0, F.lit(False))
    return placed.join(F.broadcast(words), n_word, "left").select(*columns_of(rows), maybe.alias(n_maybe))


def meets(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be in `others`: all that are, and few that are not.

    The bitmap (BITS places in 64-bit words, hence at most BITS / 64 rows) is
    what is broadcast, whatever the number of keys; it only spares large rows
    the shuffle of the join that follows.
    """
    marked = _marked(rows, others, key)
    return marked.filter(F.col(marked.columns[-1])).select(*columns_of(rows))


def misses(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows that `meets` leaves out: their key is certainly not in `others`."""
    marked = _marked(rows, others, key)
    return marked.filter(~F.col(marked.columns[-1])).select(*columns_of(rows))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `others`; only rows that the bitmap cannot clear are shuffled."""
    doubtful = meets(rows, others, key).join(others.select(key), key, "left_anti")
    return misses(rows, others, key).unionByName(doubtful)
