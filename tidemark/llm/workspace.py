"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on a local master that has none, a folder of our own.

    On a cluster executors do not share the driver's disk, so there the setting must be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Removes a query's shuffle files when it ends: a written table needs none of those it came from.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Names, writes, rereads and removes intermediate tables of one query.

    A written table outlives the loss of executors and keeps later steps from
    running earlier ones again.  What is left at exit of the driver is removed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n, self._held = 0, set()
        atexit.register(self._quiet_drop)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN)
            else:
                self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        self._held.add(path)
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Remove tables that nothing reads any more."""
        for t in tables:
            path = t if isinstance(t, str) else t._tidemark_path
            self._held.discard(path)
            self._delete(path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Remove all tables but these, which the result reads."""
        self.drop(*(self._held - {t._tidemark_path for t in tables}))

    def release(self) -> None:
        """Let go of what ended steps hold on the driver.

        Spark frees broadcasts and shuffles when the driver's collector finds them
        unreferenced; until then its heap grows, and it does not shrink by itself.
        Python's collector goes first: plans in its cycles are referenced.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _quiet_drop(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the gateway may be gone at exit
            pass


#: Most rows that ``lookup`` broadcasts: keys that hold over 1 in HOT_SHARE of all rows, so fewer than this.
HOT_SHARE = 2000
#: Rows up to which ``lookup`` may broadcast all keys of a table of a few numbers each (about 2 MB).
WHOLE = 32_768


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, spread: str, share: int = HOT_SHARE, whole: int = 0) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per ``key``, with its number of rows ``count``).

    Keys with more than ``total / share`` rows are under ``share`` in number and
    are broadcast; their rows are dealt by ``spread`` through the shuffle that joins
    all other keys, so that no task gets a whole hot group.  Null keys find nothing
    and are dealt by ``spread`` too.  ``table``'s columns other than the key arrive
    under their names (null where nothing is found).

    Where there are at most ``whole`` rows, so no more keys, all keys are broadcast:
    one join, no shuffle.  A plan of two for each small step fills the driver.
    """
    from pyspark.sql import functions as F

    values = [c for c in table.columns if c not in (key, count)]
    limit = max(1, total // share)
    pack = F.struct(*[F.col(c) for c in values])
    if total <= whole:
        all_keys = table.select(F.col(key).alias("__hk"), pack.alias("__hv"))
        out = rows.join(F.broadcast(all_keys), F.col(key) == F.col("__hk"), "left")
        return out.select(*rows.columns, *[F.col("__hv")[c].alias(c) for c in values])
    hot = table.filter(F.col(count) > limit).select(F.col(key).alias("__hk"), pack.alias("__hv"))
    cold = table.filter(F.col(count) <= limit).select(F.col(key).cast("string").alias("__ck"), pack.alias("__cv"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    dealt = F.when(F.col("__hk").isNotNull() | F.col(key).isNull(), F.concat(F.lit("\x00"), F.xxhash64(spread).cast("string")))
    out = out.withColumn("__jk", F.coalesce(dealt, F.col(key).cast("string"))).join(cold, F.col("__jk") == F.col("__ck"), "left")
    found = F.coalesce("__hv", "__cv")
    return out.select(*rows.columns, *[found[c].alias(c) for c in values])
