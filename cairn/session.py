"""Session helpers: defaults for local runs, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle: int = 8, app: str = "cairn") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where none is set.

    A temporary folder is local to the machine, so it is only taken with a local master; a
    cluster has to name a shared folder.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        set_before = sc._jsc.sc().getCheckpointDir()
        shared = set_before.get() if not set_before.isEmpty() else _local.get(sc.applicationId)
    if not shared:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local[sc.applicationId] = tempfile.mkdtemp(prefix="cairn-cut-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return shared


_local: dict[str, str] = {}
_marked: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and read it back.

    The next plan starts from files on storage that outlives executors, with their true sizes;
    a checkpoint would keep the size estimates of the old plan, which multiply in a loop of
    joins. The folder goes when the session ends.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/cairn-{spark.sparkContext.applicationId}"
    if root not in _marked:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _marked.add(root)
    out = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows, else as it is: the join then shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def refuse_large(rows: DataFrame, part: str, most: int, other: str = "") -> None:
    """ValueError if a part has more than ``most`` rows, counted where they are, before they meet in one task."""
    large = rows.groupBy(part).count().where(F.col("count") > most).limit(1).collect()
    if large:
        raise ValueError(f"{part} {large[0][0]} has {large[0][1]} rows, more than {most}{other}")


class Placed:
    """Rows placed by a key and kept; ``meet`` joins a small side with one row a key to them."""

    def __init__(self, rows: DataFrame, key: str, salts: Column | None):
        self.rows, self.key, self._salts = rows, key, salts

    def meet(self, side: DataFrame) -> DataFrame:
        """The placed rows joined with ``side`` on the key; a hot key's row goes to each of its salts."""
        if self._salts is None:
            return self.rows.join(side, self.key)
        each = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), self._salts - 1)))
        return self.rows.join(each, [self.key, "_salt"]).drop("_salt")


@contextmanager
def held(df: DataFrame, key: str, *, least: int = 5000) -> Iterator[Placed]:
    """``df`` placed by a key and kept while a loop joins it again and again.

    The large side of such a join is then shuffled once and not in every round. A key with more
    than a quarter of a partition's rows (and ``least``) is spread over salts by its row's hash,
    so no partition is much larger than the others. Such keys are at most four a partition,
    whatever the table's size, and stand in the plan. What a lost executor held is made again
    from ``df``, which should be a cut table. All uses have to be written out before the block
    ends.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    limit = max(least, df.count() // (4 * n))
    hot = df.groupBy(key).count().where(F.col("count") > limit).collect()  # at most 4 n rows, by the choice of limit
    salts, places = None, [key]
    if hot:
        table = F.create_map(*[F.lit(x) for r in hot for x in (r[key], -(-r["count"] // limit))])
        salts = F.coalesce(table[F.col(key)], F.lit(1)).cast("int")
        df, places = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), salts).cast("int")), [key, "_salt"]
    kept = df.repartition(n, *places).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Placed(kept, key, salts)
    finally:
        kept.unpersist()


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Rows of a scan over at least ``factor`` partitions a core, for work that is heavy for each byte.

    A table in fewer files than cores would leave cores idle; larger ones stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= factor * cores else df.repartition(2 * factor * cores)
