"""Where intermediate tables go, and how Python workers find this package."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; in a local session without it, a temporary one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        folder = tempfile.TemporaryDirectory(prefix="lagline-")
        _own["dir"] = "file://" + folder.name
        atexit.register(folder.cleanup)
    return _own["dir"]


def fresh(spark: SparkSession, tag: str) -> str:
    """A new folder among the application's own, all of which go when the driver's Python ends."""
    at = f"{shared_dir(spark)}/lagline/{spark.sparkContext.applicationId}"
    if at not in _made:
        _made.add(at)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        atexit.register(_remove, os.getpid(), jvm, conf, at)
    return f"{at}/{tag}-{uuid.uuid4().hex}"


def _remove(owner: int, jvm, conf, at: str) -> None:
    if os.getpid() != owner:  # a fork of the driver
        return
    with contextlib.suppress(Exception):  # the JVM may be gone already
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    at = fresh(spark, tag)
    df.write.option("compression", compression).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: For Python workers, which outlive their tasks: large arrays go back to the system when they are freed.
_FREEING = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it, and give back their memory."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    for name, value in _FREEING.items():
        env.setdefault(name, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_size(df: DataFrame) -> int:
    """Bytes of df as Spark estimates them: those of the files that it reads. Without an estimate, that of 256 MB for each of its partitions."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else df._jdf.queryExecution().toRdd().getNumPartitions() << 28


def bucket_count(df: DataFrame, mb: int = 32) -> int:
    """Buckets for what is made of df: one to each shuffle partition, and more of them if a bucket would stand for over `mb` of input as Spark estimates its size."""
    return max(partitions(df.sparkSession), min(-(-input_size(df) // (mb << 20)), 1 << 16))


#: Bits of a sieve's bitmap: at most SIEVE / 64 rows of 16 bytes are broadcast, whatever the tables hold.
SIEVE = 1 << 24


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows with __maybe: false only where the hash in key isn't one of wanted's.

    A bitmap of the wanted hashes is broadcast, so that a join or anti-join with few wanted rows needs
    to shuffle those rows, and few others, alone. The more are wanted, the less it saves; it never loses one.
    """
    word, bit = f"shiftright(`{key}` & {SIEVE - 1}, 6)", f"shiftleft(1L, cast(`{key}` & 63 as int))"
    words = wanted.groupBy(F.expr(word).alias("__word")).agg(F.bit_or(F.expr(bit)).alias("__set"))
    out = rows.withColumn("__word", F.expr(word)).join(F.broadcast(words), "__word", "left")
    return out.withColumn("__maybe", F.expr(f"coalesce(__set & {bit}, 0L) <> 0")).drop("__word", "__set")


def without(rows: DataFrame, key: str, judged: DataFrame, on: list[str]) -> DataFrame:
    """rows without those that judged (the columns of on, key, and kept) names: all of them, or, where kept, all but one of each.

    key is a hash of on; only rows that it may name are shuffled. The columns of on and key go.
    """
    judged = judged.select(*on, key, "kept")
    met = sieved(rows, key, judged)
    some = met.where("__maybe").drop("__maybe")
    rest = met.where("not __maybe").drop("__maybe")
    named = judged.select(*on, "kept")
    rest = rest.unionByName(some.join(named.drop("kept"), on, "left_anti"))
    twice = some.join(named.where("kept").drop("kept"), on, "left_semi").dropDuplicates(on)
    return rest.unionByName(twice).drop(*on, key)


def _murmur(k: int) -> int:
    """Spark's hash of an int: Murmur3 with seed 42."""
    m = 0xFFFFFFFF
    k = (k * 0xCC9E2D51) & m
    k = ((k << 15 | k >> 17) & m) * 0x1B873593 & m
    h = 42 ^ k
    h = (((h << 13 | h >> 19) & m) * 5 + 0xE6546B64) & m ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def bucket_keys(n: int) -> list[int]:
    """n int keys that Spark's hash deals to n partitions, one to each."""
    taken, keys, k = set(), [None] * n, 0
    while len(taken) < n:
        at = _murmur(k) % n
        if at not in taken:
            taken.add(at)
            keys[len(taken) - 1] = k
        k += 1
    return keys


def dealt(rows: DataFrame, bucket: str, buckets: int) -> DataFrame:
    """rows (with a bucket from 0 on) by bucket, a partition for each; few of them for many thousands. Adds key."""
    key = F.element_at(F.array(*map(F.lit, bucket_keys(buckets))), F.col(bucket) + 1) if buckets <= 4096 else F.col(bucket)
    return rows.withColumn("key", key).repartition(buckets, "key")
