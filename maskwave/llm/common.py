"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of bytes other than space and \x09-\x0D. ``bytes.split()`` cuts at the same six bytes.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
LAST_KEY = (1 << 63) - 1
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UNION = "spark.sql.unionOutputPartitioning"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch for this session: rows here are whole texts, and workers hold a batch or two each."""
    if int(spark.conf.get(BATCH)) > rows:
        spark.conf.set(BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Unions don't pass their inputs' partitioning on in this session: inputs that are merged differently at run time would
    leave rows of one key in several partitions, and what is grouped next would hold it several times."""
    text_batches(spark)
    spark.conf.set(UNION, "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_words(text: Column) -> Column:
    """Array of the words of a text; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def doc_key(doc_id: Column) -> Column:
    """doc_id as a long that is never null: rows without an id share the largest key and so come last in every order."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_KEY))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def word_hashes_128(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(len(words), 2)
    return both[:, 0], both[:, 1]


def rolling(hashes: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every run of n items, by doubling: O(log n) array passes."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    step, power, length = hashes, multiplier, 1
    out, done = None, 0
    while True:
        if n & length:
            if out is None:
                out = step[: len(hashes) - length + 1]
            else:
                m = np.uint64(pow(multiplier, length, 1 << 64))
                keep = len(hashes) - done - length + 1
                out = out[:keep] * m + step[done : done + keep]
            done += length
        if done == n:
            break
        keep = len(hashes) - 2 * length + 1
        step = step[:keep] * np.uint64(power) + step[length : length + keep]
        power = power * power % (1 << 64)
        length *= 2
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0xBF58476D1CE4E5B9)


#: A key that holds more than one in so many rows is hot; there are fewer such keys than this, whatever the table.
HOT = 1000
#: Parts that a hot key's rows are dealt into.
SALTS = 64


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: int = HOT) -> list:
    """Keys with more than one in ``share`` of all rows, from a table of counts: fewer than ``share`` values, so they may come to the driver."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > max(total / share, 2)).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list, by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join on ``key``; the left rows of hot keys are dealt into ``salts`` parts by ``by``, and the right rows of each are repeated
    for them. Nothing is dropped; without hot keys it is the plain join."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    each = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(each)), [key, "_salt"], how).drop("_salt")


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df written once to the shared folder and read again, which cuts its lineage and survives lost executors.

    The folder is spark.checkpoint.dir; only a local session that names none (tests) gets one of its own under its warehouse.
    ``instead_of``: a table written before that df replaces; its files are deleted once df is there.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this write have done their work when it ends
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if instead_of is not None:
        forget(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(table_: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and that no plan reads any more."""
    path = table_.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table_.written_to)
    path.getFileSystem(table_.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
