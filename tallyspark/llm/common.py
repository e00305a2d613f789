"""Helpers that the corpus operators share: durable intermediates and a bounded row filter."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a row filter: 1 MiB at least and 8 MiB at most, in blocks of 4 KiB, are broadcast.
FILTER_BITS, MOST_FILTER_BITS = 1 << 23, 1 << 26


#: Rows and bytes that go to a Python worker at once while an intermediate table is written.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 23}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and driver and executors are one process
    (tests, notebooks) a folder of our own is made and put in the session. A cluster without the setting is an error:
    executors that wrote to their own disks would lose rows.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
        pass


@contextlib.contextmanager
def _short_batches(spark: SparkSession):
    """Rows go to Python workers a few at a time: whole texts are large, and the buffers of a batch stay with the task."""
    held = {k: spark.conf.get(k) for k in BATCHES}
    try:
        for k, most in BATCHES.items():
            spark.conf.set(k, str(most))
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The table is removed when the interpreter ends, or earlier by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _short_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    atexit.register(_remove_quietly, spark, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that no later plan reads."""
    for t in tables:
        if getattr(t, "_stored_at", None):
            remove(t.sparkSession, t._stored_at)


def slices(batches, rows: int = 256):
    """Arrow batches in short slices, so that only a slice's texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(*taken: DataFrame):
    """A maker of column names that none of the tables has, in any case of letters."""
    used = {c.lower() for t in taken for c in t.columns}

    def name(wanted: str) -> str:
        out, n = wanted, 0
        while out.lower() in used:
            n += 1
            out = f"{wanted}_{n}"
        used.add(out.lower())
        return out

    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + F.lit(1)


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: eight a key, within the bounds."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (8 * keys - 1).bit_length() if keys else 0))


def marked_rows(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, keys: int = 0) -> tuple[DataFrame, str]:
    """``df`` with a column (its name is returned): whether the key may be among ``wanted`` (never false for one that is; null for null keys)."""
    name, bits = fresh(df, wanted), filter_bits(keys)
    bucket, held, at, hit = (name(x) for x in ("bucket", "bits", "at", "hit"))
    pos = wanted.where(F.col(wanted_key).isNotNull()).select(_position(F.col(wanted_key), bits).alias("pos"))
    bitmap = pos.groupBy(F.bitmap_bucket_number("pos").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias(held))
    place = _position(F.col(key), bits)
    byte = F.conv(F.hex(F.expr(f"substring({held}, cast({at} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2.0), F.pmod(F.col(at), F.lit(8)))).cast("int") % 2 == 1
    joined = df.withColumns({bucket: F.bitmap_bucket_number(place), at: F.bitmap_bit_position(place)}).join(F.broadcast(bitmap), bucket, "left")
    return joined.withColumn(hit, F.when(F.col(key).isNotNull(), F.coalesce(bit, F.lit(False)))).select(*columns(df), hit), hit


def probable_rows(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, keys: int = 0) -> DataFrame:
    """The rows of ``df`` whose key may be among ``wanted``: none of these is lost, some others stay.

    A bitmap is broadcast, of a bounded size whatever the input's (keys: how many keys are wanted, if that is
    known), so that the exact join that follows shuffles little. Null keys go.
    """
    marked, hit = marked_rows(df, key, wanted, wanted_key, keys)
    return marked.where(F.col(hit)).drop(hit)


def without(df: DataFrame, key: str, gone: DataFrame, gone_key: str, same, keys: int = 0) -> DataFrame:
    """The rows of ``df`` that no row of ``gone`` matches by the condition ``same``, which includes equal keys.

    Rows that the bitmap rules out stay where they are; only the others are shuffled to be joined. ``gone`` and
    ``df`` have no column name in common.
    """
    marked, hit = marked_rows(df, key, gone, gone_key, keys)
    stay = marked.where(~F.col(hit)).drop(hit)
    open_rows = marked.where(F.col(hit).isNull() | F.col(hit)).drop(hit)
    return stay.unionByName(open_rows.join(gone, same, "left_anti"))
