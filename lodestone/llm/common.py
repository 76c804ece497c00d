"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the contracts define words: space, tab, LF, VT, FF, CR.
ASCII_SPACE = " \t\n\x0b\x0c\r"


_slot: dict = {}


def worker_cached(key: tuple, make):
    """The value that make() gives for key, kept from task to task in this process. One value is kept: another operator's takes its place, so tables don't pile up in a worker."""
    if key not in _slot:
        _slot.clear()
        release_memory()
        _slot[key] = make()
    return _slot[key]


def release_memory() -> None:
    """Give freed memory back to the system, where it has the means."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound what goes to a Python worker at once, so long texts don't add up. Lower settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tasks_for(df: DataFrame, bytes_each: int = 16_000_000) -> int:
    """Tasks for an exchange of df: the session's number of partitions, or more where the optimizer's estimate of df's size asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = 0 if size >= 2**60 else size  # the estimate of plans of unknown size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // bytes_each))


def squeezed(df: DataFrame, column: str) -> DataFrame:
    """df with a text column as zstd bytes (null stays null), for an exchange: a text's bytes are about half as many as in the shuffle's own compression."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in df.schema.fields])

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in batches:
            at = batch.schema.get_field_index(column)
            small = pa.array([None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, schema)


def unsqueezed(values: list) -> list:
    """The texts of squeezed values."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return [None if v is None else open_(v).decode("utf-8", "surrogatepass") for v in values]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see. Where it is unset, a temporary one on a local master; on a cluster executors would not see it, so that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def fold(df: DataFrame, *open_: str) -> DataFrame:
    """df with all columns but the open ones in a struct named row, so an operator's new columns can't clash with them."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in open_]
    return df.select(F.struct(*rest, F.lit(0).alias("_")).alias("row"), *open_)


def unfold(df: DataFrame, columns: list[str], *open_: str) -> DataFrame:
    return df.select(*[F.col(c) if c in open_ else F.col("row").getField(c).alias(c) for c in columns])
