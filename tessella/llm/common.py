"""Helpers shared by the training-data operators: shared storage, tokens, ranks."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch of texts.
BATCH = "4m"
#: Bytes of a row group of a stored table: what a task that writes one holds in memory.
ROW_GROUP = 16 << 20
MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) is a temporary
    folder made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{_run_folder(shared_dir(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@functools.cache
def _run_folder(shared: str, app: str) -> str:
    """This application's folder under the shared one; it is removed when Python ends."""
    from pyspark import SparkContext

    folder = f"{shared.rstrip('/')}/tessella-{app}"
    sc = SparkContext._active_spark_context
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM is gone; what is left lies in the checkpoint folder
            pass

    atexit.register(remove)
    return folder


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands texts to Python in batches of BATCH bytes: bounds both sides' memory.

    The setting is the session's, as Spark has none for a single table. One that the user has made stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, BATCH)
    return df


def release() -> None:
    """Give memory that a task used back to the system: workers live on, and the next stage's needs come on top."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: str = "text") -> Column:
    """The text's UTF-8 bytes, null as empty: Python gets bytes and never decodes what it needn't."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


#: Bits of a field over keys, for each key, and at least and at most: bounds what is collected and broadcast.
KEY_SHARE, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 27


def bit_field(keys: DataFrame, name: str) -> np.ndarray:
    """A field of bits (a power of two), set where a key (long) of ``keys`` falls."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_SHARE * keys.count()).bit_length()))
    slots = keys.select(F.pmod(name, F.lit(size)).cast("int").alias("slot"))
    bits = slots.groupBy(F.expr("slot div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 32)")).alias("b"))
    got = bits.toArrow()  # size / 32 narrow rows at most
    field = np.zeros(size // 32, np.uint32)
    field[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return field


def hits(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the field."""
    s = np.mod(keys, 32 * len(field))
    return ((field[s >> 5] >> (s & 31).astype(np.uint32)) & 1).astype(bool)


def in_field(df: DataFrame, name: str, field: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose key may be in the field: others are dropped before they are shuffled for a join that drops them anyway.

    Not ``inside``: the rows whose key surely isn't.
    """
    import pyarrow as pa

    held = df.sparkSession.sparkContext.broadcast(field)

    def run(batches):  # noqa: ANN001, ANN202
        f = held.value
        for b in batches:
            yield b.filter(pa.array(hits(f, b.column(b.schema.names.index(name)).to_numpy()) == inside))

    return small_batches(df).mapInArrow(run, df.schema)


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """Range-sort ``df`` by ``order`` and store it with ``pid`` and ``idx``, its place in partition ``pid``.

    ``order`` must end with columns that split ties, else one repeated value fills one partition.
    """
    spark = df.sparkSession
    n = shuffle_parts(spark)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(ranged.select("*", F.spark_partition_id().alias("pid"), low.alias("idx")), "placed")


def with_rank(rows: DataFrame) -> DataFrame:
    """``placed`` rows with ``rank``, the place in the whole order, from 0."""
    from pyspark.sql import Window

    runs = rows.groupBy("pid").agg(F.count("*").alias("n"))
    before = runs.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))  # one row a partition
    return rows.join(F.broadcast(before), "pid").withColumn("rank", (F.col("before") + F.col("idx")).cast("long")).drop("before")


def slices(texts, most: int):  # noqa: ANN001, ANN201
    """Runs (Arrow array, places) of texts (Arrow binary) of about ``most`` bytes with the place of each; a longer text comes in parts, cut at ASCII blanks."""
    import pyarrow as pa

    rows, places, size = [], [], 0
    for i, x in enumerate(texts):
        raw, at = x.as_buffer() or b"", 0
        n = len(raw)
        while True:
            end = n
            if n - at > most:
                piece = bytes(raw[at : at + most])
                cut = max(piece.rfind(b" "), piece.rfind(b"\n"))
                while cut < 0 and len(piece) < n - at:  # no blank: on to the next one
                    piece = bytes(raw[at : at + 2 * len(piece)])
                    cut = max(piece.find(b" ", most), piece.find(b"\n", most))
                end = at + cut + 1 if cut >= 0 else n
            rows.append(bytes(raw[at:end]) if at or end < n else x.as_py())
            places.append(i)
            size += end - at
            if size >= most:
                yield pa.array(rows, pa.binary()), places
                rows, places, size = [], [], 0
            at = end
            if at >= n:
                break
    if rows:
        yield pa.array(rows, pa.binary()), places


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words make one shingle; none, an empty set."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    w = min(n, width)
    s = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : n - w + 1 + i]
        s ^= s >> np.uint64(29)
    return np.unique(mix64(s))
