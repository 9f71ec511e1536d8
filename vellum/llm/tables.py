"""Intermediate tables in the folder that the cluster shares, and small session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_DIR = "/tmp/vellum-shared"
#: Whether the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes at which Spark closes an Arrow batch for Python.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir, which only a local session may lack."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or LOCAL_DIR
    return f"{base.rstrip('/')}/vellum-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. The shuffle files
    of the write are removed with it, as nothing reads them again. ``batch_bytes`` is the size at which
    a batch for Python is closed. The session's settings stay.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {FREED: "true"} | ({BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if f"/vellum-{spark.sparkContext.applicationId}/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def columns_of(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df``, as JSON those that hold maps, which have no hash."""

    def has_map(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(has_map(c.dataType) for c in kind)
        return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)

    return [F.to_json(F.struct(column(c.name).alias("c"))) if has_map(c.dataType) else column(c.name) for c in df.schema]


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column; null counts as 0."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    return F.size(words).cast("long")


def likely_ids(rows: DataFrame, ids: DataFrame, name: str = "id", most_bits: int = 1 << 26) -> DataFrame:
    """Rows whose id may be among ``ids``, decided before any shuffle; a join must follow.

    ``ids`` sets one bit by its hash in a map of at most ``most_bits`` bits, held as rows of 64.
    The map is broadcast: it has at most ``most_bits / 64`` rows however many ids there are. Where
    ids outnumber its bits it keeps more rows than it needs, never fewer.
    """
    bits = 1 << 12
    while bits < min(most_bits, 16 * ids.count()):
        bits *= 2
    place = lambda: F.pmod(F.xxhash64(name), F.lit(bits))
    word, bit = (lambda: F.shiftright(place(), 6)), (lambda: F.pmod(place(), F.lit(64)).cast("int"))
    words = ids.select(word().alias("word"), F.expr("1L").alias("one"), bit().alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("bits"))
    found = rows.withColumn("word", word()).join(F.broadcast(words), "word")
    return found.where(F.call_function("getbit", "bits", bit()) == 1).drop("word", "bits")
