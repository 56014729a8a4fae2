"""What the training-data operators share: tables, durable intermediate results, word patterns."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names) -> list:
    """Columns of these names, whatever characters they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def words_of(text):
    """Array of a text's words; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where a local session names none, a local one is set (tests); a cluster has to
    name one, as no other executor would see what is written elsewhere."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="cborlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of a batch that goes to Python at once: several copies of one are in memory, on both sides.
BATCH_BYTES = "8m"


@contextmanager
def small_batches(spark: SparkSession, **more: str) -> Iterator[None]:
    """Within it batches to Python are small, and the shuffle files of a query go when it has ended, not when the driver
    happens to collect its garbage. more: other settings that hold within it."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **more}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Tables that may be given up once a result made of them is written.
_scratch: list[str] = []


def materialize(df: DataFrame, name: str, compression: str = "snappy", scratch: bool = True, by: tuple[str, int] | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it back: the lineage ends there, lost executors
    do not cause the work to be done again, and later reads prune columns. Removed when the driver ends, or by
    ``release`` if it is scratch. by: a column of few numbers, and how many, each of which gets a folder that ``discard``
    may remove for itself; rows are not sorted for that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cborlake-{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", compression)
    if by:
        out = out.partitionBy(by[0]).option("parquet.block.size", 16 << 20)  # all folders are written beside each other
    with small_batches(spark, **{"spark.sql.maxConcurrentOutputFileWriters": str(by[1])} if by else {}):
        out.parquet(path)
    atexit.register(_remove, spark, path)
    if scratch:
        _scratch.append(path)
    return spark.read.schema(T._parse_datatype_json_string(df.schema.json())).parquet(path)


def release(docs: DataFrame) -> None:
    """Remove the scratch tables made so far, but for those that docs reads from. For steps that follow each other, when
    the result of the one before has been written."""
    used = " ".join(docs.inputFiles())
    for path in [p for p in _scratch if p.rsplit("/", 1)[1] not in used]:
        _scratch.remove(path)
        _remove(docs.sparkSession, path)


def discard(df: DataFrame, part: str = "") -> None:
    """Remove a table made by ``materialize`` that nothing reads any more, or one folder of it (column=number)."""
    folders = {f.rsplit("/", 1)[0] + "/" for f in df.inputFiles()}
    for path in [p for p in _scratch if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in folders)]:
        if not part:
            _scratch.remove(path)
        _remove(df.sparkSession, f"{path}/{part}" if part else path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    try:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone when the interpreter ends
        return


#: What a Python worker keeps from task to task, by owner and name.
_kept: dict[tuple[str, str], object] = {}


def kept(owner: str, name: str, make: Callable):
    if (owner, name) not in _kept:
        _kept[owner, name] = make()
    return _kept[owner, name]


def frugal(owner: str, f: Callable) -> Callable:
    """f, batches to batches, in a worker that Spark uses again and again: what it keeps for other owners goes before, and
    memory that is free goes back to the system afterwards, where an idle worker would hold it beside a busy one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in [k for k in _kept if k[0] != owner]:
            del _kept[key]
        _trim()
        try:
            yield from f(batches)
        finally:
            _trim()

    return run


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
