"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Every fifth document by this rule is held out; no model learns from it.
FOLDS = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What an Arrow batch may hold, in the JVM and in Python: texts are of any length, so bytes bound a batch and not rows.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per Spark application, wherever the driver found it; and bound the session's
    Arrow batches by BATCH_BYTES, where they are not bound closer."""
    small = "spark.sql.execution.arrow.maxBytesPerBatch"
    sc = spark.sparkContext
    if sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(small)) > BATCH_BYTES:
        spark.conf.set(small, f"{BATCH_BYTES}b")
    if getattr(sc, "_ledgerlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerlens_"), "ledgerlens_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    sc._ledgerlens_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names. Where none is named, a temporary one stands in on a local master
    only; a cluster's executors would not see it, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerlens_ckpt_")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


MARK_BITS = 23


def _mark(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << MARK_BITS))


def marks(ids: DataFrame, column: str) -> DataFrame:
    """(word, bits): a bitmap of 2**MARK_BITS hashed ids, as at most 2**(MARK_BITS - 6) rows whatever the input."""
    words = ids.select(_mark(column).alias("m")).selectExpr("shiftright(m, 6) AS word", "shiftleft(1L, int(m & 63)) AS bit")
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def with_mark(df: DataFrame, column: str, words: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: whether the id may be one of those marked (true for each that is, false for a null).
    The bitmap is broadcast; marks() bounds its rows. It only saves work, so rows it passes need an exact join."""
    m = _mark(column)
    slots = words.select(F.col("word").alias(f"{name}_word"), F.col("bits").alias(f"{name}_bits"))
    joined = df.join(F.broadcast(slots), F.shiftright(m, 6) == F.col(f"{name}_word"), "left")
    hit = F.col(column).isNotNull() & F.coalesce(F.getbit(f"{name}_bits", m.bitwiseAND(F.lit(63))) == 1, F.lit(False))
    return joined.withColumn(name, hit).drop(f"{name}_word", f"{name}_bits")


def without_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is not in ids(column), a written table; rows without an id stay. Only rows that the
    bitmap of ids does not clear are shuffled."""
    may = free_name(df, "may")
    known = with_mark(df, column, marks(ids, column), may)
    names = [F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns]
    kept = known.where(F.col(may)).join(ids.select(column).distinct(), column, "left_anti")
    return known.where(~F.col(may)).select(*names).unionByName(kept.select(*names))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as keep it and its derivatives apart from df's columns."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name


def lean() -> None:
    """At the beginning of a task: Arrow takes memory from the system's allocator, so that what it frees can be given back."""
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """At the end of a task: what Python and Arrow have freed goes back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(column: str = "doc_id"):
    """crc32(doc_id as text) mod 5 = 0; a null id is not held out, and nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(False))


def learnable(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % FOLDS != 0


def slices(b: pa.RecordBatch, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes, so that what Python holds of it at once stays small."""
    rows = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
    for a in range(0, b.num_rows, rows):
        yield b.slice(a, rows)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """mapInArrow with a factory: make() runs once per task, its result maps a RecordBatch
    to a list of column values (or None for no rows). Batches are worked through in slices."""
    ship(df.sparkSession)
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        f = make()
        try:
            for whole in batches:
                for b in slices(whole):
                    cols = f(b)
                    if cols is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(cols, arrow)], schema=arrow)
        finally:  # also where the task fails, or nobody reads on
            del f
            give_back()

    return df.mapInArrow(run, struct)


def map_rows(df: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """map_batches() to rows of the same columns, whatever their names hold: columns travel by position."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return map_batches(plain, ", ".join(f"{c} {t}" for c, t in plain.dtypes), make).toDF(*df.columns)


def text_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label): at most `rows` labelled rows, chosen by a hash of the id from those that
    may be learned from; of an id with several rows its least text. The ids chosen are broadcast; `rows` bounds them."""
    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & learnable())
    ids = named.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").where(learnable()).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
