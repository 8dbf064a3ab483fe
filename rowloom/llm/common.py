"""Pieces that several operators share: words, shared storage, plans that read a table once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACES_RE)).otherwise(F.array().cast("array<string>"))


def line_words(line: Column) -> Column:
    """words() of a text without line feeds, by a plain split at spaces."""
    plain = F.when(line.rlike(r"[\t\x0B\f\r]"), F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)
    return F.array_remove(F.split(plain, " "), "")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, in any spelling."""
    taken, mark = {c.lower() for c in df.columns}, "rowloom"
    while any(f"{mark}_{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}_{n}" for n in names]


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session that names none gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="rowloom-")
    return f"file://{_own['dir']}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended already; its folder goes with the cluster's own clean-up
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder once and read it back: later steps neither repeat its work nor depend on
    an executor that may be lost. Its files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rowloom_path = path
    return out


def removed(table: DataFrame) -> None:
    """Delete a written table early. Whatever was made of it must be written itself, so that no lost task asks for it."""
    _remove(table.sparkSession, table.rowloom_path)


def parts(rows: int, each: int) -> int:
    """How many pieces of about `each` rows hold `rows` rows."""
    return max(1, -(-rows // each))


#: Bits of a bitmap. It has BITMAP_BITS / 64 rows of 16 bytes at most, whatever the input, so it may be broadcast.
BITMAP_BITS = 1 << 24


def _bit(hash_col: Column) -> tuple[Column, Column]:
    place = F.pmod(hash_col, F.lit(BITMAP_BITS))
    return F.floor(place / 64).cast("long"), (place % 64).cast("int")


def bitmap(hashes: DataFrame) -> DataFrame:
    """Mark the 64-bit hashes of a one-column frame in a bitmap of fixed size. It only ever spares work: what it
    lets through is joined exactly afterwards, and a full bitmap lets everything through."""
    word, bit = _bit(F.col(f"`{hashes.columns[0]}`"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return written(hashes.select(word.alias("rowloom_word"), one.alias("one")).groupBy("rowloom_word").agg(F.bit_or("one").alias("rowloom_bits")), "bitmap")


def flagged(df: DataFrame, marks: DataFrame, hash_col: Column, name: str) -> DataFrame:
    """df with a boolean column: whether its hash may have been marked."""
    word, bit = _bit(hash_col)
    w, b, at, bits = fresh_names(df, "w", "b", "word", "bits")
    marks = F.broadcast(marks.toDF(at, bits))  # BITMAP_BITS / 64 rows at most
    out = df.withColumns({w: word, b: bit}).join(marks, F.col(w) == F.col(at), "left")
    return out.withColumn(name, F.coalesce(F.getbit(bits, F.col(b)) == 1, F.lit(False))).drop(w, b, at, bits)


def let_through(df: DataFrame, marks: DataFrame, hash_col: Column) -> DataFrame:
    (flag,) = fresh_names(df, "flag")
    return flagged(df, marks, hash_col, flag).where(flag).drop(flag)
