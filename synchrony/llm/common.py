"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. Python's ``bytes.split()`` gives the same words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session, where all are one
    machine, may leave it unset and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them: columns that an operator adds for a while cannot clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


#: Bits of a bitmap for each value that it holds; the least and the most bits of one (the most is 64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 29


def bitmap(values: DataFrame, most: int = MOST_BITS) -> bytes:
    """A bitmap over the low bits of a column of well-mixed longs, sized by their number: at most ``most / 32768`` rows of
    4 KB reach the driver. Beyond ``most / 32`` values it lets more others through and loses none."""
    bits = min(most, max(LEAST_BITS, 1 << (BITS_EACH * values.count()).bit_length()))
    low = values.select((F.col(values.columns[0]).bitwiseAND(bits - 1) + 1).alias("low"))
    rows = low.groupBy(F.bitmap_bucket_number("low").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("low")).alias("map"))
    out = bytearray(bits // 8)
    for r in rows.collect():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = bytes(r["map"]).ljust(4096, b"\0")
    return bytes(out)


def may_hold(bits: bytes, values: np.ndarray) -> np.ndarray:
    """Whether 64-bit values may be in a bitmap."""
    table = np.frombuffer(bits, np.uint8)
    low = (values.view(np.uint64) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (table[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0
