"""Shared plumbing of the corpus operators: scratch tables, batches, text hashing.

Nothing here sees more than one Arrow batch of rows on a worker, and nothing
returns table-sized data to the driver.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.runtime import Tables, ship, spread

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 64


class Scratch(Tables):
    """Written tables that cut lineage.  A lost executor costs nothing that a
    table here holds, since its files lie in the shared folder."""

    def table(self, df: DataFrame) -> DataFrame:
        return self.write(df)

    def parted(self, df: DataFrame, by: str) -> DataFrame:
        """As ``table``, in a folder for each value of a column, so that a read of one value reads no other."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.partitionBy(by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS):
    """Small slices of a batch, so that few texts exist as Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def row_hash(doc_id="doc_id", text="text"):
    """Second half of a row's key: rows that agree in doc_id and text are one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def crc_remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo a number; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


#: The tables whose rows are worth more than one task, and the column that deals them out.
_KEYS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "conversations": "conv_id"}


def read(spark: SparkSession, sf_dir: str, table: str, as_stored: bool = False) -> DataFrame:
    """A table of the driver; a small one is dealt out to all cores, unless it is wanted as it is stored."""
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(found, _KEYS[table]) if table in _KEYS and not as_stored else found


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of the session stay small from here on, so
    that a worker holds few whole texts at once."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return df
