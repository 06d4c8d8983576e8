"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.runtime import shuffle_width, stash


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, nulls as None."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece has at most ``rows`` rows and about ``limit`` bytes."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, limit // per_row))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class Numbers(dict):
    """Words by number; a word that is asked for first gets the next number and is listed as fresh."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, word) -> int:
        found = self[word] = len(self)
        self.fresh.append(word)
        return found

    def taken(self) -> list:
        """The fresh words, which are none from then on."""
        out, self.fresh = self.fresh, []
        return out


def making_room(docs: DataFrame, added: str, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with other names for columns that clash, and each column's name there.

    A column that has the name of an added one, whatever the case, or begins with the reserved prefix comes back as ``in_``
    and its name, so nothing is overwritten.
    """
    taken = {a.lower() for a in added.split()}
    names: dict[str, str] = {}
    for name in docs.columns:
        new = name
        while new.lower() in taken or new.lower().startswith(prefix):
            new = f"in_{new}"
        taken.add(new.lower())
        names[name] = new
    return docs.toDF(*names.values()), names


#: Rows of a table that is broadcast; all such tables here have two short columns at most.
SMALL_ROWS = 1_000_000


def if_small(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if a count shows that it is small."""
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table


#: Rows of one key that a task takes in any case.
FEW_ROWS = 500


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with more rows than an even task's share, with ``_parts``: the places to deal them to; None if there are none.

    At most four times as many keys as shuffle partitions can be hot, whatever the input.
    """
    bound = max(FEW_ROWS, rows.count() // (4 * shuffle_width(rows.sparkSession)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > bound)
    hot = stash(counts.select(*keys, F.ceil(F.col("_n") / bound).cast("int").alias("_parts")))
    return None if hot.isEmpty() else hot


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with a ``lookup`` of one row a key, whose other columns' names are new.

    The rows of ``hot_keys``, found by some or all of ``keys``, are dealt to several places, where their lookup rows are repeated. Null keys find nothing.
    """
    if hot is None:
        return rows.join(lookup, keys, how)
    known = [c for c in hot.columns if c != "_parts"]
    # a row's place depends on its content alone, so that a task that runs again deals it alike
    place = F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("_parts")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), known, "left").withColumn("_part", place).drop("_parts")
    spread = lookup.join(F.broadcast(hot), known, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(spread, [*keys, "_part"], how).drop("_part")


def ascii_lower(column):
    """Lower-case A-Z only, whatever the locale or script."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))
