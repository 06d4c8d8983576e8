"""Readers, writers and worklists of files (group A)."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MEDIA = ("jpg", "jpeg", "png", "raw", "dng")


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the wanted columns, absent ones as nulls of their type."""
    return df.select(*[F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in wanted.items()])


def media_paths(files: DataFrame, suffixes: tuple[str, ...] = MEDIA, column: str = "path") -> DataFrame:
    """The files of these suffixes, each path once after its ``.`` and empty parts are resolved."""
    resolved = F.regexp_replace(F.regexp_replace(column, r"(?<=/)(?:\./|/)+", ""), r"^(?:\./)+", "")
    held = files.withColumn(column, resolved)
    return held.where(F.lower(F.regexp_extract(column, r"\.([^./]+)$", 1)).isin(*suffixes)).dropDuplicates([column])


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = MEDIA) -> DataFrame:
    """Paths below a folder by suffix, without their content; each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    return media_paths(files, suffixes)


def without_paired_raw(files: DataFrame, column: str = "file", raw: tuple[str, ...] = ("raw", "dng"), developed: tuple[str, ...] = ("jpg", "jpeg")) -> DataFrame:
    """Drops a raw file where a developed one has the same stem."""
    stem, suffix = F.regexp_extract(column, r"^(.*)\.", 1), F.lower(F.regexp_extract(column, r"\.([^./]+)$", 1))
    marked = files.withColumn("_stem", stem).withColumn("_raw", suffix.isin(*raw))
    done = files.select(stem.alias("_stem"), F.lit(True).alias("_raw"), suffix.alias("_s")).where(F.col("_s").isin(*developed)).drop("_s")
    return marked.join(done, ["_stem", "_raw"], "left_anti").drop("_stem", "_raw")


def map_by_prefix(df: DataFrame, column: str, targets: dict[str, str]) -> DataFrame:
    """``target`` of the longest prefix that fits; the map is a small configuration."""
    pairs = sorted(targets.items(), key=lambda p: len(p[0]))
    out = F.lit(None).cast("string")
    for prefix, target in pairs:
        out = F.when(F.col(column).startswith(prefix), target).otherwise(out)
    return df.withColumn("target", out).where("target is not null")


METADATA = "SourceFile string, DateTimeOriginal string, CreateDate string, ISO double, FNumber double, ExposureTime string"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A dump of metadata, one JSON object a line; creation time where the original is missing, non-finite numbers as null."""
    return parse_metadata(spark.read.text(path))


def parse_metadata(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of the metadata in a column of JSON texts; a text that isn't JSON gives nulls."""
    raw = lines.select(F.from_json(column, METADATA).alias("m")).select("m.*")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return raw.select(F.col("SourceFile").alias("path"), F.coalesce("DateTimeOriginal", "CreateDate").alias("taken"), finite("ISO").alias("iso"), finite("FNumber").alias("f_stop"), F.col("ExposureTime").alias("shutter"))


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark votes: an index, an image id, ten counts, and tags; to a mean mark of 1 to 10 and a score of 0 to 10."""
    raw = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").cast("array<bigint>").alias("f"))
    counts = F.slice("f", 3, 10)
    n = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
    s = F.aggregate(F.transform(counts, lambda c, i: c * (i + 1)), F.lit(0).cast("bigint"), lambda a, c: a + c)
    return raw.where(F.size("f") >= 12).select(F.col("f")[1].alias("image"), F.try_divide(s.cast("double"), n).alias("mos"), (F.try_divide(s.cast("double"), n) - 1).alias("m")).select("image", "mos", (F.col("m") / 9 * 10).alias("score"))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """XML sidecars: rating, label, keywords and date, by path expressions."""
    return parse_sidecars(spark.read.option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("x")))


def sidecar_fields(xml: str | None) -> tuple[str | None, str | None, list[str] | None, str | None]:
    """Rating, label, keywords and date of a text in one parse: the first text node of an element of the name, whatever its namespace, and all those of list items below a subject."""
    if not xml:
        return None, None, None, None
    first, words, open_, held = {"Rating": "", "Label": "", "MetadataDate": ""}, [], [], []
    seen = set()

    def flush(*_) -> None:
        if not held:
            return
        text = "".join(held)
        held.clear()
        name = open_[-1]
        if name in first and name not in seen:
            seen.add(name)
            first[name] = text
        elif name == "li" and "subject" in open_[:-1]:
            words.append(text)

    def start(name: str, _) -> None:
        flush()
        open_.append(name.rpartition("\x01")[2])

    def end(_) -> None:
        flush()
        open_.pop()

    parser = expat.ParserCreate("utf-8", "\x01")  # a sign that no namespace can hold
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = flush
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError as wrong:
        raise ValueError(f"Invalid XML document: {wrong}") from wrong
    return first["Rating"], first["Label"], words, first["MetadataDate"]


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """Rows ``path, rating, label, keywords, dated`` from ``path`` and the XML text ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rating, label, keywords, dated = zip(*map(sidecar_fields, batch.column("x").to_pylist()), strict=True) if batch.num_rows else ((), (), (), ())
            arrays = [pa.array(rating, pa.string()), pa.array(label, pa.string()), pa.array(keywords, pa.list_(pa.string())), pa.array(dated, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *arrays], names=["path", "rating", "label", "keywords", "dated"])

    kept = texts.select("path", F.col("x").cast("string").alias("x"))
    kind = kept.schema["path"].dataType.simpleString()
    found = kept.mapInArrow(run, f"path {kind}, rating string, label string, keywords array<string>, dated string")
    return found.select("path", F.col("rating").try_cast("int").alias("rating"), F.nullif("label", F.lit("")).alias("label"), "keywords", F.nullif("dated", F.lit("")).alias("dated"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
