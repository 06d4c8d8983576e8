"""Substring deduplication by paragraph hashing.

A unit is a paragraph of ``PARAGRAPH`` words; words are runs without white space, lower-cased
A-Z, so units are normal in case and white space. Whole lines or sentences as units miss
passages that begin inside them, so units begin at words that their neighbourhood chooses:
the word of least MD5 digest, the last of equals, in each run of ``REACH`` words. Copies of a
passage choose alike, wherever it stands. As ``PARAGRAPH + REACH - 1`` is 51, each passage of
more than 50 words holds a whole unit, and all but ``REACH - 1`` words at most at both its ends
lie in units of its own.

Equal units form a global group whose earliest occurrence, by document id, then row order and
place, stays. All other occurrences are removed with the white space after them, and their
original offsets (code points, the end exclusive) are kept.

Defined results: a null text stays null and has no words; repeated rows repeat their units, so
the first row keeps them; a text may become empty; an occurrence that overlaps the earliest one
in the same row goes from the end of that on; texts of fewer words than a unit stay. An empty
table gives an empty result. Null ids rank last. A column named ``removed``, or whose name begins with
``_line``, comes back as ``in_`` and its name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.common import Numbers, making_room, slices, utf8
from shelfmark.runtime import shuffle_width, stash

PARAGRAPH, REACH = 42, 10
HELD_WORDS = 300_000
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Odd multipliers of the rolling hashes, and their inverses modulo 2**64.
_TURNS = [(m, pow(m, -1, 1 << 64)) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


class Hashes:
    """Rolling hashes of runs of words; the powers of the multipliers are kept."""

    def __init__(self):
        self.powers = [tuple(np.ones(1, np.uint64) for _ in turn) for turn in _TURNS]

    def rolled(self, hashes: np.ndarray, starts: np.ndarray, paragraph: int) -> list[np.ndarray]:
        """For each multiplier, a 64-bit hash of the ``paragraph`` words from each start."""
        if len(self.powers[0][0]) < len(hashes):
            self.powers = [tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(hashes), m, np.uint64)])) for m in turn) for turn in _TURNS]
        out = []
        for ups, downs in self.powers:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * ups[: len(hashes)])])
            out.append((sums[starts + paragraph] - sums[starts]) * downs[starts])
        return out


def unit_starts(keys: np.ndarray, lengths: np.ndarray, paragraph: int, reach: int) -> np.ndarray:
    """The places that begin a unit, of texts that stand one after another; ``keys`` are their words' digests, ``lengths`` their counts of words.

    The lower bits of a key give way to its place, so that the last of equal words is the least one.
    """
    low = np.uint64((1 << 24) - 1)
    at = np.arange(len(keys), dtype=np.uint64)
    least, width = (keys & ~low) | (low - (at & low)), 1
    while width < reach and len(least):
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    first = np.arange(len(least))
    chosen = first + ((low - (least & low) - first.astype(np.uint64)) & low).astype(np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    chosen = chosen[first + reach <= ends[: len(first)]]  # runs within one text
    chosen = chosen[np.diff(chosen, prepend=-1) != 0]
    return chosen[chosen + paragraph <= ends[chosen]]


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paragraph: int = PARAGRAPH, reach: int = REACH) -> DataFrame:
    """Rows ``row, doc_id, at, d, c`` of the units of rows numbered ``_line_row``: the first word, and the digest in two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number, rolling = Numbers(), Hashes()
        keys, hashes = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in slices(batches):
            if len(number) > HELD_WORDS:
                number = Numbers()
                keys, hashes = keys[:0], hashes[:0]
            split = [t.lower().split() if t else [] for t in utf8(batch.column(2))]
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            own = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, lengths.sum())
            fresh = number.taken()
            keys = np.concatenate([keys, np.frombuffer(b"".join(hashlib.md5(w).digest()[:8] for w in fresh), ">u8").astype(np.uint64)])
            hashes = np.concatenate([hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))])
            starts = unit_starts(keys[own], lengths, paragraph, reach)
            d, c = rolling.rolled(hashes[own], starts, paragraph)
            begins = np.cumsum(lengths) - lengths
            of = np.searchsorted(begins + lengths, starts, side="right")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array((starts - begins[of]).astype(np.int32)), pa.array(d.view(np.int64)), pa.array((c >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                names=["row", "doc_id", "at", "d", "c"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col("_line_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"row long, doc_id {kind}, at int, d long, c int")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paragraph: int = PARAGRAPH, reach: int = REACH) -> DataFrame:
    """Rows ``row, gone``: the runs of words ``begin, end`` to remove, sorted by their begins."""
    every = units(docs, id_col, text_col, paragraph, reach)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    groups = stash(every.groupBy("d", "c").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "c", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"), "n"))
    # the rows of a hot digest are dealt to several places; at most ``most`` digests are hot, whatever the input
    most = 4 * shuffle_width(docs.sparkSession)
    bound = max(1, (groups.agg(F.sum("n")).first()[0] or 0) // most)
    parts = groups.withColumn("parts", F.ceil(F.col("n") / bound).cast("int"))
    hot = F.broadcast(parts.where("parts > 1").select(F.col("d").alias("_d"), F.col("c").alias("_c"), "parts"))
    dealt = every.join(hot, (F.col("d") == F.col("_d")) & (F.col("c") == F.col("_c")), "left").select("row", "at", "d", "c", F.coalesce(F.pmod(F.xxhash64("row", "at"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
    firsts = parts.select("d", "c", "first_row", "first_at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    later = dealt.join(firsts, ["d", "c", "part"]).where("first_row <> row or first_at <> at")
    begin = F.when(F.col("first_row") == F.col("row"), F.greatest("at", F.col("first_at") + paragraph)).otherwise(F.col("at"))
    return later.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(begin.alias("begin"), (F.col("at") + paragraph).alias("end")))).alias("gone"))


def _cut(text: str, gone: list[dict[str, int]]) -> tuple[str, list[dict[str, int]]]:
    """The text without these runs of words, and the runs' offsets."""
    places = [m.start() for m in WORD.finditer(text)]
    spans: list[dict[str, int]] = []
    for run in gone:
        start, end = places[run["begin"]], places[run["end"]] if run["end"] < len(places) else len(text)
        if spans and start <= spans[-1]["end"]:
            spans[-1]["end"] = max(end, spans[-1]["end"])
        else:
            spans.append({"start": start, "end": end})
    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), spans


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paragraph: int = PARAGRAPH, reach: int = REACH) -> DataFrame:
    """``docs`` with the cleaned text and ``removed``: an array of (start, end) in the original text."""
    docs, own = making_room(docs, "removed", "_line")
    id_col, text_col = own[id_col], own[text_col]
    numbered = stash(docs.withColumn("_line_row", F.monotonically_increasing_id()))
    gone = repeated(numbered, id_col, text_col, paragraph, reach).withColumnsRenamed({"row": "_line_row", "gone": "_line_gone"})
    joined = numbered.join(gone, "_line_row", "left").select(*docs.columns, "_line_gone")
    at, names = docs.columns.index(text_col), [*docs.columns, "removed"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns, runs = batch.columns[:-1], batch.column(len(names) - 1)
            asked = runs.is_valid()
            done = [_cut(t, r) for t, r in zip(columns[at].filter(asked).to_pylist(), runs.filter(asked).to_pylist(), strict=True)]
            columns[at] = pc.replace_with_mask(columns[at], asked, pa.array([t for t, _ in done], columns[at].type))
            spans = iter(done)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([next(spans)[1] if x else [] for x in asked.to_pylist()], span)], names=names)

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("removed", kind)]))


def digest(cleaned: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    kept = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def oracle(paragraph: int = PARAGRAPH, reach: int = REACH) -> str:
    """DuckDB SQL for the digest; ids are unique there."""
    return f"""
    WITH parts AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') AS p FROM documents WHERE text IS NOT NULL),
    words AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS part, text FROM parts),
    placed AS (SELECT doc_id, pos, part, translate(regexp_replace(part, '[\\x20\\x09-\\x0D]+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word,
      count(*) OVER (PARTITION BY doc_id) AS n,
      (length(text) - sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS start FROM words),
    runs AS (SELECT *, min(md5(word) || (2000000000 - pos)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {reach - 1} FOLLOWING) AS least,
      md5(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {paragraph - 1} FOLLOWING), ' ')) AS unit FROM placed),
    chosen AS (SELECT DISTINCT doc_id, 2000000000 - substr(least, 33)::BIGINT AS pos FROM runs WHERE pos + {reach} <= n),
    found AS (SELECT r.doc_id, r.pos, r.unit FROM runs r JOIN chosen c ON r.doc_id = c.doc_id AND r.pos = c.pos WHERE r.pos + {paragraph} <= r.n),
    ranked AS (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_at, row_number() OVER w AS k FROM found WINDOW w AS (PARTITION BY unit ORDER BY doc_id, pos)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN first_doc = doc_id THEN greatest(pos, first_at + {paragraph}) ELSE pos END, pos + {paragraph})) AS pos FROM ranked WHERE k > 1),
    marked AS (SELECT p.*, g.pos IS NOT NULL AS gone, p.pos - row_number() OVER (PARTITION BY p.doc_id, g.pos IS NOT NULL ORDER BY p.pos) AS island
      FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos),
    spans AS (SELECT doc_id, min(start) || ':' || max(start + length(part)) AS span, min(pos) AS pos FROM marked WHERE gone GROUP BY doc_id, island),
    removed AS (SELECT doc_id, count(*) AS n_removed, string_agg(span, ',' ORDER BY pos) AS removed FROM spans GROUP BY doc_id),
    kept AS (SELECT doc_id, min(start) AS first, coalesce(string_agg(part, '' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(r.removed, '') AS removed,
      length(CASE WHEN k.doc_id IS NULL THEN coalesce(d.text, '') ELSE substr(d.text, 1, first) || kept END)::BIGINT AS kept_chars,
      sha256(CASE WHEN k.doc_id IS NULL THEN coalesce(d.text, '') ELSE substr(d.text, 1, first) || kept END) AS kept_sha256
    FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN removed r ON r.doc_id = d.doc_id"""
