"""Language identification by hyperdimensional profiles.

Each letter (and the word gap) has a random vector of +1 and -1 made from its code point.
An n-gram's vector binds its letters: the elementwise product of the letters' vectors,
rotated by their places. A text's vector bundles (adds) those of all its n-grams; a
language's prototype adds those of its texts. The prediction is the prototype of largest
cosine.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without
any labelled text all rows are ``und``; equal cosines go to the language first in order;
rows with a null language or text teach nothing; repeated rows count each time. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import crc_of_id, slices, utf8
from shelfmark.runtime import stash

DIMENSIONS = 1024
ORDER = 3
UNKNOWN = "und"
#: Languages compared at once: prototypes are broadcast, 8 kB each. More of them are compared part by part.
MOST_LANGUAGES = 2000
CACHED_GRAMS = 32_768


class Profiles:
    """Vectors of letters and n-grams; the same in every process."""

    def __init__(self, dimensions: int, order: int):
        self.dimensions, self.order = dimensions, order
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.code = np.where(letter, np.arange(0x110000), 0).astype(np.int64)  # 0: the gap
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.grams = np.empty((1024, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.Generator(np.random.PCG64([code, 7])).choice(np.array([-1, 1], np.float32), self.dimensions)
        return self.letters[code]

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams as numbers, and their counts; empty if there is no letter."""
        codes = self.code[np.frombuffer(text.decode().lower().encode("utf-32-le"), "<u4")]
        codes = np.concatenate(([0], codes, [0]))
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # one gap between words
        if len(codes) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key = codes[: len(codes) - self.order + 1].copy()
        for k in range(1, self.order):
            key = (key << 21) | codes[k : len(codes) - self.order + 1 + k]
        return np.unique(key, return_counts=True)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The n-grams' vectors."""
        fresh = [k for k in keys.tolist() if k not in self.row]
        if len(self.row) + len(fresh) > CACHED_GRAMS:
            self.row.clear()
            fresh = keys.tolist()
        for key in fresh:
            at = len(self.row)
            if at == len(self.grams):
                self.grams = np.concatenate([self.grams, np.empty_like(self.grams)])
            vector = np.ones(self.dimensions, np.float32)
            for place in range(self.order):
                code = key >> 21 * (self.order - 1 - place) & 0x1FFFFF
                vector = vector * np.roll(self.letter(code), self.order - 1 - place)
            self.grams[at] = vector
            self.row[key] = at
        return np.fromiter(map(self.row.__getitem__, keys.tolist()), np.int64, len(keys))

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for at in range(0, len(keys), 8192):
            rows = self.rows(keys[at : at + 8192])
            total += counts[at : at + 8192].astype(np.float32) @ self.grams[rows]
        return total


_PROFILES: dict[tuple[int, int], Profiles] = {}


def _profiles(dimensions: int, order: int) -> Profiles:
    if (dimensions, order) not in _PROFILES:
        _PROFILES[dimensions, order] = Profiles(dimensions, order)
    return _PROFILES[dimensions, order]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS, order: int = ORDER) -> DataFrame:
    """Rows ``lang, value``: a prototype for each language of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = _profiles(dimensions, order), {}
        for batch in slices(batches):
            grams: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                grams.setdefault(lang, []).append(own.counts(text))
            for lang, found in grams.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([c for _, c in found]), len(keys))
                sums[lang] = sums.get(lang, 0) + own.bundle(keys, counts)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(range(dimensions), pa.int32()), pa.array(total, pa.float64())], names=["lang", "dim", "value"])

    taught = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    parts = taught.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    return parts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).select("lang", F.col("v.value").alias("value"))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS, order: int = ORDER, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` with ``lang_pred`` and ``score`` (cosine)."""
    carry = list(carry if carry is not None else [c for c in docs.columns if c != text_col])
    names = [n for n, v in prototypes.items() if np.any(v)]
    matrix = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).reshape(len(names), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _profiles(dimensions, order)
        for batch in slices(batches):
            langs, scores = [], []
            for text in utf8(batch.column(len(carry))):
                keys, counts = own.counts(text) if text else ((), ())
                vector = own.bundle(keys, counts) if len(keys) and names else None
                size = np.linalg.norm(vector) if vector is not None else 0.0
                if not size:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = matrix @ vector / size
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(cosines[best]))
            arrays = [*batch.columns[: len(carry)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, "lang_pred", "score"])

    chosen = docs.select(*carry, F.col(text_col).alias("_text"))
    return chosen.mapInArrow(run, chosen.drop("_text").schema.add("lang_pred", "string").add("score", "double"))


def _held(prototypes: DataFrame) -> dict[str, np.ndarray]:
    return {r["lang"]: np.array(r["value"]) for r in sorted(prototypes.collect(), key=lambda r: r["lang"])}


def identify(docs: DataFrame, id_col: str = "doc_id", most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """Rows ``doc_id, held_out, lang_pred, score``: learned on two thirds of the ids, predicted for all rows."""
    marked = docs.select(F.col(id_col).alias("doc_id"), "text", "lang", (F.coalesce(crc_of_id(id_col), F.lit(0)) % 3 == 1).alias("held_out"))
    prototypes = stash(learn(marked.where("not held_out")))
    parts = -(-2 * count // most_languages) if (count := prototypes.count()) > most_languages else 1
    if parts == 1:
        found = predict(marked, _held(prototypes), carry=["doc_id", "held_out"])
    else:
        numbered = stash(marked.withColumn("row", F.monotonically_increasing_id()))
        held = (_held(prototypes.where(F.pmod(F.xxhash64("lang"), F.lit(parts)) == k)) for k in range(parts))
        each = [predict(numbered, some, carry=["row", "doc_id", "held_out"]) for some in held if some]
        best = reduce(DataFrame.unionByName, each).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("minus"), "lang_pred", "doc_id", "held_out")).alias("b"))
        found = best.select("b.doc_id", "b.held_out", "b.lang_pred", (-F.col("b.minus")).alias("score"))
    return found.select("doc_id", "held_out", "lang_pred", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
