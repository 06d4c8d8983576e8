"""Quality rules: counted rules and an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model over the characters of words (with
their ends). Spark counts the n-grams of the whole corpus, continuation counts, discounts
and interpolation included; tasks read it as sorted hash arrays. A text whose
perplexity lies outside its language's band is rejected. A band spans ``FENCE`` times the
median absolute deviation of log perplexity to both sides of the median, over all texts of
that language (null is a language of its own). Junk of less than half of a language's texts
hardly moves these edges.

Defined results: a null text has no words, so it fails the base rules; a text is judged by
its own words alone, so copies get the same verdict; a language with all perplexities
equal keeps these. The model is broadcast while it has at most ``MOST_IN_MEMORY`` n-grams,
else scores come from a join of the corpus's distinct words with the model.
An empty table gives an empty result. A column whose name clashes with an added one, or begins with ``_lm``,
comes back as ``in_`` and its name; ``keep`` returns all columns under their own names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import making_room, slices, utf8
from shelfmark.runtime import forget, stash

ORDER = 4
#: Of 3.5, 4, 4.5, 5, 6 and 7 what rejects most labelled junk of one half of sf0.1 while at most 1% of its clean texts go.
FENCE = 5.0
#: Equal texts' log perplexities differ by rounding.
ROUNDING = 1e-9
#: n-grams of a broadcast model: 24 bytes each; both ways score in double precision.
MOST_IN_MEMORY = 4_000_000
#: Distinct words that a task scores, or counts, at once; counting takes about a kilobyte a word.
HELD_WORDS, COUNTED_WORDS = 150_000, 50_000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
_MIX = np.uint64(0x9E3779B97F4A7C15)
ADDED = "n_words word_chars n_symbols n_dup_lines n_repeat_words log_p n_chars_scored perplexity base_failed kept"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_p double, n_chars_scored long"


def _hash(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each run of ``order`` codes, by the run's last place."""
    count = max(0, len(codes) - order + 1)
    out = np.full(count, order, np.uint64)
    for k in range(order):
        out = (out ^ codes[k : k + count]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _codes(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each after order - 1 start marks and before an end mark; and the words' lengths with the end mark."""
    texts = [w.decode() for w in words]
    start, end = "" * (order - 1), ""
    flat = np.frombuffer("".join([f"{start}{t}{end}" for t in texts]).encode("utf-32-le"), "<u4").astype(np.uint64)
    return flat, np.fromiter(map(len, texts), np.int64, len(texts)) + 1


def _places(lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the predicted characters, and each one's word."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(len(word)) + (order - 1) * (word + 1), word


def _grams(counts: dict[bytes, int], order: int) -> pa.RecordBatch:
    """Rows n, gram, context, suffix, count of the words' n-grams, each distinct one once."""
    flat, lengths = _codes(list(counts), order)
    at, word = _places(lengths, order)
    weight = np.fromiter(counts.values(), np.int64, len(counts))[word]
    full = [_hash(flat, n) if n else None for n in range(order + 1)]
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for n in range(1, order + 1):
        gram = full[n][at - n + 1]
        distinct, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
        context = full[n - 1][at[first] - n + 1] if n > 1 else np.zeros(len(first), np.int64)
        suffix = full[n - 1][at[first] - n + 2] if n > 1 else np.zeros(len(first), np.int64)
        for column, values in zip(columns, (np.full(len(first), n), distinct, context, suffix, np.bincount(inverse, weight, len(first)).astype(np.int64)), strict=True):
            column.append(values)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["n", "gram", "context", "suffix", "count"])


def count_grams(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Counts of all character n-grams within words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                if text:
                    words.update(text.split())
            if len(words) > COUNTED_WORDS:
                yield _grams(words, order)
                words.clear()
        if words:
            yield _grams(words, order)

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n int, gram long, context long, suffix long, count long")
    return parts.groupBy("n", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("count").alias("count"))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows ``n, gram, log_p, log_back``: interpolated log probabilities, and the weight that a context leaves to shorter ones.

    Below the highest order an n-gram counts its distinct left neighbours.
    """
    grams = stash(grams)
    left = grams.where("n > 1").groupBy((F.col("n") - 1).alias("n"), F.col("suffix").alias("gram")).agg(F.count("*").alias("left"))
    used = grams.join(left, ["n", "gram"], "left").withColumn("c", F.when(F.col("n") == order, F.col("count")).otherwise(F.coalesce("left", F.lit(1))))
    tally = {(r["n"], r["c"]): r["k"] for r in used.where("c <= 4").groupBy("n", "c").agg(F.count("*").alias("k")).collect()}
    cut = F.lit(None).cast("double")
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (tally.get((n, k), 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
        cut = F.when(F.col("n") == n, F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).otherwise(cut)
    used = stash(used.withColumn("cut", cut))
    contexts = used.groupBy("n", "context").agg(F.sum("c").alias("total"), F.sum("cut").alias("freed"))
    parts = stash(used.join(contexts, ["n", "context"]).withColumn("own", (F.col("c") - F.col("cut")) / F.col("total")).withColumn("back", F.col("freed") / F.col("total")))
    kinds = parts.where("n = 1").count() + 1  # the last one stands for all unseen characters
    level = parts.where("n = 1").select("n", "gram", (F.col("own") + F.col("back") / kinds).alias("p"))
    levels = [level]
    for n in range(2, order + 1):
        shorter = level.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        level = parts.where(F.col("n") == n).join(shorter, "suffix").select("n", "gram", (F.col("own") + F.col("back") * F.col("q")).alias("p"))
        levels.append(level)
    scored = levels[0]
    for level in levels[1:]:
        scored = scored.unionByName(level)
    backs = parts.groupBy("n", "context").agg(F.first("back").alias("back")).select((F.col("n") - 1).alias("n"), F.col("context").alias("gram"), "back")
    both = scored.join(backs, ["n", "gram"], "full").select("n", "gram", F.log("p").alias("log_p"), F.log("back").alias("log_back"))
    none = F.when(F.col("n") == 0, F.log(F.lit(1.0 / kinds))).otherwise(F.col("log_p"))
    model = stash(both.withColumn("log_p", none))
    for done in (grams, used, parts):
        forget(done)
    return model


class HashArrays:
    """A model as sorted hashes with aligned values, one set for each order."""

    def __init__(self, rows: pa.Table, order: int):
        self.order, self.levels = order, []
        n, gram = rows.column("n").to_numpy(), rows.column("gram").to_numpy()
        log_p, back = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("log_p", "log_back"))
        for k in range(order + 1):
            own = np.flatnonzero(n == k)
            own = own[np.argsort(gram[own])]
            self.levels.append((gram[own], log_p[own], np.nan_to_num(back[own])))
        self.unseen = float(self.levels[0][1][0] + self.levels[0][2][0]) if len(self.levels[0][0]) else 0.0

    def find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = self.levels[n][0]
        if not len(held):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
        return at, held[at] == hashes

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's log probability and its count of predicted characters."""
        flat, lengths = _codes(words, self.order)
        at, word = _places(lengths, self.order)
        out, left = np.zeros(len(at)), np.arange(len(at))
        for n in range(self.order, 0, -1):
            where, seen = self.find(n, _hash(flat, n)[at[left] - n + 1])
            out[left[seen]] += self.levels[n][1][where[seen]]
            left = left[~seen]
            if not len(left):
                break
            if n > 1:  # to a shorter context, for what the longer one leaves
                where, seen = self.find(n - 1, _hash(flat, n - 1)[at[left] - n + 1])
                out[left[seen]] += self.levels[n - 1][2][where[seen]]
        else:
            out[left] += self.unseen
        return np.bincount(word, out, len(words)), lengths


def _base(text: bytes | None, numbers: dict[bytes, int]) -> tuple[tuple[int, ...], list[int]]:
    """The counted rules of one text, and its words as numbers."""
    if not text:
        return (0, 0, 0, 0, 0), []
    words = text.split()
    code_points = len(text.decode())
    solid = text.translate(None, SPACES)
    chars = code_points - (len(text) - len(solid))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)] if b"\n" in text else []
    ids = [numbers[w] for w in words]
    repeats = 0
    if len(ids) > 3:
        row = np.array(ids, np.int64)
        if row.max() < 1 << 21:
            keys = (row[:-2] << 42) | (row[1:-1] << 21) | row[2:]
        else:  # number the pairs first, so that keys stay exact for any count of words
            keys = (np.unique((row[:-2] << 31) | row[1:-1], return_inverse=True)[1] << 31) | row[2:]
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        if twice.any():
            held = np.zeros(len(row), bool)
            for k in range(3):
                held[k : len(row) - 2 + k] |= twice
            repeats = int(held.sum())
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeats), ids


def measure(docs: DataFrame, model: Broadcast | None, text_col: str = "text", carry: list[str] | None = None, order: int = ORDER) -> DataFrame:
    """The ``carry`` columns with the metrics; ``model`` is a broadcast of ``HashArrays``, without it ``log_p`` is zero."""
    carry = list(carry if carry is not None else docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = model.value if model is not None else None
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        log_p, chars = np.zeros(0), np.zeros(0, np.int64)
        for batch in slices(batches):
            if len(numbers) > HELD_WORDS:
                numbers.clear()
                log_p, chars = np.zeros(0), np.zeros(0, np.int64)
            found = [_base(t, numbers) for t in utf8(batch.column(at))]
            sums, counts = [0.0] * len(found), [0] * len(found)
            if arrays:
                fresh = list(numbers)[len(log_p) :]
                if fresh:
                    p, c = arrays.score(fresh)
                    log_p, chars = np.concatenate([log_p, p]), np.concatenate([chars, c])
                for k, (_, ids) in enumerate(found):
                    if ids:
                        sums[k], counts[k] = float(log_p[ids].sum()), int(chars[ids].sum())
            base = list(zip(*(b for b, _ in found), strict=True)) or [()] * 5
            out = [*batch.columns[: len(carry)], *(pa.array(b, pa.int64()) for b in base), pa.array(sums, pa.float64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*carry, *(f.split()[0] for f in METRICS.split(", "))])

    # a carried text goes to Python once
    at = carry.index(text_col) if text_col in carry else len(carry)
    chosen = docs.select(*carry) if text_col in carry else docs.select(*carry, F.col(text_col).alias("_lm_text"))
    schema = docs.select(*carry).schema
    for field in METRICS.split(", "):
        schema = schema.add(*field.split())
    return chosen.mapInArrow(run, schema)


def _scored_by_join(docs: DataFrame, model: DataFrame, text_col: str, carry: list[str], order: int) -> DataFrame:
    """For a model too large to broadcast: each distinct word is scored by joins, order by order, then texts add up their words."""
    rows = stash(measure(docs, None, text_col, list(dict.fromkeys([*carry, text_col])), order).withColumn("_lm_row", F.monotonically_increasing_id()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                held = Counter(text.split()) if text else {}
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(held), pa.int64()), pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["_lm_row", "word", "times"])

    used = stash(rows.select("_lm_row", F.col(text_col)).mapInArrow(words, "_lm_row long, word string, times long"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4096):
            held = batch.column(0).to_pylist()
            flat, lengths = _codes([w.encode() for w in held], order)
            at, word = _places(lengths, order)
            for n in range(1, order + 1):
                context = _hash(flat, n - 1)[at - n + 1] if n > 1 else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([held[w] for w in word], pa.string()), pa.array(at, pa.int64()), pa.array(np.full(len(at), n), pa.int32()), pa.array(_hash(flat, n)[at - n + 1]), pa.array(context)], names=["word", "at", "n", "gram", "context"])

    asked = used.select("word").distinct().mapInArrow(grams, "word string, at long, n int, gram long, context long")
    hit = asked.join(model.where("n > 0").select("n", "gram", "log_p"), ["n", "gram"], "left").join(
        model.select((F.col("n") + 1).alias("n"), F.col("gram").alias("context"), "log_back"), ["n", "context"], "left"
    )
    unseen = model.where("n = 0").agg(F.coalesce(F.sum(F.col("log_p") + F.coalesce("log_back", F.lit(0.0))), F.lit(0.0)).alias("unseen"))
    steps = F.sort_array(F.collect_list(F.struct("n", "log_p", F.coalesce("log_back", F.lit(0.0)).alias("back"))), asc=False)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("done"))
    walk = F.aggregate(
        steps,
        start,
        lambda a, s: F.when(a["done"], a)
        .when(s["log_p"].isNotNull(), F.struct((a["sum"] + s["log_p"]).alias("sum"), F.lit(True).alias("done")))
        .otherwise(F.struct((a["sum"] + F.when(s["n"] > 1, s["back"]).otherwise(0.0)).alias("sum"), F.lit(False).alias("done"))),
    )
    places = hit.groupBy("word", "at").agg(walk.alias("w")).join(F.broadcast(unseen))
    scored = places.groupBy("word").agg(F.sum(F.col("w.sum") + F.when(F.col("w.done"), 0.0).otherwise(F.col("unseen"))).alias("p"), F.count("*").alias("chars"))
    total = used.join(scored, "word").groupBy("_lm_row").agg(F.sum(F.col("p") * F.col("times")).alias("_lm_p"), F.sum(F.col("chars") * F.col("times")).alias("_lm_c"))
    done = rows.drop("log_p", "n_chars_scored").join(total, "_lm_row", "left")
    return done.select(*carry, *(f.split()[0] for f in METRICS.split(", ")[:-2]), F.coalesce("_lm_p", F.lit(0.0)).alias("log_p"), F.coalesce("_lm_c", F.lit(0)).alias("n_chars_scored"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, order: int = ORDER, fence: float = FENCE, most_in_memory: int = MOST_IN_MEMORY, again: bool = False) -> DataFrame:
    """The ``carry`` columns with metrics, ``perplexity`` (null without words), ``base_failed`` and ``kept``.

    ``again`` scores rows again once the bands are known, rather than write what they carry.
    """
    docs, names = making_room(docs, ADDED, "_lm")
    carry, text_col, lang_col = [names[c] for c in (carry if carry is not None else names)], names[text_col], names[lang_col]
    model = kneser_ney(count_grams(docs, text_col, order), order)
    with_lang = docs.withColumn("_lm_lang", F.col(lang_col).cast("string"))
    small = model.count() <= most_in_memory
    arrays = docs.sparkSession.sparkContext.broadcast(HashArrays(model.toArrow(), order)) if small else None

    def scored_rows(columns: list[str]) -> DataFrame:
        rows = measure(with_lang, arrays, text_col, columns, order) if arrays is not None else _scored_by_join(with_lang, model, text_col, columns, order)
        return rows.withColumn("perplexity", F.when(F.col("n_chars_scored") > 0, F.exp(-F.col("log_p") / F.col("n_chars_scored"))))

    again = again and arrays is not None
    first = stash(scored_rows(["_lm_lang"]).select("_lm_lang", "perplexity") if again else scored_rows([*carry, "_lm_lang"]))
    scored = scored_rows([*carry, "_lm_lang"]) if again else first
    known = first.where("perplexity is not null").select(F.col("_lm_lang").alias("_lm_of"), F.log("perplexity").alias("_lm_x"))
    middles = known.groupBy("_lm_of").agg(F.percentile_approx("_lm_x", 0.5, 10000).alias("_lm_m"))
    apart = known.join(middles.withColumnRenamed("_lm_of", "_lm_its"), F.col("_lm_of").eqNullSafe(F.col("_lm_its"))).select("_lm_of", "_lm_m", F.abs(F.col("_lm_x") - F.col("_lm_m")).alias("_lm_d"))
    spreads = apart.groupBy("_lm_of").agg(F.first("_lm_m").alias("_lm_m"), (fence * F.percentile_approx("_lm_d", 0.5, 10000) + ROUNDING).alias("_lm_w"))
    bands = spreads.select("_lm_of", (F.col("_lm_m") - F.col("_lm_w")).alias("_lm_low"), (F.col("_lm_m") + F.col("_lm_w")).alias("_lm_high"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.log("perplexity").between(F.col("_lm_low"), F.col("_lm_high"))
    # a row for each language; beyond the session's broadcast bound Spark joins it by shuffle
    judged = scored.join(bands, scored["_lm_lang"].eqNullSafe(bands["_lm_of"]), "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("_lm_lang", "_lm_of", "_lm_low", "_lm_high")


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules and bands keep."""
    return judge(docs, text_col, lang_col, again=True).where("kept").select(*making_room(docs, ADDED, "_lm")[1].values()).toDF(*docs.columns)
