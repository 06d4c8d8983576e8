"""Toxicity by a subsequence string-kernel support vector machine over Nyström landmarks.

The kernel of two strings counts their common subsequences of three letters, each weighed by ``DECAY`` for every letter
that it skips, in spans of at most ``SPAN`` letters; so an insult with inserted letters or gaps keeps much of its
likeness. Punctuation is taken out of words first, their ends are marked, and letters that stand alone one after another
make a word. Landmarks are fragments of words: those that stand in toxic labelled documents far more often than elsewhere, and those of
clean words that are most like them. A word's features are its kernel values with the landmarks, squared and scaled by the landmark's own
value, so what stands around an insult doesn't dilute it; a sentence has the largest value of its words for each landmark, and
the inverse root of the landmarks' own kernel matrix makes these features those of the kernel machine.

A document's label holds for some sentence of it. The machine is trained on labelled sentences: all of clean documents, and of each toxic
document the one that it rates highest and others that it rates toxic, chosen again until the choice stays. A document's margin is that of its highest sentence, and a
rising curve, fitted on documents that the machine has not seen, makes it a score.

Spark counts fragments, finds landmarks and rates all documents; the machine itself is fitted on a bounded sample: ``TOXIC_DOCS`` and
``CLEAN_DOCS`` labelled documents, those first in hash order, and ``FIT_SENTENCES`` of their sentences.

Defined results: null and empty texts have the score of a sentence without any likeness; without labels of both kinds
every score is the share of toxic ones (0 without labels); null labels are ignored, of several labels of a document the
largest counts; a null id is not held out and never learnt from; equal texts get equal scores. Texts of any length are read whole.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.common import Numbers, crc_of_id, slices, utf8
from shelfmark.runtime import stash

TOXIC_DOCS, CLEAN_DOCS, FIT_SENTENCES = 3000, 6000, 60_000
#: Of the sampled documents one in so many serves for the curve.
CURVE_PART = 4
DECAY, SPAN = 0.7, 6
#: Letters of a fragment, the word's ends among them; a landmark's words stand in so many toxic documents, so many standard deviations more than expected, and this share of their documents is toxic.
SHORTEST, LONGEST, LEAST_DOCS, LEAST_EXCESS, LEAST_SHARE = 5, 10, 4, 6.0, 0.6
LANDMARKS, CLEAN_LANDMARKS = 48, 24
#: Landmarks are less alike than this; scaled kernel values below the floor count as none.
TOO_ALIKE, FLOOR = 0.5, 0.45
COST, ROUNDS = 10.0, 6
#: What all stretched fragments weigh in the training, for each toxic sentence that is chosen.
STRETCHED = 0.1
THRESHOLD = 0.7
#: Words that a task keeps; bytes of a word that are compared at once, and how far the next such window begins.
KEPT_WORDS, WINDOW, SHIFT = 300_000, 24, 12
#: Words that are looked up at once, and bytes of a part of a long text.
AT_ONCE, PART = 200_000, 1 << 20
MARK = b"|"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz    ")
SIGNS = b"\"#$%&'()*+,-/:;<=>@[\\]^_`{|}~"
ENDS = re.compile(rb"[.!?]+[ \n]+|\n+")
ALONE = re.compile(rb" [a-z0-9] [a-z0-9] [a-z0-9](?![^ ])")
SPELLED = re.compile(rb"(?<![^ ])[a-z0-9](?: [a-z0-9]){2,}(?![^ ])")


def words_of(text: bytes | None) -> list[bytes]:
    """The text's words in small letters without signs; ``MARK`` stands between sentences. Letters that stand alone in a row are one word."""
    if not text:
        return []
    plain = ENDS.sub(b" | ", text.translate(LOWER, SIGNS)).translate(None, b".!?")
    # few texts have such letters; a search from blank to blank tells
    return (SPELLED.sub(lambda m: m[0].replace(b" ", b""), plain) if ALONE.search(b" " + plain) else plain).split()


def parts_of(text: bytes | None) -> Iterator[bytes]:
    """A text whole if it is short, else in parts that end at a blank."""
    at, text = 0, text or b""
    while at < len(text):
        end = len(text) if at + PART >= len(text) else text.find(b" ", at + PART)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def sentences(text: bytes | None) -> list[list[bytes]]:
    """The words of each sentence, none of them empty."""
    out: list[list[bytes]] = [[]]
    for word in words_of(text):
        if word == MARK:
            out.append([])
        else:
            out[-1].append(word)
    return [s for s in out if s]


PAIRS = [(a, b, DECAY ** (b - 2)) for a, b in combinations(range(1, SPAN), 2)]


def subsequences(word: bytes) -> dict[bytes, float]:
    """The weights of a word's subsequences of three letters."""
    out: dict[bytes, float] = {}
    for at in range(len(word)):
        for a, b, weight in PAIRS:
            if at + b < len(word):
                key = bytes((word[at], word[at + a], word[at + b]))
                out[key] = out.get(key, 0.0) + weight
    return out


@cache
def profile(word: bytes) -> dict[bytes, float]:
    """The subsequences' weights, scaled to length 1."""
    weights = subsequences(word)
    length = max(1e-9, sum(w * w for w in weights.values()) ** 0.5)
    return {k: w / length for k, w in weights.items()}


def likeness(one: bytes, other: bytes) -> float:
    """The kernel of two words, scaled to 1 for equal ones."""
    b = profile(other)
    return sum(w * b[k] for k, w in profile(one).items() if k in b)


class Landmarks:
    """Kernel values of many words with a few landmarks, by one look-up for each subsequence of a word."""

    def __init__(self, names: list[bytes]):
        self.names = names
        letters = sorted(set(b"".join(names)), key=lambda c: (-sum(n.count(c) for n in names), c))[:63]
        self.code = np.zeros(256, np.int32)
        self.code[letters] = np.arange(1, len(letters) + 1)
        profiles = [{k: v for k, v in subsequences(n).items() if all(self.code[c] for c in k)} for n in names]
        keys = sorted({k for p in profiles for k in p})
        self.place = np.zeros(1 << 18, np.int32)
        raw = np.zeros((len(keys) + 1, len(names)))
        for row, key in enumerate(keys, 1):
            self.place[(self.code[key[0]] << 12) | (self.code[key[1]] << 6) | self.code[key[2]]] = row
            raw[row] = [p.get(key, 0.0) for p in profiles]
        own = np.maximum((raw**2).sum(axis=0), 1e-9)
        self.scaled = (raw / own).astype(np.float32)
        self.most = self.scaled.max(axis=1, initial=0.0)
        # a subsequence stands in few landmarks: each row's entries one after another
        row, self.entry_of = np.nonzero(self.scaled)
        self.entries = self.scaled[row, self.entry_of].astype(float)
        self.begins = np.searchsorted(row, np.arange(len(self.scaled) + 1))
        self.gram = ((raw.T @ raw) / np.sqrt(np.outer(own, own))) ** 2

    def values(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words that are like some landmark, by number, and their features; a bound that only sums leaves most words out."""
        pieces, owner = [], []
        for number, word in enumerate(words):
            word = b"^" + word + b"$"
            for at in range(0, max(1, len(word) - SHIFT), SHIFT) if len(word) > WINDOW else (0,):
                pieces.append(word[at : at + WINDOW])
                owner.append(number)
        gap = b"\x00" * (SPAN - 1)
        letters = self.code[np.frombuffer(gap.join(pieces) + gap, np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)) + SPAN - 1)
        size, found = len(letters) - SPAN + 1, []
        for a, b, weight in PAIRS:
            rows = self.place[(letters[:size] << 12) | (letters[a : size + a] << 6) | letters[b : size + b]]
            at = np.flatnonzero(rows)
            found.append((piece[at], rows[at], np.full(len(at), weight, np.float32)))
        which, rows, weights = (np.concatenate(x) for x in zip(*found, strict=True))
        bound = np.bincount(which, weights * self.most[rows], len(pieces))
        near = bound >= FLOOR
        number = np.cumsum(near) - 1
        kept = near[which]
        which, rows, weights = number[which[kept]], rows[kept], weights[kept]
        count = self.begins[rows + 1] - self.begins[rows]
        entry = np.repeat(self.begins[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
        width = len(self.names)
        sums = np.bincount(np.repeat(which * width, count) + self.entry_of[entry], np.repeat(weights, count) * self.entries[entry], int(near.sum()) * width)
        out = sums.reshape(-1, width).astype(np.float32)
        out = np.where(out < FLOOR, 0.0, np.minimum(out, 1.0)) ** 2
        owners = np.array(owner, np.int64)[near]
        first = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(owners) else owners
        words_near, best = owners[first], np.maximum.reduceat(out, first, axis=0) if len(first) else out
        alike = best.any(axis=1)
        return words_near[alike], best[alike]


class Rater:
    """Features of sentences; a task keeps those of ``KEPT_WORDS`` words."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.start()

    def start(self) -> None:
        self.numbers = Numbers()
        self.numbers[MARK] = 0
        self.row_of = np.zeros(1, np.int32)
        self.features = np.zeros((1, len(self.landmarks.names)), np.float32)

    def rows(self, words: Iterable[bytes], count: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word its number, and the row of its features; row 0 has none."""
        if len(self.numbers) > KEPT_WORDS:
            self.start()
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, count)
        fresh = self.numbers.taken()
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            near, values = self.landmarks.values(part)
            rows = np.zeros(len(part), np.int32)
            rows[near] = len(self.features) + np.arange(len(near))
            self.features, self.row_of = np.concatenate([self.features, values]), np.concatenate([self.row_of, rows])
        return ids, self.row_of[ids]

    def pooled(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the sentences with any likeness: the text's number, the sentence's number, the features."""
        found, pending, owners, held, sentence = [], [], [], 0, 0
        for number, text in enumerate(texts):
            sentence += 1
            for part in parts_of(text):
                pending.append(words_of(part))
                owners.append(number)
                held += len(pending[-1])
                if held >= AT_ONCE:
                    found.append(self._pooled(pending, owners, sentence))
                    pending, owners, held, sentence = [], [], 0, found[-1][3]
        found.append(self._pooled(pending, owners, sentence))
        text, ends, values = (np.concatenate([f[k] for f in found]) for k in range(3))
        if not len(text):
            return text, ends, values
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (ends[1:] != ends[:-1])])
        return text[first], ends[first], np.maximum.reduceat(values, first, axis=0)

    def _pooled(self, lists: list[list[bytes]], owners: list[int], sentence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Words with any likeness: their text, sentence and features; sentences are numbered on from ``sentence``, which is also the last number then."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids, rows = self.rows(chain.from_iterable(lists), int(sizes.sum()))
        near = np.flatnonzero(rows)
        ends = sentence + np.cumsum(ids == 0)  # the mark's number
        owner = np.repeat(np.array(owners, np.int64), sizes)
        return owner[near], ends[near], self.features[rows[near]], int(ends[-1]) if len(ends) else sentence


def stretched_words(fragment: bytes) -> list[bytes]:
    """A fragment's letters as words, each with one strange letter inside: what an insult that was stretched to get past a filter looks like."""
    letters = fragment.strip(b"^$")
    return [letters[:at] + b"\x7f" + letters[at:] for at in range(1, len(letters))]


class Machine:
    """A margin ``features @ weights + bias`` and the rising curve that makes it a score; without landmarks a constant."""

    def __init__(self, toxic: list[bytes], clean: list[bytes], share: float):
        landmarks, self.n_toxic = [*toxic, *clean], len(toxic)
        self.landmarks = Landmarks(landmarks) if toxic else None
        self.weights, self.bias, self.share = np.zeros(len(landmarks)), 0.0, share
        self.knots, self.levels = np.zeros(1), np.full(1, share)

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(margins), self.share)
        even = 1 / (1 + np.exp(-np.clip(margins, -40, 40)))  # a little of the margin itself keeps the order within a step
        return 0.98 * np.interp(margins, self.knots, self.levels) + 0.02 * even

    def fit(self, docs: np.ndarray, toxic: np.ndarray, features: np.ndarray, blank_clean: int) -> None:
        """Squared hinge loss by Newton steps; the toxic sentences of toxic documents are chosen anew in each round, one at least of each.

        ``docs`` numbers each sentence's document; ``blank_clean`` clean sentences have no likeness at all.
        """
        values, vectors = np.linalg.eigh(self.landmarks.gram)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        stretched = self.landmarks.values([w for n in self.landmarks.names[: self.n_toxic] for w in stretched_words(n)])[1]
        x = np.vstack([features @ root, np.zeros((1, features.shape[1])), stretched @ root])
        x = np.hstack([x, np.ones((len(x), 1))])
        blank, more = len(features), np.arange(len(features) + 1, len(x))
        rating, chosen = features[:, : self.n_toxic].max(axis=1, initial=0.0) - 0.5, None
        for _ in range(ROUNDS):
            order = np.lexsort((-rating, docs))
            first = order[np.r_[True, docs[order][1:] != docs[order][:-1]]] if len(order) else order
            witness = np.union1d(first[toxic[first]], np.flatnonzero(toxic & (rating > 0)))
            if chosen is not None and np.array_equal(chosen, witness):
                break
            chosen = witness
            used = np.r_[np.flatnonzero(~toxic), witness, more, blank]
            sign = np.r_[-np.ones(int((~toxic).sum())), np.ones(len(witness) + len(more)), -1.0]
            cost = np.r_[np.full(len(used) - 1 - len(more), COST), np.full(len(more), COST * STRETCHED * len(witness) / max(1, len(more))), COST * blank_clean]
            w, ridge = np.zeros(x.shape[1]), np.r_[np.ones(x.shape[1] - 1), 1e-6]
            for _ in range(50):
                slack = 1 - sign * (x[used] @ w)
                on = slack > 0
                rows = x[used][on] * cost[on, None]
                step = np.linalg.solve(np.diag(ridge) + 2 * rows.T @ x[used][on], ridge * w - 2 * rows.T @ (sign * slack)[on])
                w = w - step
                if np.abs(step).max() < 1e-8:
                    break
            self.weights, self.bias = root @ w[:-1], float(w[-1])
            rating = self.margins(features)

    def curve(self, margins: np.ndarray, toxic: np.ndarray) -> None:
        """The rising step function nearest to the labels: neighbours that fall are pooled; between steps the score rises evenly."""
        order = np.argsort(margins, kind="stable")
        steps: list[list[float]] = []  # sum of labels, rows, lowest and highest margin
        for m, t in zip(margins[order].tolist(), toxic[order].tolist(), strict=True):
            if steps and m == steps[-1][3]:
                steps[-1] = [steps[-1][0] + t, steps[-1][1] + 1, steps[-1][2], m]
            else:
                steps.append([float(t), 1.0, m, m])
            while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
                s, n, _, high = steps.pop()
                steps[-1] = [steps[-1][0] + s, steps[-1][1] + n, steps[-1][2], high]
        found = [((s + 0.5) / (n + 1), low, high) for s, n, low, high in steps]
        self.knots = np.array([m for _, low, high in found for m in (low, high)])
        self.levels = np.maximum.accumulate(np.array([v for v, _, _ in found for _ in (0, 1)]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_of_id(id_col) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> DataFrame:
    """Labelled sentences ``doc, toxic, curve, sentence, words`` of at most so many documents of either kind; a document whose id is held out is never among them."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") == 1).alias("toxic"))
    ids = docs.select(F.col(id_col).alias("_id")).where(F.col(id_col).isNotNull() & ~held_out(id_col)).distinct().join(known, "_id")
    order = F.xxhash64("_id", F.lit(11))
    drawn = stash(ids.where("toxic").orderBy(order, "_id").limit(toxic_docs).unionByName(ids.where("not toxic").orderBy(order, "_id").limit(clean_docs)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for row, text in enumerate(utf8(batch.column(1))):
                out += [(row, at, words) for at, words in enumerate(sentences(text))]
            take = pa.array([r for r, _, _ in out], pa.int64())
            words = pa.array([w for _, _, w in out], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array([s for _, s, _ in out], pa.int64()), words], names=["doc", "toxic", "curve", "sentence", "words"])

    curve = F.pmod(F.xxhash64("_id", F.lit(12)), F.lit(CURVE_PART)) == 0
    return texts.select("_id", "_text", "toxic", curve.alias("curve")).mapInArrow(run, f"doc {docs.schema[id_col].dataType.simpleString()}, toxic boolean, curve boolean, sentence long, words array<string>")


def choose_landmarks(held: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Fragments that mark toxic documents, and the clean ones that are most like them. Spark counts all fragments; a few thousand at most are compared here."""
    seen = held.where("not curve").select("doc", "toxic", F.explode("words").alias("word")).distinct()
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    words = stash(seen.groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")))
    totals = held.where("not curve").groupBy("toxic").agg(F.count_distinct("doc").alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in totals}
    if len(n) < 2:
        return [], []
    share = n[True] / (n[True] + n[False])
    cut = F.expr(f"explode(flatten(transform(sequence({SHORTEST}, {LONGEST}), k -> transform(filter(sequence(1, greatest(1, length(word) - k + 1)), i -> i + k - 1 <= length(word)), i -> substr(word, i, k)))))")
    expected = (F.col("t") + F.col("c")) * share
    excess = (F.col("t") - expected) / F.sqrt(expected * (1 - share) + 0.3)
    counted = words.withColumn("word", marked).select("t", "c", cut.alias("part")).groupBy("part").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).withColumn("excess", excess)
    found = counted.where((F.col("t") >= LEAST_DOCS) & (F.col("excess") >= LEAST_EXCESS) & (F.col("t") >= LEAST_SHARE * (F.col("t") + F.col("c")))).orderBy(F.round("excess", 6).desc(), F.length("part").desc(), "part").limit(2000).collect()
    chosen: list[bytes] = []
    for row in found:
        part = row["part"].encode()
        if len(chosen) < LANDMARKS and all(likeness(part, other) < TOO_ALIKE for other in chosen):
            chosen.append(part)
    if not chosen:
        return [], []
    marks = Landmarks(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=20_000):
            near, values = marks.values(utf8(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(near)), pa.array(values.max(axis=1).astype(np.float64))], names=["word", "like"])

    clean = words.where("t = 0 and c >= 2").select("word").mapInArrow(run, "word string, like double").orderBy(F.round("like", 6).desc(), "word").limit(500).collect()
    near: list[bytes] = []
    for row in clean:
        word = (b"^" + row["word"].encode() + b"$")[:WINDOW]
        if len(near) < CLEAN_LANDMARKS and all(likeness(word, other) < TOO_ALIKE for other in near):
            near.append(word)
    return chosen, near


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> Machine:
    """The machine fitted on the sample of labelled sentences."""
    held = stash(sample(docs, labels, id_col, text_col, **bounds))
    kinds = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count_distinct("doc").alias("n")).collect()}
    machine = Machine(*choose_landmarks(held), kinds.get(True, 0) / max(1, sum(kinds.values())))
    if machine.landmarks is None:
        return machine
    shared = docs.sparkSession.sparkContext.broadcast(machine.landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rater = Rater(shared.value)
        for batch in slices(batches):
            texts = [b" ".join(w.encode() for w in words) for words in batch.column(4).to_pylist()]
            row, _, values = rater.pooled(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in range(4)), pa.array(values.tolist(), pa.list_(pa.float32()))], names=["doc", "toxic", "curve", "sentence", "features"])

    rated = stash(held.mapInArrow(run, held.drop("words").schema.add("features", T.ArrayType(T.FloatType()))))
    drawn = rated.orderBy(F.xxhash64("doc", "sentence"), "doc", "sentence").limit(FIT_SENTENCES).toArrow().sort_by([("doc", "ascending"), ("sentence", "ascending")])
    features = drawn.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(machine.weights)).astype(float)
    docs_of = drawn.column("doc").combine_chunks().dictionary_encode().indices.to_numpy()
    toxic, curve = (drawn.column(c).to_numpy().astype(bool) for c in ("toxic", "curve"))
    blank = held.where("not toxic and not curve").count() - int((~toxic & ~curve).sum())
    machine.fit(docs_of[~curve], toxic[~curve], features[~curve], max(1, blank))
    # documents of the curve's part without any likeness have the bias as their margin
    rest = {r["toxic"]: r["n"] for r in held.where("curve").groupBy("toxic").agg(F.count_distinct("doc").alias("n")).collect()}
    tops, kind = {}, {}
    for d, t, m in zip(docs_of[curve], toxic[curve], machine.margins(features[curve]), strict=True):
        tops[d], kind[d] = max(m, tops.get(d, machine.bias)), t
    known = np.array([kind[d] for d in tops], bool)
    blanks = [max(0, rest.get(t, 0) - int((known == t).sum())) for t in (True, False)]
    machine.curve(np.r_[np.array(list(tops.values())), np.full(sum(blanks), machine.bias)], np.r_[known, np.ones(blanks[0], bool), np.zeros(blanks[1], bool)])
    return machine


def rate(docs: DataFrame, machine: Machine, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns with ``score`` (0 to 1) and ``predicted``."""
    carry = list(carry if carry is not None else docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        rater = Rater(machine.landmarks) if machine.landmarks else None
        for batch in slices(batches):
            margins = np.full(batch.num_rows, machine.bias)
            if rater:
                text, _, features = rater.pooled(utf8(batch.column(len(carry))))
                np.maximum.at(margins, text, machine.margins(features))
            scores = machine.scores(margins)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*carry, "score", "predicted"])

    schema = docs.select(*carry).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*carry, F.col(text_col).alias("_toxicity_text")).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted``, learnt from the documents that are not held out."""
    return rate(docs, train(docs, labels), carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
