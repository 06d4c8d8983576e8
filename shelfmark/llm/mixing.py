"""Mixing to target weights with soft domain membership.

A classifier fitted on the labelled table predicts each document's posterior over domains
(``high``, ``low``, ``toxic``). Nonnegative document rates then solve a least-squares
problem: the expected tokens of each domain, summed over documents as rate x tokens x
posterior, shall equal its target share of all tokens. Spark evaluates the sums of every
projected-gradient step over all documents; a step is one small vector, so the rates are
a function of the posterior and the steps so far, and no state is written per step.

The classifier is a multinomial logistic regression over hashed words and a few counts,
fitted on at most ``FIT_ROWS`` labelled documents, those first in hash order.

Defined results: a null text has no tokens; labels of unknown documents and null labels
are ignored; where a document has several labels the worst counts; without labels every
domain is equally likely; without tokens all rates are 1; equal rows get equal rates and
copies. An empty table gives an empty result. Names that begin with ``_mix`` are reserved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfmark.llm.common import making_room, slices, utf8
from shelfmark.runtime import stash

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.90, "low": 0.08, "toxic": 0.02}
FIT_ROWS = 8000
BUCKETS = 1 << 18
#: A word takes part if it stands in so many fitted documents, and its excess in a class is so many standard deviations.
LEAST_DOCS, LEAST_EXCESS = 3, 4.0
EDGES = b".,!?;:$%&#*'()"
COUNTS = 4
STEPS = 40
TOLERANCE = 1e-3


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed distinct words, a few shares, and the number of words."""
    words = text.lower().split() if text else []
    distinct = {w.strip(EDGES) for w in words} - {b""}
    hashed = np.unique(np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in distinct), np.int64, len(distinct)))
    size = max(1, len(text or b""))
    upper = sum(map((text or b"").count, (b"E", b"A", b"T", b"N", b"I"))) / size
    symbols = (len(text or b"") - len((text or b"").translate(None, b"#*$%&|<>!"))) / size
    shares = np.array([1.0, 10 * upper, 10 * symbols, 1 - len(set(words)) / max(1, len(words))])
    return hashed, shares, len(words)


class Classifier:
    """Weights over hashed words and counts; posteriors by softmax."""

    def __init__(self, domains: int):
        self.words, self.counts = np.zeros((BUCKETS, domains)), np.zeros((COUNTS, domains))

    def posteriors(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        logits = np.array([self.words[h].sum(axis=0) + c @ self.counts for h, c, _ in rows]).reshape(len(rows), -1)
        odds = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(rows) else logits
        return odds / odds.sum(axis=1, keepdims=True)

    def fit(self, hashed: list[np.ndarray], counts: np.ndarray, classes: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Full-batch gradient descent with per-weight step sizes.

        Words enter as their log odds between a class and the rest, if they are frequent
        enough and in excess in a class.
        """
        domains, size = self.words.shape[1], len(hashed)
        flat, row = np.concatenate(hashed).astype(np.int32, copy=False), np.repeat(np.arange(size, dtype=np.int32), [len(h) for h in hashed])
        often = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= LEAST_DOCS)
        present = np.stack([np.bincount(flat[classes[row] == k], minlength=BUCKETS)[often] for k in range(domains)], axis=1)
        of_class, docs = np.bincount(classes, minlength=domains), present.sum(axis=1, keepdims=True)
        expected = docs * of_class / size
        excess = (present - expected) / np.sqrt(np.maximum(expected * (1 - of_class / size), 0.3))
        used = excess.max(axis=1) >= LEAST_EXCESS
        own, other = (present[used] + 1) / (of_class + 2), (docs[used] - present[used] + 1) / (size - of_class + 2)
        scale, used = np.log(own / other), often[used]
        # only the words that take part are held from here on
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))
        flat = place[flat]
        flat, row = flat[flat >= 0], row[flat >= 0]
        truth, weights = np.eye(domains)[classes], np.zeros_like(scale)
        seen_w, seen_c = np.full_like(weights, 1e-8), np.full_like(self.counts, 1e-8)
        for _ in range(rounds):
            now = weights * scale
            logits = np.stack([np.bincount(row, now[flat, k], size) for k in range(domains)], axis=1) + counts @ self.counts
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (odds / odds.sum(axis=1, keepdims=True) - truth) / size
            grad_w = np.stack([np.bincount(flat, error[row, k], len(used)) for k in range(domains)], axis=1) * scale + decay * weights
            grad_c = counts.T @ error
            seen_w += grad_w**2
            seen_c += grad_c**2
            weights -= rate * grad_w / np.sqrt(seen_w)
            self.counts -= rate * grad_c / np.sqrt(seen_c)
        self.words[used] = weights * scale


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Classifier:
    """Fit on the labelled documents first in hash order, ``fit_rows`` at most, each id with its least text; only their hashed words reach the driver."""
    worst = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    classes = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("_mix_id")).agg(F.max(worst).alias("_mix_class"))
    order = F.xxhash64("_mix_id", F.lit(3))
    drawn = docs.select(F.col(id_col).alias("_mix_id")).where("_mix_id is not null").distinct().join(classes, "_mix_id").orderBy(order, "_mix_id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("_mix_id"), F.col(text_col).alias("_mix_text")).join(stash(drawn), "_mix_id").groupBy("_mix_id", "_mix_class").agg(F.min("_mix_text").alias("_mix_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t) for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h.tolist() for h, _, _ in rows], pa.list_(pa.int32())), pa.array([c.tolist() for _, c, _ in rows], pa.list_(pa.float64()))],
                names=["_mix_id", "_mix_class", "hashed", "counts"],
            )

    kind = texts.schema["_mix_id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"_mix_id {kind}, _mix_class int, hashed array<int>, counts array<double>").toArrow().sort_by("_mix_id")
    model = Classifier(len(DOMAINS))
    if rows.num_rows:
        hashed, counts = rows.column("hashed").combine_chunks(), rows.column("counts").combine_chunks()
        parts = np.split(hashed.flatten().to_numpy(), np.cumsum(hashed.value_lengths().to_numpy())[:-1])
        model.fit(parts, counts.flatten().to_numpy().reshape(-1, COUNTS), rows.column("_mix_class").to_numpy())
    return model


def posteriors(docs: DataFrame, model: Classifier, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns with ``_mix_tokens`` and ``_mix_p``."""
    carry = list(carry if carry is not None else docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t) for t in utf8(batch.column(at))]
            found = shared.value.posteriors(rows)
            arrays = [*batch.columns[: len(carry)], pa.array([n for _, _, n in rows], pa.int64()), pa.array(found.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, "_mix_tokens", "_mix_p"])

    # a carried text goes to Python once
    at = carry.index(text_col) if text_col in carry else len(carry)
    chosen = docs.select(*carry) if text_col in carry else docs.select(*carry, F.col(text_col).alias("_mix_text"))
    return chosen.mapInArrow(run, docs.select(*carry).schema.add("_mix_tokens", "long").add("_mix_p", T.ArrayType(T.DoubleType())))


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate after all steps: each subtracts its inner product with the posterior, then is cut at zero."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    path = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(path, rate, lambda r, s: F.greatest(F.lit(0.0), r - sum(s[k] * F.col("_mix_p")[k] for k in range(len(DOMAINS)))))


def fit_rates(scored: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The steps of projected gradient descent on the squared error of domain totals.

    The error is weighed by the inverse of the domains' second moments and a document's
    step by the inverse of its tokens, so that few steps are needed.
    """
    k = len(DOMAINS)
    p, t = F.col("_mix_p"), F.col("_mix_tokens")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = scored.agg(F.coalesce(F.sum(t), F.lit(0)).alias("n"), *[F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in pairs]).first()
    total = float(moments["n"])
    if not total:
        return []
    weight = np.zeros((k, k))
    for i, j in pairs:
        weight[i, j] = weight[j, i] = moments[f"m{i}_{j}"] / total
    inverse = np.linalg.pinv(weight, rcond=1e-6)
    wanted = np.array([targets[d] for d in DOMAINS]) / sum(targets[d] for d in DOMAINS)
    done: list[np.ndarray] = []
    for _ in range(steps):
        now = scored.select(_rate(done).alias("r"), t.alias("t"), p.alias("p")).agg(*[F.sum(F.col("r") * F.col("t") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]).first()
        left = np.array([now[f"s{i}"] for i in range(k)]) / total - wanted
        if np.abs(left).max() < tolerance:
            break
        done.append(inverse @ left)
    return done


def with_copies(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns with ``_mix_tokens``, ``_mix_p``, ``_mix_rate`` and ``_mix_copies``.

    Copies are the rate rounded up or down by a hash of the id, so that they keep its mean.
    """
    docs, own = making_room(docs, "", "_mix")
    carry, id_col, text_col = [own[c] for c in (carry if carry is not None else own)], own[id_col], own[text_col]
    model = train(docs, labels, id_col, text_col)
    scored = stash(posteriors(docs, model, text_col, carry))
    rate = _rate(fit_rates(scored, targets))
    drawn = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(17)), 11) / F.lit(float(1 << 53))).cast("double")
    rated = scored.withColumn("_mix_rate", rate)
    return rated.withColumn("_mix_copies", (F.floor("_mix_rate") + F.when(drawn < F.col("_mix_rate") - F.floor("_mix_rate"), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with each row as often as its copies say."""
    rated = with_copies(docs, labels, id_col, text_col, targets)
    return rated.where("_mix_copies > 0").withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*making_room(docs, "", "_mix")[1].values()).toDF(*docs.columns)


def digest(rated: DataFrame) -> DataFrame:
    return rated.select("doc_id", F.col("_mix_tokens").alias("n_tokens"), *[F.col("_mix_p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.col("_mix_rate").alias("rate"), F.col("_mix_copies").alias("copies"))
