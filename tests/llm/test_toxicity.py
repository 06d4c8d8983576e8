"""The toxicity machine: its kernel against plain loops, planted insults on held-out documents, odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from shelfmark.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, toxic string, score double, predicted int, held_out boolean"
INSULTS = ["blockhead", "numpty", "wretchor", "grumbleswine"]


def documents(n=420, noise=0):
    rng = random.Random(7)
    parts = ["ka", "lo", "mi", "ren", "tas", "vu", "pel", "dor", "in", "shu", "art", "ble", "swi", "pty"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        sents = [[rng.choice(words) for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 8))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                s = rng.choice(sents)
                s.insert(rng.randrange(len(s)), rng.choice(INSULTS))
        docs.append((i, rng.choice([". ", ".\n", "! "]).join(" ".join(s).capitalize() for s in sents), "en", "s", "x", 0.5, 3, True))
        labels.append((i, int(toxic), 1))
    return docs, labels


@pytest.fixture(scope="module")
def machine(spark):
    docs, labels = documents()
    return toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


def plain(u, v):
    """Sum over equal triples of letters of the decays of both spans."""
    def triples(w):
        return [(w[a] + w[b] + w[c], toxicity.DECAY ** (c - a - 2)) for a, b, c in itertools.combinations(range(len(w)), 3) if c - a < toxicity.SPAN]

    return sum(x * y for p, x in triples(u) for q, y in triples(v) if p == q)


def test_values_equal_plain_loops():
    names = ["^idiot$", "^lowei", "sgust", "^scum$", "über"]
    words = ["idiot", "idxiot", "loweischaft", "scum", "scuxxm", "closer", "x", "", "disgusting", "disgust" * 9, "überall", "idiotidiot"]
    marks = toxicity.Landmarks([n.encode() for n in names])
    near, values = marks.values([w.encode() for w in words])
    got = np.zeros((len(words), len(names)))
    got[near] = values
    for w, row in zip(words, got, strict=True):
        whole = ("^" + w + "$").encode().decode("latin-1")
        pieces = [whole] if len(whole) <= toxicity.WINDOW else [whole[at : at + toxicity.WINDOW] for at in range(0, len(whole) - toxicity.SHIFT, toxicity.SHIFT)]
        for n, x in zip(names, row, strict=True):
            n = n.encode().decode("latin-1")
            k = max(plain(p, n) for p in pieces) / plain(n, n)
            assert x == pytest.approx(0 if k < toxicity.FLOOR - 1e-6 else min(k, 1) ** 2, abs=1e-4)


def test_gram_equals_plain_loops():
    names = ["^idiot$", "^moron$", "tic$"]
    got = toxicity.Landmarks([n.encode() for n in names]).gram
    want = [[(plain(a, b) / np.sqrt(plain(a, a) * plain(b, b))) ** 2 for b in names] for a in names]
    assert got == pytest.approx(np.array(want))


def test_words():
    assert toxicity.words_of("An i.d.i.o.t, yes! I D I O T\nÉté it's".encode()) == [b"an", b"idiot", b"yes", b"|", b"idiot", b"|", "Été".encode(), b"its"]
    assert toxicity.sentences(b"") == toxicity.sentences(None) == toxicity.sentences(b" . \n!") == []


def test_held_out_documents(spark, machine):
    docs, labels = documents()
    got = {r["doc_id"]: r for r in toxicity.digest(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in docs}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    out = [(t, got[i]["predicted"]) for i, t, _ in labels if got[i]["held_out"]]
    assert sum(p for t, p in out if t) >= 0.95 * sum(t for t, _ in out) and sum(p for t, p in out if not t) <= 0.02 * len(out)


def test_gaps_and_inserted_letters(spark, machine):
    texts = ["you blockhead", "you b.l.o.c.k.h.e.a.d", "you b l o c k h e a d", "you blockxhead", "you grumblesxwine now", "kalo miren tas", "", None, "lo mi " * 200_000 + "numpty end"]
    rows = toxicity.rate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), machine, carry=["doc_id"]).collect()
    found = {r["doc_id"]: r["predicted"] for r in rows}
    assert [found[i] for i in range(len(texts))] == [1, 1, 1, 1, 1, 0, 0, 0, 1]
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[6] == scores[7]


def test_held_out_and_wrong_labels_teach_nothing(spark):
    docs, labels = documents(200)
    kind = "doc_id long, toxic int, quality int"
    frame = spark.createDataFrame(docs + [(None, "blockhead", None, None, None, None, None, None), docs[0], docs[0]], DOCS)
    own = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    more = [(i, 1 - t, q) for i, t, q in labels if zlib.crc32(str(i).encode()) % 3 == 1] + [(None, 1, 1), (5, None, 1), (10**9, 1, 1)]
    one = sorted(map(tuple, toxicity.digest(frame, spark.createDataFrame(own, kind)).collect()), key=str)
    two = sorted(map(tuple, toxicity.digest(frame.repartition(7), spark.createDataFrame(own + more, kind)).collect()), key=str)
    assert one == two and len(one) == 203


def test_without_labels_of_both_kinds(spark):
    docs, labels = documents(30)
    frame, kind = spark.createDataFrame(docs, DOCS), "doc_id long, toxic int, quality int"
    assert {r["score"] for r in toxicity.digest(frame, spark.createDataFrame([], kind)).collect()} == {0.0}
    ones = toxicity.digest(frame, spark.createDataFrame([(i, 1, 1) for i, *_ in labels], kind)).collect()
    assert {r["score"] for r in ones} == {1.0}
    assert toxicity.digest(frame.limit(0), spark.createDataFrame(labels, kind)).collect() == []
