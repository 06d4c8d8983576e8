"""Collocations against plain counting."""

import collections
import random
import re

import pytest

from shelfmark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, k int, phrase string, n long"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rng, out = random.Random(4), []
    vocabulary = ["the", "The", "of", "new", "york", "state", "É", "é", "x\x0bx", "to", "be", "\x00", "a\x1cb"] + [f"w{i}" for i in range(60)]
    for i in range(240):
        words = rng.choices(vocabulary, weights=[12, 3, 9, 4, 4, 4, 2, 2, 1, 5, 5, 1, 1] + [0.7] * 60, k=rng.randint(1, 60))
        for at in range(len(words) - 4):
            if rng.random() < 0.06:
                words[at : at + 4] = ["new", "york", "state", "of"][: rng.randint(2, 4)] + words[at : at + 4][rng.randint(2, 4) :]
        text = "".join(w + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", "\n", ",", "?! "]) for w in words)
        out.append((i, text, rng.choice(["en", "en", "fr", None, "und"]), 1, "p", 2))
    out += [(900, None, "en", 1, "p", 2), (901, "", "en", 1, "p", 2), (902, "to to to to " * 300, "en", 1, "p", 2), (903, ". , ;", "de", 1, "p", 2)]
    out += [(904, "late words come last of all", "fr", 1, "p", 2)] * 35
    return out


def counted(docs, longest):
    out, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UP)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                out.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return out, n


def expected(docs, least, top):
    f, n = counted(docs, 4)
    cands = {p: c for p, c in f.items() if c >= least and " " in p[1]}
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        w = p.split(" ")
        if any(100 * b >= 80 * a and len(v := q.split(" ")) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (other, q), b in cands.items() if other == lang):
            continue
        cuts = [(2000000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("least,shards,top", [(30, 3, 2000), (12, 4, 7), (5, 2, 2000)])
def test_equals_plain_counting(spark, least, shards, top):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = phrases.collocations(docs, least=least, shards=shards, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = list(map(tuple, got.collect()))
    assert set(found) == expected(rows(), least, top) and len(found) == len(set(found)) > 0


def test_slices_of_long_texts_keep_words_and_phrases(monkeypatch):
    text = " ".join(f"w{i}{'.' * (i % 7 == 0)}" for i in range(500)).encode() + b"  end" + b"x" * 200
    whole = phrases.Block()
    whole.add(text)
    monkeypatch.setattr(phrases, "SLICE", 50)
    cut = phrases.Block()
    cut.add(text)
    assert cut.tokens == whole.tokens and list(cut.numbers) == list(whole.numbers)


def test_full_fields_change_nothing(spark, monkeypatch):
    """Where the bit fields let everything pass, the joins decide alone."""
    plain = {(w, c) for w, c in counted(rows(), 3)[0].items() if c >= 9}
    docs = spark.createDataFrame(rows(), SCHEMA)

    def full(self, frequent, scan, count):
        fields = [phrases.Field(8), phrases.Field(8)]
        for field in fields:
            field.bits[:] = 255
        return fields

    for after in (phrases.Fields.after, full):
        monkeypatch.setattr(phrases.Fields, "after", after)
        found, words = phrases.frequent_phrases(docs, least=9, longest=3)
        assert {((r["lang"], r["phrase"]), r["count"]) for r in found.collect()} == plain
        assert {r["lang"]: r["n"] for r in words.collect()} == {k: v for k, v in counted(rows(), 1)[1].items() if k != "de"} | {"de": 0}


def test_small_fields_that_are_made_anew_and_joins_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_FIELD", 5)
    monkeypatch.setattr(phrases, "SMALL_ROWS", 0)
    found, _ = phrases.frequent_phrases(spark.createDataFrame(rows(), SCHEMA), least=9, longest=3)
    assert {((r["lang"], r["phrase"]), r["count"]) for r in found.collect()} == {(w, c) for w, c in counted(rows(), 3)[0].items() if c >= 9}


def test_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
