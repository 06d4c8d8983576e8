"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best fit: a fixed number of bins stays open, indexed by a bitset
over free space. A piece goes to the open bin that it leaves fullest; if none has room
and all bins are in use, the fullest bin closes and a new one opens.

Defined results: a null text is an empty one and yields the closing id alone; a document
of at most ``capacity`` ids is never cut; repeated rows are packed once each, and equal
rows may swap their places. An empty table gives an empty result. Other columns of the
input are ignored, so clashing names can't occur.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.common import Numbers, slices, utf8

CAPACITY = 4096
OPEN_BINS = 128
CLOSING_ID = 1
ROWS_A_TASK = 40_000
CACHED_WORDS = 400_000
#: Characters for which Python and the tokenizer agree on normal form, case and class: a text of others goes to the tokenizer whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-įı-ňŊ-ſ–—‘’“”…€]*")
#: Letters of PLAIN in lower case, and runs of letters or of others.
LETTERS = "a-zªµºß-öø-ſ"
WORD, RUNS = re.compile(f"[{LETTERS}]+"), re.compile(f"[{LETTERS}]+|[^{LETTERS}]+")
SPECIAL = "<|"
GAP = "\x02"


class WordIds:
    """Token ids of whole texts, one white-space word at a time.

    The tokenizer treats words on their own, and within them runs of letters and of others (but
    for apostrophes, which it takes with letters). So each distinct word is encoded once: its ids
    lie in one array, and a text's ids are taken from there by its words' numbers. The store is
    emptied when it is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.gap = self.whole.encode(GAP, add_special_tokens=False).ids
        assert len(self.gap) == 1
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.flat, self.starts, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, words: list[str], a_text: int, between: str) -> np.ndarray:
        parts = [between.join(words[at : at + a_text]) for at in range(0, len(words), a_text)]
        return np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, dtype="<u4") for e in self.whole.encode_batch_fast(parts, add_special_tokens=False))])

    def _keep(self, numbers: list[int], ids: np.ndarray, lengths: np.ndarray) -> None:
        assert len(lengths) == len(numbers) and lengths.sum() == len(ids)
        self.starts[numbers], self.lengths[numbers] = len(self.flat) + np.cumsum(lengths) - lengths, lengths
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self) -> None:
        number, letters, odd, mixed = self.number, [], [], []
        for word in number.fresh:  # runs within mixed words join the list as it is read
            if WORD.fullmatch(word):
                letters.append(word)
            elif "'" in word or len(runs := RUNS.findall(word)) == 1:
                odd.append(word)
            else:
                mixed.append((number[word], [number[run] for run in runs]))
        number.taken()
        grown = len(number) - len(self.starts)
        self.starts, self.lengths = (np.concatenate([x, np.zeros(grown, np.int64)]) for x in (self.starts, self.lengths))
        ids = self._encoded(letters, 1024, " ")
        self._keep([number[w] for w in letters], ids, np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0))
        for at in range(0, len(odd), 64):
            ids = np.append(self._encoded(odd[at : at + 64], 64, f" {GAP} "), np.array(self.gap, "<u4"))
            ends = np.flatnonzero(ids == self.gap[0])
            self._keep([number[w] for w in odd[at : at + 64]], ids[ids != self.gap[0]], np.diff(ends, prepend=-1) - 1)
        if mixed:
            runs = np.array([run for _, runs in mixed for run in runs])
            sizes = np.add.reduceat(self.lengths[runs], np.cumsum([0, *(len(runs) for _, runs in mixed[:-1])]))
            self._keep([word for word, _ in mixed], self._taken(runs), sizes)

    def _taken(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.number) > CACHED_WORDS:
            self.clear()
        get, out = self.number.__getitem__, [b""] * len(texts)
        simple, numbers, sizes = [], [], []
        for k, text in enumerate(texts):
            if SPECIAL in text or not PLAIN.fullmatch(text):
                out[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                words = text.lower().split()
                simple.append(k)
                sizes.append(len(words))
                numbers.append(np.fromiter(map(get, words), np.int64, len(words)))
        if self.number.fresh:
            self._learn()
        own = np.concatenate([np.zeros(0, np.int64), *numbers])
        ids = self._taken(own).tobytes()
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths[own])])[np.cumsum([0, *sizes])] * 4
        for k, a, b in zip(simple, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out


_ENCODERS: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, with_ids: bool, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordIds(path)
        encoder = _ENCODERS[path]
        if len(encoder.last) > 1 << 8 * id_bytes:
            raise ValueError(f"ids of {path} need more than {id_bytes} bytes")
        closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
        try:
            for batch in slices(batches, rows=256):
                keys, out = batch.column(0).to_pylist(), {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                texts = [b.decode() if b else "" for b in utf8(batch.column(1))]
                for key, ids in zip(keys, encoder.encode(texts), strict=True):
                    ids += closing
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for name, value in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(f"<u{id_bytes}").tobytes() if with_ids else None), strict=True):
                            out[name].append(value)
                arrays = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                if not with_ids:
                    out.pop("ids")
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), arrays, strict=False)], names=list(out))
        finally:
            encoder.clear()  # between tasks a worker keeps the tokenizer alone

    return run


def tokenise(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True, id_bytes: int = 4) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32[, ids]``: each document's ids, cut at ``capacity``.

    ``ids`` holds little-endian unsigned ids of ``id_bytes``; ``ids_crc32`` is that of 32-bit ones in any case.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer, capacity, with_ids, id_bytes), schema)


class OpenBins:
    """At most ``most`` bins, found by free space through a bitset."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.bits = capacity, most, 0, 0
        self.by_room: dict[int, list[int]] = {}
        self.begun = 0

    def _take(self, room: int) -> int:
        stack = self.by_room[room]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << room)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the piece's offset in it."""
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_, room = self.begun, self.capacity
            self.begun += 1
        left = room - length
        if left:
            self.by_room.setdefault(left, []).append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - room


def _place(capacity: int, most: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, most), TaskContext.get().partitionId() << 33
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(at).to_pylist()]
            arrays = [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, rows_a_task: int = ROWS_A_TASK, rows: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``.

    Pieces are dealt to tasks by a hash and sorted there, so a task that runs again
    places them alike; each task packs on its own, and the count of tasks follows the
    rows (``rows``, if their number is known about), so that the bins left open at the end stay a small share.
    """
    order = F.xxhash64(*[F.col(c) for c in pieces.columns if c != "ids"])
    tasks = max(1, -(-(pieces.count() if rows is None else rows) // rows_a_task))
    dealt = pieces.withColumn("_deal", order).repartition(tasks, "_deal").sortWithinPartitions("_deal").drop("_deal")
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(_place(capacity, open_bins, dealt.columns.index(length_col)), schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False, id_bytes: int = 4) -> DataFrame:
    """Tokenise, cut and pack documents; the pieces go straight from tokenising to their task."""
    return pack(tokenise(docs, tokenizer, id_col, text_col, capacity, with_ids, id_bytes), capacity=capacity, open_bins=open_bins, rows=docs.count())


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences themselves, from pieces with ``ids``; a group holds one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
