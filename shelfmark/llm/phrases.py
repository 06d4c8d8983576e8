"""Phrase collocations, mined by dynamic itemset counting.

Documents are dealt to a few shards, which are scanned in a circle. All lengths are counted side by side: single
words from the first scan on, a longer phrase from the scan after both its subphrases (all words but the last, all but
the first) have reached the threshold, and each phrase for one whole circle from there, so its count is exact.
A phrase occurs no more often than its subphrases, hence every phrase that reaches the threshold is found.

The shards hold numbered words in blocks. A scan counts a block's active phrases in arrays and asks two bit
fields which phrases are frequent; the fields let a few others pass, which an exact join with the frequent
phrases then removes. Counts of open phrases are one Spark table, rewritten by each scan; closed ones that
stay below the threshold are dropped. The fields' size is bounded: beyond it more passes, and the join decides.

Words: texts in lower case (A-Z only) are split at ``.,;:!?`` and line ends into pieces, and these at blanks and tabs.
Phrases stay within pieces and languages. A candidate is cut in two where its score ``floor(2000000 * a / (l + r))`` is
lowest; candidates inside longer ones with at least four fifths of their count are dropped; each language keeps its best.

Defined results: a null text counts as empty, a null language as ``und``; repeated rows count each; ties go to the more
frequent phrase, then to the first in byte order; texts of any length are read whole, in slices; an empty table gives no
phrases. Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from shelfmark.llm.common import SMALL_ROWS, Numbers, if_small, slices, utf8
from shelfmark.runtime import forget, stash

SHARDS = 3
LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
#: A longer candidate with so many hundredths of a phrase's count covers the phrase.
COVERS = 80
#: Upper and lower bound of a bit field's size, in powers of two.
LARGEST_FIELD, LEAST_FIELD = 27, 16
#: Words that a task holds in its open blocks, and those of one block.
BLOCK_WORDS, LONGEST_BLOCK = 3 << 20, 1 << 20
SLICE = 1 << 20
#: Capitals to small letters, signs between pieces to one mark (a blank on both sides makes it a word of its own), tabs to blanks.
MARK = b"."
PREPARED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class Block:
    """Numbered words of some documents of one language; 0 stands between pieces."""

    def __init__(self):
        self.numbers = Numbers()
        self.numbers[MARK] = 0
        self.tokens = array("i", [0])

    def add(self, text: bytes) -> int:
        before, at, text = len(self.tokens), 0, text.translate(PREPARED)
        while at < len(text):
            # a slice ends at a blank, so words stay whole, and phrases go on in the next slice
            end = len(text) if at + SLICE >= len(text) else text.find(b" ", at + SLICE)
            end = len(text) if end < 0 else end
            self.tokens.extend(map(self.numbers.__getitem__, text[at:end].replace(MARK, b" . ").split()))
            at = end
        self.tokens.append(0)
        return len(self.tokens) - before

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        words = pa.array(list(self.numbers)[1:], pa.binary()).cast(pa.string())
        tokens = np.frombuffer(self.tokens, np.int32)
        columns = [pa.array([shard], pa.int32()), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([tokens.tobytes()], pa.binary()), pa.array([int(np.count_nonzero(tokens))], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "words", "tokens", "n"])


def write_blocks(docs: DataFrame, shards: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents as blocks ``lang, words, tokens, n``, in a table with a folder for each ``shard``. A task holds ``BLOCK_WORDS`` words, and what a text has beyond.

    A task deals whole blocks to the shards in turn, not single documents: fewer and longer blocks repeat fewer phrases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, Block] = {}
        held, turn = 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if not text:
                    continue
                held += open_blocks.setdefault(lang, Block()).add(text)
                full = lang if len(open_blocks[lang].tokens) >= LONGEST_BLOCK else None
                while full is not None or held >= BLOCK_WORDS:
                    full = full if full is not None else max(open_blocks, key=lambda k: len(open_blocks[k].tokens))
                    yield open_blocks.pop(full).row(turn % shards, full)
                    held, turn, full = sum(len(b.tokens) for b in open_blocks.values()), turn + 1, None
        for key, block in open_blocks.items():
            yield block.row(turn % shards, key)

    blocks = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "shard int, lang string, words array<string>, tokens binary, n long")
    return stash(blocks, partition_by="shard")


def _mixed(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are longer by a word."""
    with np.errstate(over="ignore"):
        out = (state * MIX) + words
        out ^= out >> STEP
        return out * MIX


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _start(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode())], np.uint64)


class Field:
    """A set of hashes as bits; it may hold more than was put in, never less."""

    def __init__(self, power: int):
        self.power, self.bits = power, np.zeros(1 << (power - 3), np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.power)
        return ((self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


class Fields:
    """The fields of all frequent phrases and of those that became so in the last scans; a scan adds its new phrases alone.

    Spark gathers the bits, whose number is bounded. Where the phrases have outgrown the fields, these are made anew.
    """

    def __init__(self, shards: int, longest: int):
        self.shards, self.longest, self.power = shards, longest, 0
        self.by_scan: dict[int, np.ndarray] = {}
        self.older: np.ndarray | None = None

    def after(self, frequent: DataFrame, scan: int, count: int) -> list[Field]:
        """Both fields once ``scan`` has ended; ``frequent`` has ``lang, phrase, k, since``, ``count`` is its size."""
        power = min(LARGEST_FIELD, max(LEAST_FIELD, (64 * count).bit_length()))
        if not self.power or count > (1 << self.power) // 16 and power > self.power:
            self.power, self.by_scan, self.older = power, {}, np.zeros(1 << (power - 3), np.uint8)
            first = 0
        else:
            first = scan
        wanted = frequent.where((F.col("k") < self.longest) & (F.col("since") >= first))
        for since, bits in _bits(wanted, self.power).items():
            self.by_scan[since] = bits
        for since in [k for k in self.by_scan if k <= scan - self.shards]:
            self.older |= self.by_scan.pop(since)
        recent, everything = Field(self.power), Field(self.power)
        for bits in self.by_scan.values():
            recent.bits |= bits
        everything.bits = self.older | recent.bits
        return [everything, recent]


def _bits(phrases: DataFrame, power: int) -> dict[int, np.ndarray]:
    """For each scan the bits of the phrases that it made frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=20000):
            places = np.zeros(batch.num_rows, np.uint64)
            for k, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)):
                state = _start(lang)
                for h in _word_hashes(phrase.split(b" ")):
                    state = _mixed(state, h)
                places[k] = state[0] >> np.uint64(64 - power)
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), batch.column(2)], names=["place", "since"])

    bits = phrases.select("lang", "phrase", "since").mapInArrow(run, "place long, since int")
    bit = F.expr("shiftleft(1, cast(place % 8 as int))")
    found = bits.groupBy(F.floor(F.col("place") / 8).alias("byte"), "since").agg(F.bit_or(bit).alias("bits")).toArrow()
    at, since, values = (found.column(c).to_numpy() for c in ("byte", "since", "bits"))
    out = {}
    for scan in np.unique(since).tolist():
        out[scan] = np.zeros(1 << (power - 3), np.uint8)
        out[scan][at[since == scan]] = values[since == scan].astype(np.uint8)
    return out


def count_block(lang: str, words: pa.Array, tokens: np.ndarray, fields: list[Field] | None, single: bool, longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """The block's phrases that are counted now: length, phrases, counts."""
    if single:
        yield 1, words, np.bincount(tokens, minlength=len(words) + 1)[1:]
    if not fields:
        return
    everything, recent = fields
    hashes = np.concatenate([np.zeros(1, np.uint64), _word_hashes(utf8(words))])
    state = _mixed(_start(lang), hashes)[tokens]
    known = everything.has(state) & (tokens > 0)
    new = known & recent.has(state)
    ids, spelled = tokens.astype(np.int64) - 1, words
    for length in range(2, longest + 1):
        if len(tokens) < length:
            return
        counted = known[:-1] & known[1:] & (new[:-1] | new[1:])
        state = _mixed(state[:-1], hashes[tokens[length - 1 :]])
        inside = known[:-1] & known[1:]  # a frequent phrase's subphrases are frequent
        now = inside & everything.has(state)
        at = np.flatnonzero(counted | now)
        keys, place = np.unique((ids[at] << 32) | tokens[at + length - 1], return_inverse=True)
        spelled = pc.binary_join_element_wise(spelled.take(pa.array(keys >> 32)), words.take(pa.array((keys & 0xFFFFFFFF) - 1)), " ")
        counts = np.bincount(place[counted[at]], minlength=len(keys))
        ids = np.full(len(counted), -1)
        ids[at] = place
        known, new = now, now & recent.has(state)
        if len(emitted := np.flatnonzero(counts)):
            yield length, spelled.take(pa.array(emitted)), counts[emitted]


def _scan(blocks: DataFrame, fields: list[Field] | None, single: bool, longest: int) -> tuple[DataFrame, object]:
    """Rows ``lang, phrase, k, new`` of one shard: occurrences of active phrases, summed for each block."""
    shared = blocks.sparkSession.sparkContext.broadcast(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, tokens = batch.column(0)[row].as_py(), np.frombuffer(batch.column(2)[row].as_py(), np.int32)
                for k, phrases, counts in count_block(lang, batch.column(1)[row].values, tokens, shared.value, single, longest):
                    out = pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int64))), phrases, pa.array(np.full(len(counts), k, np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "k", "new"])
                    for at in range(0, len(counts), 20000):
                        yield out.slice(at, 20000)

    return blocks.select("lang", "words", "tokens").mapInArrow(run, "lang string, phrase string, k int, new long"), shared


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``least`` times: ``lang, phrase, k, count``; and the words of each language: ``lang, n``."""
    blocks = write_blocks(docs, shards, text_col, lang_col)
    words = stash(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
    closed: list[DataFrame] = []
    still: DataFrame | None = None
    frequent: DataFrame | None = None
    fields: list[Field] | None = None
    gathered, scan, count = Fields(shards, longest), 0, 0
    while True:
        fresh, shared = _scan(blocks.where(F.col("shard") == scan % shards), fields, scan < shards, longest)
        rows = fresh.select("lang", "phrase", "k", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("since"), F.lit(0).cast("long").alias("count"), "new")
        if still is not None:
            rows = rows.unionByName(still.where("not closed").drop("closed").withColumn("new", F.lit(0).cast("long")))
        # dealt first: a task's rows hardly repeat, so summing them before they are dealt would cost and spare nothing
        summed = rows.repartition("lang", "phrase").groupBy("lang", "phrase", "k").agg(F.max("start").alias("start"), F.max("since").alias("since"), F.sum("count").alias("count"), F.sum("new").alias("new"))
        if frequent is not None:
            # a phrase starts when both its subphrases have; where that is known the key finds nothing (and, in a shuffle, is one that no phrase has, so these rows don't meet in one task)
            asked = F.col("start").isNull() & (F.col("k") > 1)
            small = count <= SMALL_ROWS
            own = F.lit(None).cast("string") if small else F.concat(F.lit("\n"), F.col("phrase"))
            head = F.expr("substr(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)")
            tail = F.expr("substr(phrase, instr(phrase, ' ') + 1)")
            for name, part in (("first", head), ("last", tail)):
                found = frequent.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("since").alias(f"_{name}"))
                found = F.broadcast(found) if small else found
                keyed = summed.withColumn("_key", F.when(asked, part).otherwise(own))
                summed = keyed.join(found, (F.col("lang") == F.col("_lang")) & (F.col("_key") == F.col("_part")), "left").drop("_lang", "_part", "_key")
            begun = F.when(F.col("_first").isNotNull() & F.col("_last").isNotNull(), F.greatest("_first", "_last"))
            summed = summed.withColumn("start", F.coalesce("start", F.when(F.col("k") == 1, F.lit(-1)).otherwise(begun))).drop("_first", "_last")
        else:
            summed = summed.withColumn("start", F.when(F.col("k") == 1, F.lit(-1)))
        active = summed.where(F.col("start") + shards >= scan).withColumn("count", F.col("count") + F.col("new")).drop("new")
        since = F.coalesce(F.col("since"), F.when(F.col("count") >= least, F.lit(scan)))
        after = active.withColumn("since", since).withColumn("closed", F.col("start") + shards == scan).where("not closed or since is not null")
        last, still = still, stash(after, partition_by="closed")
        done = stash(still.where("closed").select("lang", "phrase", "k", "since", "count"))
        shared.destroy()
        closed.append(done)
        if last is not None:
            forget(last)
        if frequent is not None:
            forget(frequent)
        scan += 1
        found = still.where("not closed and since is not null").select("lang", "phrase", "k", "since")
        for table in closed:
            found = found.unionByName(table.select("lang", "phrase", "k", "since"))
        frequent = stash(found)
        count, waiting = frequent.agg(F.count("*"), F.count_if((F.col("since") >= scan - shards) & (F.col("k") < longest))).first()
        if scan >= shards and not waiting:
            break
        fields = gathered.after(frequent, scan - 1, count) if count else None
    forget(still)
    forget(frequent)
    forget(blocks)
    found = closed[0]
    for table in closed[1:]:
        found = found.unionByName(table)
    return found.select("lang", "phrase", "k", "count"), words


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    counts, totals = frequent_phrases(docs, least, longest, shards, text_col, lang_col)
    found = stash(counts)
    wide = lambda c: c.cast("decimal(38,0)")
    part = lambda name: if_small(found.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("count").alias(name)))
    words = F.split("phrase", " ")
    long_ones = found.where("k > 1").select("lang", "phrase", "k", F.col("count").alias("a"))
    cuts = long_ones.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    for name, piece in (("l", F.slice(words, F.lit(1), F.col("cut"))), ("r", F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")))):
        cuts = cuts.withColumn("_piece", F.array_join(piece, " ")).join(part(name), (F.col("lang") == F.col("_lang")) & (F.col("_piece") == F.col("_part"))).drop("_lang", "_part", "_piece")
    scored = cuts.withColumn("_a", wide(F.col("a"))).withColumn("_lr", wide(F.col("l")) + wide(F.col("r"))).withColumn("score", F.expr(f"cast({SCALE} as decimal(10,0)) * cast(_a as decimal(20,0)) div _lr"))
    lowest = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "k", "a", "best.score", "best.l", "best.r")
    # the largest count of a longer candidate around each phrase
    spans = F.expr("flatten(transform(sequence(2, k - 1), w -> transform(sequence(1, k - w + 1), b -> array_join(slice(split(phrase, ' '), b, w), ' '))))")
    around = long_ones.where("k > 2").select(F.col("lang").alias("_lang"), F.explode(spans).alias("_part"), F.col("a").alias("around")).groupBy("_lang", "_part").agg(F.max("around").alias("around"))
    kept = lowest.join(around, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")), "left").where(F.col("around").isNull() | (F.lit(100) * wide(F.col("around")) < F.lit(COVERS) * wide(F.col("a"))))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()))
    best = kept.select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def oracle() -> str:
    """SQL for ``collocations`` over ``documents``."""
    grams = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {k - 1} + 1), lambda i: array_to_string(w[i : i + {k - 1}], ' '))) AS phrase, {k} AS k FROM pieces WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))
    return f"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
        cut AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts),
        pieces AS (SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w FROM cut),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        f AS (SELECT lang, phrase, k, count(*) AS c FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
        cand AS (SELECT lang, phrase, k, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cuts AS (SELECT *, unnest(range(1, k)) AS place FROM cand),
        scored AS (SELECT c.lang, c.phrase, c.a, c.place, x.c AS l, y.c AS r, ({SCALE}::HUGEINT * c.a // (x.c::HUGEINT + y.c))::BIGINT AS score FROM cuts c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.place], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.place + 1 :], ' ')),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
        sizes AS (SELECT *, unnest(range(2, k)) AS size FROM cand WHERE k > 2),
        inner_ones AS (SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda b: array_to_string(w[b : b + size - 1], ' '))) AS phrase FROM sizes),
        around AS (SELECT lang, phrase, max(a) AS most FROM inner_ones GROUP BY ALL),
        kept AS (SELECT s.* FROM lowest s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.most IS NULL OR 100::HUGEINT * o.most < {COVERS}::HUGEINT * s.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
        QUALIFY rank <= {TOP}"""
