"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (e-mail and IP addresses, card and phone numbers) and secrets (long runs of
hexadecimal digits and letters) are found by pattern and seed the extraction. Each place has two
lexical patterns: the two words before it, and the word before it with the place's own shape, in
which runs of digits and of letters shrink to one sign; words are lower-cased, within 80 code
points. Spark scores the bipartite graph of patterns and instances iteratively: a pattern scores
the mean score of its distinct instances, an instance the square of the best score of its patterns,
seeds staying at 1 for their own kind and 0 for others. Patterns of high score, each with enough
distinct seeds, then label unseen identifiers: tokens with a digit or an at sign in the same context.

Spans are ``(start, end, kind)`` in code points, the end exclusive. Matches of a kind are
leftmost and do not overlap; those of different kinds may. Where a pattern repeats a
group, single-character placeholders stand for the inner separators, so that matching
never recurses and stays linear in the text.

Defined results: a null text is empty; without seeds nothing is added; a found token or secret
that overlaps a base span is dropped, as is a token that overlaps a secret; repeated rows each get
their spans; an empty table gives an empty result. A column named ``base`` or ``spans``, or whose name begins
with ``_pii``, comes back as ``in_`` and its name; ``redact`` returns all columns under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import ascii_lower, hot_keys, making_room, spread_join
from shelfmark.runtime import stash

KINDS = ("email", "ip", "card", "phone")
#: The method's own seeds, beside the base.
SECRET = "secret"
HEX = r"(?<![0-9A-Za-z])(?=[0-9a-f]*+(?![0-9A-Za-z]))(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,}"
ROUNDS = 3
LEAST_SCORE = 0.8
LEAST_SEEDS = 3
#: A private character that stands for an inner separator; where texts have it themselves, a blank takes its place first.
INNER = ""
LOCAL = "A-Za-z0-9._%+\\-" + INNER
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++{INNER}[A-Za-z0-9{INNER}-]+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
CARD = f"[0-9][0-9{INNER}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run without white space that holds a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*"
#: Code points before a token that its context may take.
REACH = 80
EDGES = r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$"


SPANS = "array<struct<start:int,end:int,kind:string,value:string,left:string>>"


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(sizes: Column) -> Column:
    """Running totals of an array, by doubling: each step adds the totals that lie twice as far back."""
    shifts = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(2), F.size(sizes)))).cast("int") - 1), lambda i: F.call_function("shiftleft", F.lit(1), i))
    return F.aggregate(shifts, sizes, lambda a, x: F.zip_with(a, F.concat(F.array_repeat(F.lit(0), x), F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - x))), lambda one, two: one + F.coalesce(two, F.lit(0))))


def _places(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches, with the matched text and up to ``REACH`` code points before it, back to the last match's begin at most."""
    tail = lambda x: F.right(x, F.lit(REACH))

    def spans(found: Column, gaps: Column) -> Column:
        ends = F.when(F.size(found) > 1, _with(F.zip_with(gaps, found, lambda g, h: F.length(g) + F.length(h)), _running)).otherwise(F.zip_with(gaps, found, lambda g, h: F.length(g) + F.length(h)))
        before = F.zip_with(F.concat(F.array(F.lit("")), F.slice(found, 1, F.greatest(F.lit(0), F.size(found) - 1))), gaps, lambda h, g: tail(F.concat(tail(h), tail(g))))
        both = F.zip_with(found, before, lambda h, x: F.struct(h.alias("h"), x.alias("x")))
        return F.zip_with(ends, both, lambda e, p: F.struct((e - F.length(p["h"])).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), p["h"].alias("value"), p["x"].alias("left")))

    def some(found: Column) -> Column:
        return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda gaps: spans(found, gaps)))

    return _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda d: d != "")), lambda d, i: (d.cast("int") * (1 + i % 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _base(text: Column, kind: str) -> Column:
    if kind == "email":
        plain = F.regexp_replace(F.translate(text, INNER, " "), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", INNER)
        spans = F.transform(_with(plain, lambda x: _places(x, EMAIL, kind)), lambda s: s.withField("value", F.translate(s["value"], INNER, ".")).withField("left", F.translate(s["left"], INNER, ".")))
        return spans, F.contains(text, F.lit("@"))
    if kind == "ip":
        good = lambda s: s["value"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
        return F.filter(_places(text, IP, kind), good), text.rlike(r"[0-9]\.[0-9]")
    if kind == "card":
        joined = F.regexp_replace(F.translate(text, INNER, "x"), r"(?<=[0-9])[\x20-](?=[0-9])", INNER)
        bare = lambda s: F.translate(s["value"], INNER, "")
        long_enough = F.filter(_with(joined, lambda x: _places(x, CARD, kind)), lambda s: F.length(bare(s)).between(12, 19))
        return F.filter(F.transform(long_enough, lambda s: s.withField("value", bare(s)).withField("left", F.translate(s["left"], INNER, " "))), lambda s: _luhn(s["value"])), text.rlike("[0-9]")
    if kind == SECRET:
        return _places(text, HEX, kind), text.rlike("[0-9a-f]{32}")
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    return F.filter(_places(text, PHONE, kind), lambda s: digits(s).between(9, 15)), F.contains(text, F.lit("+"))


def seeds(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_pii_<kind>``, the base spans of each kind, and ``_pii_secret``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs
    for kind in (*KINDS, SECRET):
        spans, possible = _base(text, kind)
        out = out.withColumn(f"_pii_{kind}", F.when(possible, spans).otherwise(F.array().cast(SPANS)))
    return out


def contexts(marked: DataFrame) -> DataFrame:
    """Rows ``_pii_row, context, value, kind, start, end``: two contexts for each seed and each token with a digit or an at sign.

    ``kind`` is null for tokens that don't begin where a seed does. Only places leave this step's tasks, never texts.
    """
    lead = F.length(F.regexp_extract("p.value", r"^[\"'(\[{<]*", 0))
    tokens = marked.select("_pii_row", F.explode("_pii_tokens").alias("p")).select("_pii_row", (F.col("p.start") + lead).alias("start"), F.regexp_replace("p.value", EDGES, "").alias("value"), F.lit(None).cast("string").alias("kind"), F.col("p.left").alias("left"))
    known = marked.select("_pii_row", F.explode(F.concat("_pii_all", f"_pii_{SECRET}")).alias("p")).select("_pii_row", "p.start", "p.value", "p.kind", "p.left")
    places = tokens.where("length(value) > 0").unionByName(known).groupBy("_pii_row", "start").agg(F.min(F.struct(F.col("kind").isNull().alias("none"), "kind", "value", "left")).alias("p")).select("_pii_row", "start", "p.kind", "p.value", "p.left")
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(ascii_lower("left"), r"[^\S\n]*[\"'(\[{<]+$", " "), r"\s+", " ")), " ")
    words = F.filter(words, lambda w: w != "")
    last = lambda n: F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), F.lit(n)), " ")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]{10,}", "#"), "[0-9]+", "0"), r"\p{L}+", "a")
    both = F.filter(F.array(last(2), F.when(F.size(words) > 0, F.concat_ws("\n", last(1), shape))), lambda c: c.isNotNull() & (c != ""))
    return places.select("_pii_row", F.explode(both).alias("context"), "value", "kind", "start", (F.col("start") + F.length("value")).alias("end"))


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """Rows ``context, as``: the contexts whose pattern-instance score is high, with their kind."""
    edges = stash(found.groupBy("context", "value").agg(F.min("kind").alias("seed")))
    counted = edges.where("seed is not null").groupBy("context", "seed").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
    patterns = stash(counted.groupBy("context").agg(F.max(F.struct("seeds", "seed")).alias("best")).select("context", F.col("best.seed").alias("kind")))
    # only instances in a seeded context can score
    graph = stash(spread_join(edges, patterns, ["context"], hot_keys(edges, ["context"])))
    by_value, by_context = hot_keys(graph, ["value", "kind"]), hot_keys(graph, ["context", "kind"])
    own, other = F.col("seed") == F.col("kind"), F.col("seed").isNotNull()
    instance = graph.groupBy("value", "kind").agg(F.max(F.when(own, 1.0).otherwise(0.0)).alias("score"))
    pattern = None
    for _ in range(rounds):
        pattern = stash(spread_join(graph, instance, ["value", "kind"], by_value).groupBy("context", "kind").agg(F.avg(F.when(own, 1.0).when(other, 0.0).otherwise(F.col("score"))).alias("p")))
        instance = spread_join(graph, pattern, ["context", "kind"], by_context).groupBy("value", "kind").agg(F.max(F.when(own, 1.0).otherwise(F.col("p") * F.col("p"))).alias("score"))
    return pattern.where(F.col("p") >= least_score).select("context", F.col("kind").alias("as"))


def extract(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns with ``base`` and ``spans``: arrays of (start, end, kind), in order."""
    docs, own = making_room(docs, "base spans", "_pii")
    carry, text_col = [own[c] for c in (carry if carry is not None else own)], own[text_col]
    marked = seeds(docs.select(*dict.fromkeys([*carry, text_col])).withColumn("_pii_row", F.monotonically_increasing_id()), text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = F.when(text.rlike("[0-9@]"), _places(text, TOKEN, "")).otherwise(F.array().cast(SPANS))
    everything = F.concat(*[F.col(f"_pii_{k}") for k in KINDS])
    marked = stash(marked.withColumn("_pii_all", everything).withColumn("_pii_tokens", tokens).select(*carry, "_pii_row", "_pii_all", f"_pii_{SECRET}", "_pii_tokens"))
    found = stash(contexts(marked))
    unknown = found.where("kind is null")
    fresh = spread_join(unknown, trusted_patterns(found), ["context"], hot_keys(unknown, ["context"])).groupBy("_pii_row", "start", "end").agg(F.min("as").alias("kind"))
    fresh = fresh.groupBy("_pii_row").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind")).alias("_pii_found"))
    rank = lambda s: F.struct(s["start"].alias("start"), F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), F.lit(0)), F.lit(len(KINDS) + 1)).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    ordered = lambda a: F.transform(F.array_sort(F.transform(a, rank)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    short = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    free = lambda a, of: F.filter(a, lambda s: ~F.exists(of, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    joined = marked.drop("_pii_tokens").join(fresh, "_pii_row", "left").withColumn("_pii_base", ordered(short("_pii_all"))).withColumn("_pii_own", short(free(F.col(f"_pii_{SECRET}"), F.col("_pii_all"))))
    more = free(free(F.coalesce("_pii_found", nothing), F.col("_pii_base")), F.col("_pii_own"))
    return joined.select(*carry, F.col("_pii_base").alias("base"), ordered(F.concat("_pii_base", "_pii_own", more)).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(extracted: DataFrame) -> DataFrame:
    named = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(named, lambda s: s == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    return extracted.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    found, own = extract(docs, text_col), making_room(docs, "base spans", "_pii")[1]
    text = F.col(own[text_col])
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    done = F.aggregate("spans", empty, step)
    clean = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return found.withColumn(own[text_col], clean).select(*own.values()).toDF(*docs.columns)
