"""Scalar functions over columns (group F); all stay in the JVM but the colour difference."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from shelfmark.registry import query

#: The accepted time formats.
FORMATS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss")


def parse_time(text) -> Column:
    """A timestamp from the first 19 characters in any accepted format, else null."""
    head = F.substring(text, 1, 19)
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)) for f in FORMATS])


def exif_date(text) -> Column:
    return F.translate(text, "-T", ": ")


def shown_date(ts) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm")


def season(ts) -> Column:
    """Season with its year; December belongs to the next year's winter."""
    m = F.month(ts)
    name = F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "spring").when(m <= 8, "summer").otherwise("autumn")
    return F.concat_ws("-", (F.year(ts) + F.when(m == 12, 1).otherwise(0)).cast("string"), name)


def rational(text) -> Column:
    """Seconds from ``1/250`` or ``0.004``; bad input and a zero denominator give null."""
    parts = F.split(text, "/")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), F.try_divide(number(0), number(1))).otherwise(number(0))


def exposure_value(f_stop, shutter, iso) -> Column:
    f, t, i = (F.col(c) if isinstance(c, str) else c for c in (f_stop, shutter, iso))
    return F.when((f > 0) & (t > 0) & (i > 0), F.log2(f * f / t) - F.log2(i / 100))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Kilometres on a sphere of radius 6371 km."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371.0 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def snap(value, size: float) -> Column:
    """The centre of a grid cell, half to even."""
    return F.bround(F.col(value) / size) * size


def hamming(a, b) -> Column:
    """Differing bits of two 64-bit hashes; 999 if one is missing."""
    return F.when(F.col(a).isNull() | F.col(b).isNull(), 999).otherwise(F.bit_count(F.col(a).bitwiseXOR(F.col(b))))


def hash_bits(hex_text) -> Column:
    """A signed 64-bit number from 16 hexadecimal digits; null if malformed."""
    return F.when(F.col(hex_text).rlike("^[0-9a-fA-F]{16}$"), F.conv(hex_text, 16, -10).cast("bigint"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """The vector over its norm; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def intersection(a, b) -> Column:
    """Shared mass of two histograms, each first brought to sum 1."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    ta, tb = total(a), total(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(F.try_divide(x, ta), F.try_divide(y, tb))), F.lit(0.0), lambda s, x: s + x)


def histogram_stats(h) -> Column:
    """Mean place, spread and the mass in the outer eighths of a histogram."""
    placed = F.transform(h, lambda x, i: F.struct(x.cast("double").alias("w"), i.cast("double").alias("i")))
    total = F.aggregate(placed, F.lit(0.0), lambda s, p: s + p["w"])
    mean = F.try_divide(F.aggregate(placed, F.lit(0.0), lambda s, p: s + p["w"] * p["i"]), total)
    square = F.try_divide(F.aggregate(placed, F.lit(0.0), lambda s, p: s + p["w"] * p["i"] * p["i"]), total)
    edge = F.floor(F.size(h) / 8)
    mass = lambda test: F.try_divide(F.aggregate(F.filter(placed, test), F.lit(0.0), lambda s, p: s + p["w"]), total)
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("spread"), mass(lambda p: p["i"] < edge).alias("shadow"), mass(lambda p: p["i"] >= F.size(h) - edge).alias("highlight"))


def colour_temperature(hue, saturation) -> Column:
    h, s = F.col(hue), F.col(saturation)
    return F.when(s < 0.1, "neutral").when((h < 90) | (h >= 300), "warm").otherwise("cool")


def tags_of(text, most: int | None = None) -> Column:
    """Trimmed distinct tags of a comma list or a JSON array, in order."""
    raw = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    held = F.array_distinct(F.filter(F.transform(raw, lambda t: F.trim(t)), lambda t: t != ""))
    return F.slice(held, 1, most) if most else held


def short_id(*parts) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts])), 1, 12)


def junk_lens(lens) -> Column:
    bare = F.trim(lens)
    return bare.isNull() | (F.length(bare) < 4) | bare.rlike("^[0-9]*$")


def finite(column) -> Column:
    c = F.col(column)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def iso_sharpness(variance, iso) -> Column:
    """Sharpness lifted at high sensitivity: 15 % a stop beyond 800, at most doubled."""
    return F.col(variance) * F.when(F.col(iso) > 800, F.least(F.lit(2.0), 1 + 0.15 * F.log2(F.col(iso) / 800))).otherwise(1.0)


def lead_score(weights: dict[str, float]) -> Column:
    """A weighted sum with missing terms as zero."""
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + F.lit(weight) * F.coalesce(F.col(name), F.lit(0.0))
    return out


def guarded(column, default: float = 0.0, raw_iso: bool = False) -> Column:
    """Numbers outside -100 to 100 become the default; sensitivities are exempt if ``raw_iso``."""
    c = F.col(column).cast("double")
    return F.coalesce(c, F.lit(default)) if raw_iso else F.when(c.between(-100, 100), c).otherwise(F.lit(default))


def age(seconds) -> Column:
    s = F.col(seconds)
    return F.when(s < 60, F.concat(F.floor(s).cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).when(
        s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))
    ).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))


def week_of_year(ts) -> Column:
    """Monday-based week 00 to 53."""
    return F.lpad(F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7).cast("string"), 2, "0")


def colour_difference(lab1: Column, lab2: Column) -> Column:
    """CIEDE2000 difference of two (L, a, b) structs, vectorised in pandas."""
    @F.pandas_udf("double")
    def delta(l1: pd.Series, a1: pd.Series, b1: pd.Series, l2: pd.Series, a2: pd.Series, b2: pd.Series) -> pd.Series:
        return pd.Series(ciede2000(l1.to_numpy(), a1.to_numpy(), b1.to_numpy(), l2.to_numpy(), a2.to_numpy(), b2.to_numpy()))

    return delta(lab1["L"], lab1["a"], lab1["b"], lab2["L"], lab2["a"], lab2["b"])


def ciede2000(l1, a1, b1, l2, a2, b2):
    """The published CIEDE2000 formula over arrays."""
    import numpy as np

    c = (np.hypot(a1, b1) + np.hypot(a2, b2)) / 2
    g = 0.5 * (1 - np.sqrt(c**7 / (c**7 + 25.0**7)))
    a1, a2 = (1 + g) * a1, (1 + g) * a2
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    gray = c1 * c2 == 0
    turn = np.where(gray, 0, (h2 - h1 + 180) % 360 - 180)
    d_l, d_c, d_h = l2 - l1, c2 - c1, 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2))
    l_m, c_m = (l1 + l2) / 2, (c1 + c2) / 2
    h_m = np.where(gray, h1 + h2, np.where(np.abs(h1 - h2) <= 180, (h1 + h2) / 2, np.where(h1 + h2 < 360, (h1 + h2 + 360) / 2, (h1 + h2 - 360) / 2)))
    cos = lambda x: np.cos(np.radians(x))
    t = 1 - 0.17 * cos(h_m - 30) + 0.24 * cos(2 * h_m) + 0.32 * cos(3 * h_m + 6) - 0.20 * cos(4 * h_m - 63)
    s_l = 1 + 0.015 * (l_m - 50) ** 2 / np.sqrt(20 + (l_m - 50) ** 2)
    s_c, s_h = 1 + 0.045 * c_m, 1 + 0.015 * c_m * t
    r_t = -np.sin(np.radians(60 * np.exp(-(((h_m - 275) / 25) ** 2)))) * 2 * np.sqrt(c_m**7 / (c_m**7 + 25.0**7))
    return np.sqrt((d_l / s_l) ** 2 + (d_c / s_c) ** 2 + (d_h / s_h) ** 2 + r_t * (d_c / s_c) * (d_h / s_h))


def srgb_to_lab(r, g, b):
    """CIE Lab (D65) of sRGB values 0 to 255, over arrays."""
    import numpy as np

    rgb = np.stack([np.asarray(x, float) / 255 for x in (r, g, b)])
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    m = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
    xyz = (m @ linear.reshape(3, -1)).reshape(linear.shape) / np.array([0.95047, 1.0, 1.08883]).reshape(3, *[1] * (linear.ndim - 1))
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (24389 / 27 * xyz + 16) / 116)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


@query("f1_parse_time", "SELECT path, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS t FROM shot")
def _(v):
    text = F.when(F.col("path") % 2 == 0, F.date_format("captured_at", "yyyy:MM:dd HH:mm:ss.SSS")).otherwise(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return v.shot.select("path", F.date_format(parse_time(text), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("f2_date_forms", "SELECT path, strftime(date_taken, '%Y:%m:%d') AS exif, strftime(date_taken, '%d/%m/%Y %H:%M') AS shown FROM item")
def _(v):
    return v.item.select("path", exif_date(F.date_format("date_taken", "yyyy-MM-dd")).alias("exif"), shown_date("date_taken").alias("shown"))


@query("f3_season", """SELECT path, (year(date_taken) + CASE WHEN month(date_taken) = 12 THEN 1 ELSE 0 END) || '-' || CASE WHEN month(date_taken) IN (12, 1, 2) THEN 'winter' WHEN month(date_taken) <= 5 THEN 'spring'
  WHEN month(date_taken) <= 8 THEN 'summer' ELSE 'autumn' END AS season FROM item""")
def _(v):
    return v.item.select("path", season("date_taken").alias("season"))


@query("f4_rational", "SELECT path, CASE WHEN ev % 3 = 0 THEN round(1.0::DOUBLE / nullif(ev % 7, 0), 6) WHEN ev % 3 = 1 THEN round(ev / 100.0::DOUBLE, 6) END AS seconds FROM shot")
def _(v):
    text = F.when(F.col("ev") % 3 == 0, F.concat(F.lit("1/"), (F.col("ev") % 7).cast("string"))).when(F.col("ev") % 3 == 1, (F.col("ev") / 100).cast("string")).otherwise("bad")
    return v.shot.select("path", F.round(rational(text), 6).alias("seconds"))


@query("f5_exposure_value", "SELECT path, CASE WHEN aesthetic > 0 AND comp_score > 0 THEN round(log2(aesthetic * aesthetic / comp_score) - log2((100.0 + n_parts) / 100), 4) END AS ev FROM metric")
def _(v):
    return v.metric.select("path", F.round(exposure_value("aesthetic", "comp_score", F.lit(100.0) + F.col("n_parts")), 4).alias("ev"))


@query("f6_haversine", "SELECT path, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS km FROM (SELECT path, pow(sin((radians(lat) - radians(48.9)) / 2), 2) + cos(radians(48.9)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(2.4)) / 2), 2) AS h FROM geo)")
def _(v):
    return v.geo.select("path", F.round(haversine(F.lit(48.9), F.lit(2.4), "lat", "lon"), 3).alias("km"))


@query("f7_grid_snap", "SELECT path, round(round_even(lat / 0.5, 0) * 0.5, 3) AS cell FROM geo")
def _(v):
    return v.geo.select("path", F.round(snap("lat", 0.5), 3).alias("cell"))


@query("f8_hamming", "SELECT path, CASE WHEN a IS NULL THEN 999 ELSE bit_count(xor(a, b)) END::INTEGER AS bits FROM (SELECT path, nullif(path * 7919, 0) AS a, path * 104729 AS b FROM item)")
def _(v):
    rows = v.item.select("path", F.nullif(F.col("path") * 7919, F.lit(0)).alias("a"), (F.col("path") * 104729).alias("b"))
    return rows.select("path", hamming("a", "b").cast("int").alias("bits"))


@query("f9_unit_vector", "SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS size FROM vec")
def _(v):
    return v.vec.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(norm("embedding"), 4).alias("size"))


@query("f10_dominant_dimension", "SELECT vec_id FROM vec WHERE len(embedding) = (SELECT mode(len(embedding)) FROM vec)")
def _(v):
    from shelfmark.operators.similarity import dominant_dimension

    return dominant_dimension(v.vec).select("vec_id")


@query("f11_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1")
def _(v):
    other = v.vec.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return v.vec.join(other, "vec_id").select("vec_id", F.round(cosine("embedding", "o"), 5).alias("cos"))


@query("f12_histogram_intersection", """SELECT path, round(least(a / (a + b), c / (c + d)) + least(b / (a + b), d / (c + d)), 5) AS shared FROM (SELECT path, aesthetic + 1 AS a, exposure + 1 AS b, comp_score + 1 AS c, tech_sharpness + 1 AS d FROM metric)""")
def _(v):
    one = lambda c: F.col(c) + 1
    return v.metric.select("path", F.round(intersection(F.array(one("aesthetic"), one("exposure")), F.array(one("comp_score"), one("tech_sharpness"))), 5).alias("shared"))


@query("f13_histogram_stats", """SELECT path, round((b + 2 * c + 3 * d) / (a + b + c + d), 5) AS mean FROM (SELECT path, aesthetic + 1 AS a, exposure + 1 AS b, comp_score + 1 AS c, tech_sharpness + 1 AS d FROM metric)""")
def _(v):
    one = lambda c: F.col(c) + 1
    return v.metric.select("path", F.round(histogram_stats(F.array(one("aesthetic"), one("exposure"), one("comp_score"), one("tech_sharpness")))["mean"], 5).alias("mean"))


@query("f14_colour_temperature", "SELECT path, CASE WHEN s < 0.1 THEN 'neutral' WHEN h < 90 OR h >= 300 THEN 'warm' ELSE 'cool' END AS t FROM (SELECT path, path % 360 AS h, tech_sharpness / 10 AS s FROM metric)")
def _(v):
    return v.metric.select("path", (F.col("path") % 360).alias("h"), (F.col("tech_sharpness") / 10).alias("s")).select("path", colour_temperature("h", "s").alias("t"))


@query("f15_colour_difference")
def _(v):
    lab = lambda i: F.struct((F.col("aesthetic") * 10).alias("L"), (F.col("comp_score") * i - 5).alias("a"), (F.col("exposure") - i).alias("b"))
    return v.metric.select("path", F.round(colour_difference(lab(1), lab(2)), 4).alias("delta"))


@query("f16_tags", "SELECT p_partkey AS path, string_split(p_name, ' ')[1] || '|' || string_split(p_name, ' ')[2] AS tags FROM part")
def _(v):
    text = F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace("p_name", " ", " , ")).otherwise(F.to_json(F.split("p_name", " ")))
    return v.table("part").select(F.col("p_partkey").alias("path"), F.array_join(tags_of(text, 5), "|").alias("tags"))


@query("f17_short_id", "SELECT path, substr(md5(path || '|' || camera), 1, 12) AS id FROM item")
def _(v):
    return v.item.select("path", short_id("path", "camera").alias("id"))


@query("f18_escaped_like", "SELECT c_custkey AS path FROM customer WHERE c_name ILIKE '%#0000%' OR contains(c_name, 'a_b%')")
def _(v):
    from shelfmark.operators.predicates import like_any

    return v.table("customer").where(like_any(["c_name"], "#0000") | like_any(["c_name"], "a_b%")).select(F.col("c_custkey").alias("path"))


@query("f19_junk_lens", "SELECT path, length(trim(l)) < 4 OR regexp_full_match(trim(l), '[0-9]*') AS junk FROM (SELECT path, CASE WHEN path % 3 = 0 THEN path::VARCHAR || ' ' WHEN path % 3 = 1 THEN 'ab' ELSE lens END AS l FROM item)")
def _(v):
    lens = F.when(F.col("path") % 3 == 0, F.concat(F.col("path").cast("string"), F.lit(" "))).when(F.col("path") % 3 == 1, "ab").otherwise(F.col("lens"))
    return v.item.select("path", junk_lens(lens).alias("junk"))


@query("f20_finite", "SELECT path, CASE WHEN n_parts <> 4 THEN round(aesthetic / (n_parts - 4), 4) END AS x FROM metric")
def _(v):
    divided = F.when(F.col("n_parts") == 4, F.lit(float("inf"))).otherwise(F.col("aesthetic") / (F.col("n_parts") - 4))
    return v.metric.withColumn("d", divided).select("path", F.round(finite("d"), 4).alias("x"))


@query("f21_iso_sharpness", "SELECT path, round(aesthetic * CASE WHEN iso > 800 THEN least(2.0, 1 + 0.15 * log2(iso / 800.0)) ELSE 1.0 END, 4) AS s FROM (SELECT path, aesthetic, n_parts * 300 AS iso FROM metric)")
def _(v):
    return v.metric.withColumn("iso", F.col("n_parts") * 300).select("path", F.round(iso_sharpness("aesthetic", "iso"), 4).alias("s"))


@query("f22_lead_score", "SELECT path, round(0.6 * coalesce(aggregate, 0) + 0.4 * coalesce(nullif(ev, 7), 0) / 1.0, 4) AS s FROM shot")
def _(v):
    return v.shot.withColumn("e", F.nullif("ev", F.lit(7)).cast("double")).select("path", F.round(lead_score({"aggregate": 0.6, "e": 0.4}), 4).alias("s"))


@query("f23_burst_score", "SELECT path, round(0.5 * aggregate + 0.3 * ev / 10.0 + 0.2 * CASE WHEN kind = 'error' THEN 0 ELSE 10 END, 4) AS s FROM shot")
def _(v):
    rows = v.shot.withColumn("sharp", F.col("ev") / 10.0).withColumn("eyes", F.when(F.col("kind") == "error", 0.0).otherwise(10.0))
    return rows.select("path", F.round(lead_score({"aggregate": 0.5, "sharp": 0.3, "eyes": 0.2}), 4).alias("s"))


@query("f24_preview_score", "SELECT path, round((2 * aesthetic + 1 * exposure) / 3, 8) AS s FROM metric")
def _(v):
    return v.metric.select("path", F.round(lead_score({"aesthetic": 2.0, "exposure": 1.0}) / 3, 8).alias("s"))


@query("f26_age", "SELECT path, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM (SELECT path, path * 37 AS s FROM item)")
def _(v):
    return v.item.withColumn("s", F.col("path") * 37).select("path", age("s").alias("age"))


@query("f27_iso_guard", "SELECT path, CASE WHEN iso BETWEEN -100 AND 100 THEN iso ELSE 0 END::DOUBLE AS kept, iso::DOUBLE AS raw FROM (SELECT path, n_parts * 40 AS iso FROM metric)")
def _(v):
    rows = v.metric.withColumn("iso", F.col("n_parts") * 40)
    return rows.select("path", guarded("iso").alias("kept"), guarded("iso", raw_iso=True).alias("raw"))


@query("f28_week_of_year", "SELECT path, strftime(date_taken, '%W') AS week, dayofweek(date_taken)::INTEGER AS weekday FROM item")
def _(v):
    return v.item.select("path", week_of_year("date_taken").alias("week"), (F.dayofweek("date_taken") - 1).alias("weekday"))


def round_scaled(c: Column, digits: int) -> Column:
    """``c`` times a power of ten, rounded half away from zero and scaled back, all in doubles as SQL engines round; ``F.round`` looks at the shortest decimal form instead, so that 4.0375 becomes 4.038 and not 4.037."""
    return F.round(c * float(10**digits)) / float(10**digits)
