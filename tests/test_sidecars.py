"""Sidecars in one parse: the fields are those of path expressions."""

from pyspark.sql import functions as F

from shelfmark.sources import tables

HEAD = '<x:m xmlns:x="a:b" xmlns:p="c d" xmlns:r="e">'
TEXTS = [
    f"{HEAD}<p:Rating>4</p:Rating><p:Label>Select</p:Label><r:subject><r:Bag><r:li>a &amp; b</r:li><r:li/><r:li>ü<!-- c -->d</r:li></r:Bag></r:subject><p:MetadataDate>2024-01-02</p:MetadataDate></x:m>",
    f"{HEAD}<p:Rating>1<i>9</i>2</p:Rating><p:Rating>3</p:Rating><r:li>outside</r:li><p:Label></p:Label></x:m>",
    f"{HEAD}<p:Rating><i>9</i>five</p:Rating><subject> <li> <b>in</b> out</li></subject></x:m>",
    '<?xml version="1.0" encoding="ISO-8859-1"?><Label>é<?pi x?>f</Label>',
    "<m/>",
    "",
    None,
]


def test_fields_are_those_of_path_expressions(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "path long, x string")
    one = lambda tag: F.xpath_string("x", F.lit(f"//*[local-name()='{tag}']/text()"))
    words = F.xpath("x", F.lit("//*[local-name()='subject']//*[local-name()='li']/text()"))
    want = df.select("path", one("Rating").try_cast("int"), F.nullif(one("Label"), F.lit("")), words, F.nullif(one("MetadataDate"), F.lit("")))
    got = tables.parse_sidecars(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]


def test_a_text_is_parsed_once(spark):
    """Path expressions parse a text for each field."""
    plan = tables.parse_sidecars(spark.createDataFrame([(1, "<m/>")], "path long, x string"))._jdf.queryExecution().toString()
    assert "xpath" not in plan
