"""Blocks of phrases are as long as they can be, and all shards get some."""

from shelfmark.llm import phrases


def test_a_task_makes_a_block_for_each_language(spark, monkeypatch):
    docs = spark.range(0, 240, 1, 3).selectExpr("concat('a b ', id, ' c') as text", "if(id % 2 = 0, 'en', null) as lang")
    blocks = phrases.write_blocks(docs, 3).select("shard", "lang", "n").collect()
    assert sorted((r["shard"], r["lang"], r["n"]) for r in blocks) == [(s, x, 160) for s in range(3) for x in ("en", "und")]
    monkeypatch.setattr(phrases, "LONGEST_BLOCK", 50)
    split = phrases.write_blocks(docs, 3).select("shard", "lang", "n").collect()
    assert {r["shard"] for r in split} == {0, 1, 2} and sum(r["n"] for r in split) == 960 and max(r["n"] for r in split) < 60
