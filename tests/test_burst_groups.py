"""Cameras share the state of their group, and each keeps its own bursts."""

import datetime

from test_stateful import KIND, START, plain_bursts

from shelfmark.streaming import stateful


def test_many_cameras_make_few_states(spark, tmp_path):
    rows = [(None if c == 7 else c, 10 * c + k, START + datetime.timedelta(seconds=c % 50 + [0, 1, 300, 86400 * 9][k]), [0, 1, 1, 5][k] ^ c, c % 2, "ok") for c in range(1000) for k in range(4)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found, counts = stateful.replay(stateful.bursts(stream, 4, 60, 3, late="1 day"))
    got = {r["path"]: (r["camera"], r["burst"]) for r in found.collect()}
    want = plain_bursts([r for r in rows if r[1] % 10 < 3], 4, 60, 3)
    assert got == {path: (None if path // 10 == 7 else path // 10, burst) for path, burst in want.items()} and len(set(want.values())) == 2000
    assert counts["late_rows"] == 0 and counts["state_rows"] <= 2 * stateful.GROUPS  # a thousand last rows wait
