from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestar.streaming import watch

SCHEMA = "event_type string, src_path string, dest_path string, is_directory boolean, ts timestamp"


def events(spark):
    rows = [
        ("created", "/r/a/x.md", None, False, "2025-01-01 00:00:00"),
        ("modified", "/r/a/x.md", None, False, "2025-01-01 00:00:00.5"),
        ("modified", "/r/a", None, True, "2025-01-01 00:00:00.6"),
        ("moved", "/r/old.py", "/r/new.py", False, "2025-01-01 00:00:30"),
        ("created", "/r/node_modules/x.js", None, False, "2025-01-01 00:00:30"),
        ("created", "/r/private/y.md", None, False, "2025-01-01 00:00:30"),
        ("created", "/r/unknown.zip", None, False, "2025-01-01 00:00:30"),
        ("opened", "/r/a/x.md", None, False, "2025-01-01 00:00:30"),
        ("created", "/elsewhere/y.md", None, False, "2025-01-01 00:00:30"),
        ("created", None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))


def roots(spark):
    return spark.createDataFrame([(1, "/r", ["private"]), (2, "/other/", None)], "id long, path string, exclusions array<string>")


def test_relevant(spark):
    got = watch.relevant(watch.touched(events(spark)), roots(spark))
    assert sorted(r.path for r in got.collect()) == ["/r/a/x.md", "/r/a/x.md", "/r/new.py", "/r/old.py"]
    assert watch.coalesced(got).first().dirty == 3


def test_stream(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    rows = [json.dumps({k: str(v) if k == "ts" else v for k, v in r.asDict().items()}) for r in events(spark).where("ts is not null").collect()]
    late = json.dumps({"event_type": "created", "src_path": "/r/z.md", "is_directory": False, "ts": "2025-01-02 00:00:00"})
    (src / "1.json").write_text("\n".join(rows) + "\n")
    (src / "2.json").write_text(late + "\n")
    seen = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{src}")
    query = watch.watch(stream, roots(spark), lambda df, n: seen.extend(map(tuple, df.select("root_id", "events").collect())), name=f"t{abs(hash(str(tmp_path)))}")
    query.awaitTermination(60)
    assert sorted(seen) == [(1, 2), (1, 2)]
    assert watch.watch_state(False, 1, None) == "off" and watch.watch_state(True, 0, None) == "waiting" and watch.watch_state(True, 1, query) == "stopped"
