from pyspark.sql import functions as F

from factmill.operators.incremental import StateTarget
from factmill.sources.manifest import FEATURES
from factmill.streaming.intake import arrival_counts, start_intake

SCHEMA = "project_id string, relative_path string, source_text string, modified_ms long, size_bytes long, sha256 string, ingested_at timestamp"


def _write(spark, rows, at):
    df = spark.createDataFrame([(*r, len(r[2]), None) for r in rows], "project_id string, relative_path string, source_text string, modified_ms long, size_bytes long, sha256 string")
    df.withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(at)


def test_intake_keeps_the_latest_state(spark, tmp_path):
    arriving, state, store, check = (f"file://{tmp_path}/{n}" for n in ("in", "state", "store", "check"))
    on = dict.fromkeys(FEATURES, True)
    for batch in ([("p", "a.php", "<?php class A {}", 1), ("p", "b.php", "<?php class B extends A {}", 1)], [("p", "a.php", "<?php class A2 {}", 2), ("p", "a.php", "<?php old", 0)]):
        _write(spark, batch, arriving)
        start_intake(spark, spark.readStream.schema(SCHEMA).parquet(arriving), state, store, check, on).awaitTermination()
    files = StateTarget(spark, state, ["project_id", "relative_path"], ["modified_ms"]).read()
    assert {(r.relative_path, r.modified_ms) for r in files.collect()} == {("a.php", 2), ("b.php", 1)}
    facts = StateTarget(spark, store, ["project_id", "relative_path"], ["modified_ms"])
    assert facts.current() == 2 and facts.read().count() == 2


def test_arrival_counts(spark, tmp_path):
    _write(spark, [("p", "a", "x", 1), ("p", "b", "x", 1)], f"file://{tmp_path}/in")
    q = arrival_counts(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.project_id, r.files) for r in spark.sql("SELECT * FROM arrivals").collect()] == [("p", 2)]
