import datetime as dt

from notarium.operators.facts import resolve
from notarium.streaming import facts as stream

SCHEMA = "seq long, domain string, category string, key string, as_of date, value_numeric double"


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i, "d", "c", f"k{i % 3}", dt.date(2024, 1, 1 + (i * 7) % 11), float(i)) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = stream.current_facts(source).writeStream.outputMode("update").format("memory").queryName("current_facts").option("checkpointLocation", f"{tmp_path}/ck1").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.key, r.as_of, r.value_numeric) for r in resolve(spark.createDataFrame(rows, SCHEMA)).where("valid_until IS NULL").collect()}
    assert {(r.key, r.as_of, r.value_numeric) for r in spark.table("current_facts").collect()} == want
    stream.append_log(source, f"{tmp_path}/log", f"{tmp_path}/ck2").awaitTermination()
    assert stream.resolved_log(spark, f"{tmp_path}/log", SCHEMA).count() == resolve(spark.createDataFrame(rows, SCHEMA)).count()


def test_order_across_arrow_batches(spark, tmp_path):
    """Many saves of one key in one trigger, out of order over files and Arrow batches, some without date or number."""
    rows = [(i, "d", "c", f"k{i % 2}", None if i % 50 == 7 else dt.date(2024, 1, 1) + dt.timedelta(days=(i * 37) % 300), None if i % 3 == 0 else float(i)) for i in range(400)]
    shuffled = sorted(rows, key=lambda r: (r[0] * 7919) % 1009)
    spark.createDataFrame(shuffled, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = stream.current_facts(source).writeStream.outputMode("update").format("memory").queryName("many_saves").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    dated = [r for r in rows if r[4]]
    want = {(r.key, r.as_of, r.value_numeric) for r in resolve(spark.createDataFrame(dated, SCHEMA)).where("valid_until IS NULL").collect()}
    got = spark.table("many_saves").collect()
    assert {(r.key, r.as_of, r.value_numeric) for r in got} == want
    assert sum(r.superseded + r.backdated + 1 for r in got) == len(dated)
