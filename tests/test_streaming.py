"""Streams end in the same state as their batch form, and restarts add nothing."""

import datetime as dt

from pyspark.sql import functions as F

from marquee.operators import catalog as cat, extraction as ex, interactions as ix
from marquee.streaming import ingest

T0 = dt.datetime(2024, 1, 1)
RAW = "event_id long, user_id long, item_id long, behavior_type int, score10 long, ts timestamp"


def raw_rows(lo, hi):
    return [(e, e % 7, e % 11, 1 + e % 4, (e * 13) % 104 if 1 + e % 4 == 1 else None, T0 + dt.timedelta(minutes=e)) for e in range(lo, hi)]


def add(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def run(query):
    query.awaitTermination()


def test_interactions(spark, folder):
    items = spark.createDataFrame([(i,) for i in range(10)], "item_id long")
    source, out, point = f"{folder}/src", f"{folder}/out", f"{folder}/cp"
    add(spark, raw_rows(0, 150), RAW, source, "a")
    run(ingest.ingest_interactions(stream(spark, RAW, source), items, out, point))
    assert ingest.compact(spark, out) == 0
    add(spark, raw_rows(150, 300), RAW, source, "b")
    run(ingest.ingest_interactions(stream(spark, RAW, source), items, out, point))
    run(ingest.ingest_interactions(stream(spark, RAW, source), items, out, point))
    got = ingest.current_interactions(spark, out)
    everything = spark.createDataFrame(raw_rows(0, 300), RAW)
    checked = ix.validate_interactions(everything, items)
    want = ix.interaction_upsert(everything.limit(0), ix.accepted(checked)).drop("is_new")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    rejected = spark.read.parquet(f"{out}/rejected")
    assert rejected.count() == checked.filter(F.col("reject_reason").isNotNull()).count() > 0


def test_experience_trigger(spark, folder):
    source, out, point = f"{folder}/src", f"{folder}/out", f"{folder}/cp"
    sizes, fired = [60, 39, 1, 101, 50], []
    start = 0
    for k, n in enumerate(sizes):
        add(spark, [(i,) for i in range(start, start + n)], "id long", source, f"f{k}")
        start += n
        run(ingest.ingest_experiences(stream(spark, "id long", source), out, point,
                                      on_batch=lambda df, b: fired.append(df.count())))
    assert fired == [100, 101]
    rows = ingest.processed_experiences(spark, out)
    assert rows.filter("fired_in is null").count() == 50
    assert {r.fired_in: r["count"] for r in rows.filter("fired_in is not null").groupBy("fired_in").count().collect()} == {2: 100, 3: 101}


def test_exposure(spark, folder):
    add(spark, raw_rows(0, 200), RAW, folder, "a")
    add(spark, raw_rows(200, 260), RAW, folder, "b")
    query = ingest.exposure_stream(stream(spark, RAW, folder)).writeStream.format("memory").queryName("exposures").outputMode(
        "complete").trigger(availableNow=True).start()
    run(query)
    want = cat.exposure(spark.createDataFrame(raw_rows(0, 260), RAW)).collect()
    assert sorted(spark.table("exposures").collect()) == sorted(want)


def test_pages_resume(spark, folder):
    source, out, point = f"{folder}/src", f"{folder}/out", f"{folder}/cp"
    page = '<div class="item"><div class="hd"><a href="https://e.org/subject/{0}/"><span class="title">t{0}</span></a></div></div>'
    schema = "page_id long, html string"
    add(spark, [(1, page.format(1) + page.format(2))], schema, source, "a")
    run(ingest.ingest_pages(stream(spark, schema, source), ex.list_page_items, out, point))
    add(spark, [(2, page.format(2) + page.format(3))], schema, source, "b")
    for _ in range(2):
        run(ingest.ingest_pages(stream(spark, schema, source), ex.list_page_items, out, point))
    got = ingest.current_records(spark, out, ["subject_id", "title"])
    assert sorted(r.subject_id for r in got.collect()) == ["1", "2", "3"]
    status = ingest.job_status(spark, out).first()
    assert (status.status, status.batches, status.records) == ("completed", 2, 4)
