"""Streams and files: given tables are written to files under the shared folder, ingested, and the final state returned.

The defining SQL is the batch form.  A table arrives in four parts, each ingested by its own run, so every query also resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marquee.operators import extraction as ex
from marquee.plans.ingest_queries import _UNESCAPE
from marquee.plans.registry import behaviors, query, sql
from marquee.session import new_folder
from marquee.sources import files
from marquee.streaming import ingest

#: Part of a row by its id modulo 4; later parts hold smaller ids too, so arrival is not the order of ids.
ARRIVAL = {3: 0, 1: 1, 0: 2, 2: 3}
_ARRIVAL = "CASE {0} % 4 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END"


def arrivals(t, rows: DataFrame, id_col: str, run) -> None:
    """Write ``rows`` part by part and call ``run(stream)`` after each."""
    folder = new_folder(t.spark, "arrivals")
    for rest, part in ARRIVAL.items():
        rows.filter(F.col(id_col) % 4 == rest).write.parquet(f"{folder}/part={part}")
        stream = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder)
        run(stream)


@query("stream_interactions", sql(f"""SELECT user_id, item_id, behavior_type, CASE WHEN behavior_type = 1 THEN arg_max(event_id, place)
    ELSE arg_min(event_id, place) END AS event_id FROM (SELECT *, {_ARRIVAL.format('event_id')} * 1000000000000 + event_id AS place
    FROM behaviors) GROUP BY 1, 2, 3""", "behaviors"))
def stream_interactions(t):
    """Current interactions after four arrivals, with a compaction after the second."""
    out, point = new_folder(t.spark, "interactions"), new_folder(t.spark, "point")
    items = t.raw("part").select(F.col("p_partkey").alias("item_id"))
    runs = []

    def run(stream: DataFrame) -> None:
        ingest.ingest_interactions(stream, items, out, point).awaitTermination()
        runs.append(1)
        if len(runs) == 2:
            ingest.compact(t.spark, out)

    arrivals(t, t.interactions(), "event_id", run)
    return ingest.current_interactions(t.spark, out).select("user_id", "item_id", "behavior_type", "event_id")


@query("stream_exposure", sql("SELECT item_id, exposure FROM exposures", "exposures"))
def stream_exposure(t):
    """Running behaviour counts per item after the last arrival."""
    out, point = new_folder(t.spark, "exposure"), new_folder(t.spark, "point")

    def run(stream: DataFrame) -> None:
        ingest.exposure_stream(stream).writeStream.outputMode("complete").option("checkpointLocation", point).trigger(
            availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()

    arrivals(t, behaviors(t), "event_id", run)
    return t.spark.read.parquet(out)


_FIRED = f"""WITH RECURSIVE sizes AS (SELECT {_ARRIVAL.format('event_id')} AS part, count(*) AS n FROM events GROUP BY 1),
    walk(part, pending, fires) AS (SELECT 0, n, n >= 150 FROM sizes WHERE part = 0 UNION ALL SELECT s.part,
    CASE WHEN fires THEN 0 ELSE pending END + n, CASE WHEN fires THEN 0 ELSE pending END + n >= 150 FROM walk w JOIN sizes s ON
    s.part = w.part + 1) SELECT event_id, (SELECT min(w.part) FROM walk w WHERE w.fires AND w.part >= {_ARRIVAL.format('event_id')})
    AS fired_in FROM events"""


@query("stream_experiences", _FIRED)
def stream_experiences(t):
    """The training batch each pooled experience went into; a batch needs 150 pending rows."""
    out, point = new_folder(t.spark, "experiences"), new_folder(t.spark, "point")
    arrivals(t, t.raw("events").select("event_id"), "event_id",
             lambda stream: ingest.ingest_experiences(stream, out, point, threshold=150).awaitTermination())
    return ingest.processed_experiences(t.spark, out).select("event_id", "fired_in")


@query("stream_pages", f"""SELECT page_id, trim(regexp_replace({_UNESCAPE.format(
    "regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')) AS title,
    'completed' AS status, 4 AS batches, (SELECT count(*) FROM pages) AS records FROM pages""")
def stream_pages(t):
    """Titles of pages that arrive in four parts, with the state of the job."""
    out, point = new_folder(t.spark, "pages"), new_folder(t.spark, "point")
    arrivals(t, t.raw("pages"), "page_id",
             lambda stream: ingest.ingest_pages(stream, ex.page_titles, out, point).awaitTermination())
    state = ingest.job_status(t.spark, out).select("status", "batches", "records")
    return ingest.current_records(t.spark, out, ["page_id"]).select("page_id", "title").join(F.broadcast(state))


@query("csv_catalog", sql("""SELECT title, string_agg(DISTINCT types, ',' ORDER BY types) AS types, count(*) AS n, sum(round(rate * 100)::BIGINT)::BIGINT AS rate,
    sum(release_year) AS years, sum(length(trim(coalesce(summary, '')))) AS letters FROM items GROUP BY 1""", "items"))
def csv_catalog(t):
    """The catalogue written as CSV files, read and parsed again; summaries hold line breaks and quotes."""
    folder = new_folder(t.spark, "csv")
    rows = t.items(summary=True).select(F.col("item_id").cast("string").alias("subject_id"), "title", F.col("rate").alias("rating"),
                                        F.col("types").alias("genre"), "release_year", "duration", "summary", "country", "directors")
    files.write_csv(rows, folder, files.MOVIE_FIELDS)
    parsed = files.catalog_from_csv(files.read_csv(t.spark, folder, files.MOVIE_FIELDS))
    return parsed.groupBy("title").agg(
        F.array_join(F.array_sort(F.collect_set("types")), ",").alias("types"), F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("rate") * 100).cast("bigint")).alias("rate"),
        F.sum("release_year").alias("years"), F.sum(F.length("summary")).cast("bigint").alias("letters"))


@query("csv_behaviors", sql("""SELECT user_id::VARCHAR AS user_id, any_value(p_name) AS title, behavior_type, max(date_trunc('second', ts))
    AS ts FROM behaviors JOIN part ON p_partkey = item_id GROUP BY user_id, CASE WHEN item_id % 3 = 0 THEN p_name ELSE
    item_id::VARCHAR END, behavior_type""", "behaviors"))
def csv_behaviors(t):
    """Behaviours written as CSV, parsed, and the last one per user, item and type kept; every third item has no subject id."""
    folder = new_folder(t.spark, "csv")
    names = t.raw("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("movie_title"))
    rows = behaviors(t).join(names, "item_id").select(
        F.col("user_id").alias("user_email"), "movie_title", F.when(F.col("item_id") % 3 != 0, F.col("item_id")).alias("movie_subject_id"),
        "behavior_type", (F.col("score10") / 10).alias("score"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"))
    files.write_csv(rows, folder, files.BEHAVIOR_FIELDS)
    parsed = files.behaviors_from_csv(files.read_csv(t.spark, folder, files.BEHAVIOR_FIELDS))
    return files.dedupe_behaviors(parsed, seq="ts").select("user_id", "title", "behavior_type", "ts")


@query("saved_parameters", """SELECT vec_id AS row, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE label % 2 = 0""")
def saved_parameters(t):
    """Vectors saved as two versions of parameters, one of them twice; the one that was saved twice is read."""
    folder = new_folder(t.spark, "parameters")
    rows = t.raw("embeddings").select(F.lit("vec").alias("name"), F.col("vec_id").alias("row"), F.col("embedding").alias("values"), "label")
    for version, rest in (("even", 0), ("odd", 1), ("even", 0)):
        files.save_parameters(rows.filter(F.col("label") % 2 == rest).drop("label"), folder, version_tag=version)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return files.load_parameters(t.spark, folder, version_tag="even").select("row", F.round(total, 4).alias("total"))
