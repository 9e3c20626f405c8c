"""File sources and sinks: scraped CSV files, keyed merges, model parameters, run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from marquee.operators.interactions import merge_keyed

# Column order of the CSV files.
MOVIE_FIELDS = ("subject_id", "title", "rating", "genre", "release_year", "duration", "summary", "country",
                "directors", "detail_url", "comment_len")
COMMENT_FIELDS = ("subject_id", "movie_title", "comment_user", "comment_text", "comment_votes", "comment_rating",
                  "comment_time")
BEHAVIOR_FIELDS = ("user_email", "movie_title", "movie_subject_id", "behavior_type", "score", "create_time")

UNKNOWN_GENRE, UNKNOWN_DIRECTOR, UNKNOWN_COUNTRY, UNKNOWN_CAST = "未知", "未知导演", "未知", "未知主演"


def read_csv(spark: SparkSession, path: str, fields: Sequence[str], *, multi_line: bool = True) -> DataFrame:
    """CSV with header, every column a string; a byte order mark and quoted line breaks are handled.

    Quoted line breaks make a file unsplittable; turn ``multi_line`` off for
    large files that have none.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("quote", '"')
        .option("escape", '"').option("encoding", "UTF-8").csv(path)
    )


def write_csv(df: DataFrame, path: str, fields: Sequence[str], *, mode: str = "errorifexists") -> None:
    """CSV with exactly ``fields``; absent columns and nulls become empty strings."""
    cols = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f)
            for f in fields]
    df.select(*cols).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", "").csv(path)


def catalog_from_csv(rows: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Scraped rows as item rows; ``metadata`` (title, directors, country, casts) fills in known titles."""
    def number(name: str, kind: str):
        return F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind))

    base = rows.select(
        F.btrim(F.coalesce("title", F.lit(""))).alias("title"),
        F.replace(F.coalesce(F.nullif(F.col("genre"), F.lit("")), F.lit(UNKNOWN_GENRE)), F.lit(","), F.lit("/")).alias("types"),
        number("rating", "double").alias("rate"), number("release_year", "int").alias("release_year"),
        number("duration", "int").alias("duration"), F.btrim(F.coalesce("summary", F.lit(""))).alias("summary"),
    )
    if metadata is None:
        known = base.withColumn("directors", F.lit(None).cast("string")).withColumn(
            "country", F.lit(None).cast("string")).withColumn("casts", F.lit(None).cast("string"))
    else:
        known = base.join(metadata.select("title", "directors", "country", "casts"), "title", "left")
    return known.withColumn("directors", F.coalesce("directors", F.lit(UNKNOWN_DIRECTOR))).withColumn(
        "country", F.coalesce("country", F.lit(UNKNOWN_COUNTRY))).withColumn(
        "casts", F.coalesce("casts", F.lit(UNKNOWN_CAST)))


def behaviors_from_csv(rows: DataFrame) -> DataFrame:
    """Typed behaviour records; scores in tenths, dirty numbers become null."""
    return rows.select(
        F.col("user_email").alias("user_id"), F.col("movie_title").alias("title"),
        F.col("movie_subject_id").alias("subject_id"), F.col("behavior_type").try_cast("int").alias("behavior_type"),
        F.round(F.col("score").try_cast("double") * 10).cast("bigint").alias("score10"),
        F.try_to_timestamp("create_time", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
    )


def dedupe_behaviors(records: DataFrame, *, seq: str) -> DataFrame:
    """Last record per (user, item key, type); the item key is the subject id, or the title where that is empty."""
    from marquee.operators.interactions import dedupe_last

    keyed = records.withColumn("item_key", F.coalesce(F.nullif(F.col("subject_id"), F.lit("")), F.col("title")))
    return dedupe_last(keyed, ["user_id", "item_key", "behavior_type"], seq=seq).drop("item_key")


def merge_parquet(spark: SparkSession, current: str | None, incoming: DataFrame, target: str, keys: Sequence[str],
                  *, seq: str) -> DataFrame:
    """Merge ``incoming`` into the snapshot at ``current`` and write the result to the new folder ``target``.

    The folder being read is never overwritten; the caller switches to ``target``.
    """
    existing = spark.read.parquet(current) if current else incoming.limit(0)
    merge_keyed(existing, incoming, keys, seq=seq).write.parquet(target)
    return spark.read.parquet(target)


def save_parameters(params: DataFrame, folder: str, *, version_tag: str) -> None:
    """Model parameters (name, row, values) under their version; a version saved again replaces its rows, and no others."""
    params.withColumn("version_tag", F.lit(version_tag)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("version_tag").parquet(folder)


def load_parameters(spark: SparkSession, folder: str, *, version_tag: str) -> DataFrame:
    return spark.read.parquet(folder).filter(F.col("version_tag") == version_tag).drop("version_tag")


def append_rows(rows: DataFrame, folder: str) -> None:
    """Append to a log table (runs, versions, activations)."""
    rows.write.mode("append").parquet(folder)
