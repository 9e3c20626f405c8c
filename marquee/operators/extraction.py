"""Record cleaning and extraction from stored pages, as column expressions.

Pages are cut into blocks by their marker and each field is one regular
expression, so extraction stays in the JVM and scales with the page table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.text import distinct_sorted_list, first, normalize_whitespace, trimmed_list
from marquee.operators.interactions import dedupe_last

ANONYMOUS = "匿名用户"
_TAG = r"<[^>]*>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_tags(html: Column) -> Column:
    text = F.regexp_replace(html, _TAG, "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_titles(pages: DataFrame, *more: Column) -> DataFrame:
    """Title of each page, and what else is asked of it in the same scan."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return pages.select("page_id", "url", normalize_whitespace(strip_tags(title)).alias("title"), *more)


def page_links(pages: DataFrame) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(links).alias("pos", "href"))


def clean_records(records: DataFrame, *carried: str) -> DataFrame:
    """Normalise scraped records: spaces collapsed, genre a sorted distinct list, numbers coerced to 0.

    ``carried`` names further columns to pass through unchanged.
    """
    def number(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name).cast("string").try_cast(kind), F.lit(0).cast(kind)).alias(name)

    return records.select(
        F.coalesce(F.col("subject_id").cast("string"), F.lit("")).alias("subject_id"),
        normalize_whitespace(F.col("title")).alias("title"),
        number("rating", "double"),
        distinct_sorted_list(F.col("genre")).alias("genre"),
        number("release_year", "int"), number("duration", "int"),
        normalize_whitespace(F.col("summary")).alias("summary"),
        trimmed_list(F.col("country")).alias("country"),
        trimmed_list(F.col("directors")).alias("directors"),
        F.coalesce("detail_url", F.lit("")).alias("detail_url"),
        number("comment_len", "int"),
        *carried,
    )


def _blocks(pages: DataFrame, marker: str) -> DataFrame:
    parts = F.split("html", marker)
    return pages.select("page_id", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
                        .alias("block_no", "block"))


def _pick(pattern: str) -> Column:
    return F.regexp_extract("block", pattern, 1)


def list_page_items(pages: DataFrame, *, most_directors: int | None = None, most_countries: int | None = None,
                    most_genres: int | None = None) -> DataFrame:
    """Item records of catalogue list pages (one ``div.item`` block per item), cleaned and deduplicated.

    The ``most_`` arguments keep only the first names of a list; 3, 3 and 4 give short display records.
    """
    blocks = _blocks(pages, r'(?i)<div\s+class="item"\s*>')
    raw_info = F.regexp_replace(_pick(r'(?is)<div\s+class="bd"[^>]*>.*?<p[^>]*>(.*?)</p>'), r"(?i)<br\s*/?>", " ")
    info = normalize_whitespace(strip_tags(raw_info))
    fields = blocks.select(
        "page_id", "block_no", info.alias("info"),
        strip_tags(_pick(r'(?is)<span\s+class="title"[^>]*>(.*?)</span>')).alias("title"),
        F.btrim(_pick(r'(?is)<span\s+class="rating_num"[^>]*>(.*?)</span>')).alias("rating"),
        _pick(r'(?is)<div\s+class="hd"[^>]*>.*?<a\s[^>]*href="([^"]*)"').alias("detail_url"),
        strip_tags(_pick(r'(?is)<span\s+class="inq"[^>]*>(.*?)</span>')).alias("summary"),
    )
    parts = F.filter(F.transform(F.split("info", "/"), lambda x: F.btrim(x)), lambda x: x != "")
    crew = F.btrim(F.regexp_extract("info", r"导演:\s*(.*?)(?:主演:|$)", 1))
    directors = first(F.filter(F.split(crew, r"\s+"), lambda x: x != ""), most_directors)
    countries = first(F.filter(parts, lambda x: x.rlike("^[一-龥A-Za-z· ]{2,20}$")), most_countries)
    genres = first(F.filter(parts, lambda x: F.char_length(x) <= 12), most_genres)
    records = fields.select(
        F.regexp_extract("detail_url", r"/subject/(\d+)/", 1).alias("subject_id"), "title", "rating",
        F.array_join(genres, "/").alias("genre"),
        F.regexp_extract("info", r"\b((?:19|20)\d{2})\b", 1).alias("release_year"),
        F.regexp_extract("info", r"(\d+)\s*分钟", 1).alias("duration"),
        "summary", F.array_join(countries, "/").alias("country"), F.array_join(directors, "/").alias("directors"),
        "detail_url", F.lit(0).alias("comment_len"), F.struct("page_id", "block_no").alias("seq"),
    )
    return dedupe_last(clean_records(records, "seq"), ["subject_id", "title"], seq="seq").drop("seq")


def star_rating(class_names: Column) -> Column:
    """Stars from a class such as ``allstar50`` (5 stars); 0 when absent."""
    digits = F.regexp_extract(class_names, r"allstar(\d+)0", 1)
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def comment_page_rows(pages: DataFrame) -> DataFrame:
    """Comments of stored comment pages; ``pages`` carries subject_id and movie_title."""
    subject = pages.select("page_id", "subject_id", "movie_title")
    blocks = _blocks(pages, r'(?i)<div\s+class="comment-item[^>]*>')
    short = r'(?is)<span\s+class="short"[^>]*>(.*?)</span>'
    info = r'(?is)<span\s+class="comment-info"[^>]*>'
    rows = blocks.filter(F.col("block").rlike(short)).select(
        "page_id", "block_no",
        normalize_whitespace(strip_tags(_pick(info + r".*?<a[^>]*>(.*?)</a>"))).alias("user"),
        normalize_whitespace(strip_tags(_pick(short))).alias("comment_text"),
        F.coalesce(F.btrim(_pick(r'(?is)<span\s+class="votes[^"]*"[^>]*>(.*?)</span>')).try_cast("int"), F.lit(0))
        .alias("comment_votes"),
        star_rating(_pick(r'(?is)<span\s+class="([^"]*rating[^"]*)"')).alias("comment_rating"),
        _pick(r'(?is)<span\s+class="comment-time[^"]*"\s+title="([^"]*)"').alias("comment_time"),
    )
    named = rows.join(subject, "page_id").select(
        "subject_id", "movie_title", F.when(F.col("user") == "", ANONYMOUS).otherwise(F.col("user")).alias("comment_user"),
        "comment_text", "comment_votes", "comment_rating", "comment_time", F.struct("page_id", "block_no").alias("seq"),
    )
    return dedupe_last(named, ["subject_id", "comment_user", "comment_text"], seq="seq").drop("seq")
