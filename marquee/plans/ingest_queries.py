"""Ingest, cleaning, extraction, keyed updates, experience pool and version queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import catalog as cat, experience as xp, extraction as ex, interactions as ix, versions as ver
from marquee.plans.registry import behaviors, query, sql

CUT = "2024-01-15"


def _score10():
    return F.coalesce(F.col("score10"), F.lit(-1)).alias("score10")


_UPSERT = """SELECT user_id, item_id, behavior_type, coalesce(CASE WHEN behavior_type = 1 THEN last(score10 ORDER BY event_id)
    ELSE first(score10 ORDER BY event_id) END, -1) AS score10, CASE WHEN behavior_type = 1 THEN max(event_id)
    ELSE min(event_id) END AS event_id, min(ts) >= TIMESTAMP '2024-01-15' AS is_new FROM {0} GROUP BY 1, 2, 3"""


def _sides(t):
    valid = behaviors(t)
    return valid.filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")), valid.filter(
        F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"))


@query("interaction_upsert", sql(_UPSERT.format("behaviors"), "behaviors"))
def interaction_upsert(t):
    before, batch = _sides(t)
    return ix.interaction_upsert(before, batch).select(
        "user_id", "item_id", "behavior_type", _score10(), "event_id", "is_new")


def _records(t):
    titles = t.raw("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return behaviors(t).join(titles, "item_id")


_RECORDS = """SELECT b.user_id, m.item_id, b.behavior_type, b.score10, b.ts, b.event_id FROM behaviors b JOIN part p
    ON p.p_partkey = b.item_id JOIN (SELECT p_name, max(p_partkey) AS item_id FROM part GROUP BY 1) m ON m.p_name = p.p_name"""


@query("load_interactions", sql(_UPSERT.format("records"), "behaviors", records=_RECORDS))
def load_interactions(t):
    titles = t.raw("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    records = _records(t)
    by_title = titles.groupBy("title").agg(F.max("item_id").alias("top"))
    before = records.filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")).join(by_title, "title").withColumn(
        "item_id", F.col("top"))
    batch = records.filter(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"))
    _, snapshot = ix.load_interactions(batch, titles, t.users(), before)
    return snapshot.select("user_id", "item_id", "behavior_type", _score10(), "event_id", "is_new")


@query("load_new_users", sql("""SELECT DISTINCT user_id FROM behaviors WHERE user_id NOT IN (SELECT c_custkey FROM customer
    WHERE c_custkey % 4 <> 0)""", "behaviors"))
def load_new_users(t):
    titles = t.raw("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    new_users, _ = ix.load_interactions(_records(t), titles, t.users().filter(F.col("user_id") % 4 != 0),
                                        behaviors(t).limit(0))
    return new_users


_LINE = """SELECT CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS k1, CASE WHEN l_linenumber = 7
    THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS k2, l_partkey, l_quantity, l_extendedprice, l_suppkey FROM lineitem"""
_DEDUPE = """SELECT k1, k2, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY {0} l_partkey
    DESC, l_quantity DESC, l_extendedprice DESC, l_suppkey DESC) AS rn FROM lines) WHERE rn = 1 AND (k1 <> '' OR k2 <> '')"""


def _lines(t):
    empty = F.col("l_linenumber") == 7
    return t.raw("lineitem").select(
        F.when(empty, "").otherwise(F.col("l_orderkey").cast("string")).alias("k1"),
        F.when(empty, "").otherwise(F.col("l_linenumber").cast("string")).alias("k2"),
        "l_partkey", "l_quantity", "l_suppkey", F.struct("l_partkey", "l_quantity", "l_extendedprice", "l_suppkey").alias("seq"))


@query("dedupe_last", sql(_DEDUPE.format(""), lines=_LINE))
def dedupe_last(t):
    return ix.dedupe_last(_lines(t), ["k1", "k2"], seq="seq").select("k1", "k2", "l_partkey", "l_quantity")


@query("merge_keyed", sql(_DEDUPE.format("CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END DESC,"), lines=_LINE))
def merge_keyed(t):
    lines = _lines(t)
    existing, incoming = lines.filter(F.col("l_suppkey") % 3 != 0), lines.filter(F.col("l_suppkey") % 3 == 0)
    return ix.merge_keyed(existing, incoming, ["k1", "k2"], seq="seq").select("k1", "k2", "l_partkey", "l_quantity")


@query("clean_records", sql(r"""SELECT CAST(item_id AS VARCHAR) AS subject_id, title, rate AS rating,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(types || '/' || casts, '/'),
    lambda x: trim(x)), lambda x: x <> ''))), '/') AS genre, release_year, CASE WHEN item_id % 3 = 0 THEN 0 ELSE duration END
    AS duration, trim(regexp_replace(coalesce(summary, ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+',
    ' ', 'g')) AS summary, country || '/' || country AS country, directors FROM items""", "items"))
def clean_records(t):
    """Catalogue rows roughened with commas, stray spaces and text numbers, then cleaned."""
    i = t.items(summary=True)
    dirty = i.select(
        F.col("item_id").alias("subject_id"), F.concat(F.lit("  "), F.replace(F.col("title"), F.lit(" "), F.lit(" \t ")), F.lit("\n")).alias("title"),
        F.col("rate").cast("string").alias("rating"),
        F.concat(F.replace(F.col("types"), F.lit("/"), F.lit(" , ")), F.lit("//"), F.col("casts"), F.lit("/ ")).alias("genre"),
        F.col("release_year").cast("string").alias("release_year"),
        F.when(F.col("item_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("duration").cast("string")).alias("duration"),
        "summary", F.concat(F.col("country"), F.lit(" ,"), F.col("country")).alias("country"),
        F.concat(F.lit("/"), F.col("directors")).alias("directors"),
        F.lit(None).cast("string").alias("detail_url"), F.lit("").alias("comment_len"),
    )
    return ex.clean_records(dirty).drop("detail_url", "comment_len")


_UNESCAPE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query("page_extract", f"""SELECT page_id, url, trim(regexp_replace({_UNESCAPE.format(
    "regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')) AS title,
    len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS n_links FROM pages""")
def page_extract(t):
    pages = t.raw("pages")
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)
    return ex.page_titles(pages.select("page_id", "url", "html"), F.size(links).cast("bigint").alias("n_links"))


@query("page_links", """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html,
    '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def page_links(t):
    return ex.page_links(t.raw("pages")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("list_page_items", sql("""SELECT CAST(item_id AS VARCHAR) AS subject_id, title, rate AS rating, release_year, duration,
    title || ' & co' AS summary, directors FROM items""", "items"))
def list_page_items(t):
    """Catalogue list pages of 25 items rendered by Spark, then extracted again."""
    block = F.format_string(
        '<div class="item"><div class="hd"><a href="https://example.org/subject/%d/"><span class="title">%s</span></a></div>'
        '<div class="bd"><p class="">导演: %s   主演: %s<br>%d / %s / %d分钟</p><span class="rating_num">%s</span>'
        '<span class="inq">%s &amp;  co</span></div></div>',
        "item_id", "title", "directors", "casts", "release_year", "country", "duration", F.col("rate").cast("string"), "title")
    pages = t.items().select(F.floor(F.col("item_id") / 25).alias("page_id"), "item_id", block.alias("block")).groupBy(
        "page_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.struct("item_id", "block")))["block"]).alias("html"))
    return ex.list_page_items(pages).select("subject_id", "title", "rating", "release_year", "duration", "summary", "directors")


@query("comment_page_rows", sql(r"""SELECT subject_id, comment_user, comment_text, max(turn * 3) AS comment_votes,
    arg_max(CASE WHEN turn % 2 = 0 THEN turn % 5 + 1 ELSE 0 END, turn) AS comment_rating FROM (SELECT
    CAST(item_id AS VARCHAR) AS subject_id, turn, coalesce('user ' || user_id, '匿名用户') AS comment_user,
    trim(regexp_replace(replace(replace(content, '<', ' '), '>', ' '), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+',
    ' ', 'g')) AS comment_text FROM comments) GROUP BY 1, 2, 3""", "comments"))
def comment_page_rows(t):
    """Comment pages rendered by Spark from the comments of each item, then extracted again."""
    body = F.replace(F.translate("content", "<>", "  "), F.lit("&"), F.lit("&amp;"))
    stars = F.when(F.col("turn") % 2 == 0, F.format_string('<span class="allstar%d0 rating"></span>', F.col("turn") % 5 + 1)).otherwise("")
    block = F.concat(
        F.lit('<div class="comment-item "><span class="votes vote-count">'), (F.col("turn") * 3).cast("string"),
        F.lit('</span><span class="comment-info"><a href="#">'), F.coalesce(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.lit("")),
        F.lit("</a>"), stars, F.lit('<span class="comment-time " title="2024-01-01 00:00:00">x</span></span><span class="short">'),
        body, F.lit("</span></div>"))
    pages = t.comments().select("item_id", "turn", block.alias("block")).groupBy("item_id").agg(
        F.concat_ws("", F.sort_array(F.collect_list(F.struct("turn", "block")))["block"]).alias("html"))
    pages = pages.select(F.col("item_id").alias("page_id"), F.col("item_id").cast("string").alias("subject_id"),
                         F.lit("t").alias("movie_title"), "html")
    return ex.comment_page_rows(pages).select("subject_id", "comment_user", "comment_text",
                                              F.col("comment_votes").cast("bigint").alias("comment_votes"), "comment_rating")


def _pool(t):
    return behaviors(t).select(
        F.col("event_id").alias("id"), "user_id", "item_id", "behavior_type",
        F.when(F.col("event_id") % 4 == 0, "processed").otherwise("pending").alias("status"),
        F.lit("v0").alias("model_version"), ix.reward(F.col("behavior_type"), F.col("score10")).alias("reward"))


_POOL = """SELECT event_id AS id, user_id, item_id, behavior_type, CASE WHEN event_id % 4 = 0 THEN 'processed' ELSE 'pending'
    END AS status FROM behaviors"""


@query("pending_fifo", sql("SELECT id, user_id, item_id FROM pool WHERE status = 'pending' ORDER BY id LIMIT 100", "behaviors",
                           pool=_POOL))
def pending_fifo(t):
    return xp.pending_fifo(_pool(t)).select("id", "user_id", "item_id")


@query("mark_processed", sql("""SELECT id, CASE WHEN id % 2 = 0 THEN 'processed' ELSE status END AS status,
    CASE WHEN id % 2 = 0 THEN 'v1' ELSE 'v0' END AS model_version FROM pool""", "behaviors", pool=_POOL))
def mark_processed(t):
    done = t.raw("events").filter(F.col("event_id") % 2 == 0).select(F.col("event_id").alias("id"))
    return ix.mark_processed(_pool(t), done, version="v1").select("id", "status", "model_version")


@query("experience_rows", sql("""SELECT b.event_id AS id, b.user_id, b.item_id, b.behavior_type, CASE WHEN behavior_type = 1
    THEN round((score10 / 10 - 5) / 5, 4) WHEN behavior_type = 2 THEN 0.35 ELSE 0.15 END AS reward,
    round(0.12 * coverage_bonus, 6) AS aux_reward FROM behaviors b JOIN bonus ON bonus.item_id = b.item_id""", "bonus"))
def experience_rows(t):
    valid = behaviors(t)
    bonus = cat.coverage_bonus(t.raw("part").select(F.col("p_partkey").alias("item_id")), cat.exposure(valid))
    return xp.experience_rows(valid, bonus).withColumn("aux_reward", F.round("aux_reward", 6))


@query("experience_batches", sql("""SELECT id, batch_no FROM (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100)
    AS BIGINT) AS batch_no, count(*) OVER () AS n FROM pool WHERE status = 'pending') WHERE batch_no < floor(n / 100)""",
    "behaviors", pool=_POOL))
def experience_batches(t):
    return xp.experience_batches(_pool(t)).select("id", F.col("batch_no").cast("bigint").alias("batch_no"))


@query("batch_metrics", sql("""SELECT batch_no, count(*) AS batch_size, round(avg(reward + aux), 4) AS avg_reward,
    round(count(*) FILTER (reward + aux > 0) / count(*), 4) AS positive_rate, round(avg(aux), 4) AS avg_aux_reward FROM (
    SELECT CAST(floor(b.event_id / 1000) AS BIGINT) AS batch_no, CASE WHEN behavior_type = 1 THEN round((score10 / 10 - 5) / 5, 4)
    WHEN behavior_type = 2 THEN 0.35 ELSE 0.15 END AS reward, 0.12 * coverage_bonus AS aux FROM behaviors b JOIN bonus ON
    bonus.item_id = b.item_id) GROUP BY 1""", "bonus"))
def batch_metrics(t):
    valid = behaviors(t)
    bonus = cat.coverage_bonus(t.raw("part").select(F.col("p_partkey").alias("item_id")), cat.exposure(valid))
    rows = xp.experience_rows(valid, bonus).withColumn("batch_no", F.floor(F.col("id") / 1000).cast("bigint"))
    return xp.batch_metrics(rows, ["batch_no"])


@query("bootstrap_experiences", sql("""SELECT event_id AS id, user_id, item_id, CASE WHEN behavior_type = 1
    THEN round((score10 / 10 - 5) / 5, 4) WHEN behavior_type = 2 THEN 0.35 ELSE 0.15 END AS reward,
    1 / (SELECT count(*) FROM part) AS old_prob FROM behaviors""", "behaviors"))
def bootstrap_experiences(t):
    no_model = t.raw("supplier").filter(F.col("s_suppkey") < 0)
    return xp.bootstrap_experiences(behaviors(t), t.raw("part"), no_model)


@query("experience_decode", sql("""SELECT event_id AS id, item_id AS first_state, coalesce(score10, -1) AS second_state,
    item_id / 1000 AS aux_reward FROM behaviors WHERE event_id % 5 <> 0""", "behaviors"))
def experience_decode(t):
    text = F.when(F.col("event_id") % 5 == 0, F.lit('{"aux_reward": 0.5}')).otherwise(
        F.format_string('{"state": [%d, %d], "score": null, "aux_reward": 0.%03d}', "item_id",
                        F.coalesce("score10", F.lit(-1)), "item_id"))
    rows = behaviors(t).select(F.col("event_id").alias("id"), text.alias("payload_json"))
    return xp.experience_decode(rows).select(
        "id", F.col("state")[0].cast("bigint").alias("first_state"), F.col("state")[1].cast("bigint").alias("second_state"),
        "aux_reward")


def _versions(t):
    return t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("model_"), F.col("s_nationkey")).alias("model_name"),
                                    F.col("s_name").alias("version_tag"))


def _activations(t):
    """One activation request per order; tags above the last supplier do not exist."""
    return t.raw("orders").select(F.col("o_orderkey").alias("seq"),
                                  F.format_string("Supplier#%09d", F.col("o_custkey")).alias("version_tag"))


_ACTIVE = """SELECT 'model_' || s_nationkey AS model_name, arg_max(s_name, o_orderkey) AS version_tag, arg_max(s_suppkey,
    o_orderkey) AS id, max(o_orderkey) AS activated_seq FROM orders JOIN supplier ON s_suppkey = o_custkey GROUP BY 1"""


@query("active_version", _ACTIVE)
def active_version(t):
    return ver.active_version(_versions(t), _activations(t))


@query("version_status", f"""SELECT s_suppkey AS id, 'model_' || s_nationkey AS model_name, s_name AS version_tag,
    s_suppkey IN (SELECT id FROM ({_ACTIVE})) AS is_active FROM supplier""")
def version_status(t):
    return ver.version_status(_versions(t), _activations(t))


@query("version_retention", """SELECT s_suppkey AS id, 'model_' || s_nationkey AS model_name, s_name AS version_tag, row_number()
    OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS age FROM supplier QUALIFY age <= 6""")
def version_retention(t):
    return ver.version_retention(_versions(t)).withColumn("age", F.col("age").cast("bigint"))


def _runs(t):
    """One run per day of events, one metric row per event kind."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    per = t.raw("events").groupBy(day.alias("id"), F.col("event_type").alias("algorithm")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("hi"), F.max("user_id").alias("u"),
        F.count_distinct("user_id").alias("d"), F.min("event_id").alias("e"))
    metric = F.struct("algorithm", F.col("n").cast("double").alias("precision_at_k"), F.col("hi").cast("double").alias("recall_at_k"),
                      F.col("u").cast("double").alias("ndcg_at_k"), F.col("d").cast("double").alias("coverage"),
                      F.col("e").cast("double").alias("diversity"))
    return per.groupBy("id").agg(F.collect_list(metric).alias("metrics")).withColumn(
        "created_at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp"))


_RUNS = """SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS id, event_type AS algorithm, count(*) AS n,
    count(*) FILTER (value > 10) AS hi, max(user_id) AS u, count(DISTINCT user_id) AS d, min(event_id) AS e FROM events GROUP BY 1, 2"""


@query("experiment_trend", sql("""SELECT algorithm, string_agg(n, ',' ORDER BY id) AS precision, string_agg(hi, ',' ORDER BY id)
    AS recall, string_agg(u, ',' ORDER BY id) AS ndcg, string_agg(d, ',' ORDER BY id) AS coverage, string_agg(e, ',' ORDER BY id)
    AS diversity, count(*) AS n_labels FROM runs WHERE id IN (SELECT DISTINCT id FROM runs ORDER BY id DESC LIMIT 20) GROUP BY 1""",
    runs=_RUNS))
def experiment_trend(t):
    trend = ver.experiment_trend(_runs(t))
    joined = [F.array_join(F.col(c).cast("array<bigint>").cast("array<string>"), ",").alias(c)
              for c in ("precision", "recall", "ndcg", "coverage", "diversity")]
    return trend.select("algorithm", *joined, F.size("labels").cast("bigint").alias("n_labels"))


@query("latest_run", sql("SELECT id, algorithm, n, u FROM runs WHERE id = (SELECT max(id) FROM runs)", runs=_RUNS))
def latest_run(t):
    return ver.latest_metrics(_runs(t)).select(F.col("id").cast("bigint").alias("id"), "algorithm",
                                               F.col("precision_at_k").cast("bigint").alias("n"),
                                               F.col("ndcg_at_k").cast("bigint").alias("u"))


@query("ingest_catalog", sql("""SELECT title, replace(types, '/', '/') AS types, CASE WHEN item_id % 5 = 0 THEN 0 ELSE rate END AS rate,
    release_year, CASE WHEN item_id % 3 = 0 THEN 0 ELSE duration END AS duration, coalesce(meta.directors, '未知导演') AS directors,
    coalesce(meta.country, '未知') AS country, coalesce(meta.casts, '未知主演') AS casts FROM items LEFT JOIN (SELECT title AS t,
    max(directors) AS directors, max(country) AS country, max(casts) AS casts FROM items WHERE title < 'm' GROUP BY 1) meta ON t = title""",
    "items"))
def ingest_catalog(t):
    """Scraped text rows of the catalogue with gaps, joined to known titles."""
    from marquee.sources.files import catalog_from_csv

    i = t.items()
    rows = i.select(
        F.concat(F.lit(" "), "title").alias("title"), F.replace(F.col("types"), F.lit("/"), F.lit(",")).alias("genre"),
        F.when(F.col("item_id") % 5 == 0, F.lit("-")).otherwise(F.col("rate").cast("string")).alias("rating"),
        F.col("release_year").cast("string").alias("release_year"),
        F.when(F.col("item_id") % 3 != 0, F.col("duration").cast("string")).alias("duration"), F.lit(None).cast("string").alias("summary"))
    meta = i.filter(F.col("title") < "m").groupBy("title").agg(*[F.max(c).alias(c) for c in ("directors", "country", "casts")])
    return catalog_from_csv(rows, meta).drop("summary")
