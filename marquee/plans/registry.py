"""Registered queries and the SQL that defines their expected results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Table adapters as SQL, mirroring marquee.sources.tables.
VIEWS = {
    "comments": """SELECT conv_id AS item_id, turn, CASE WHEN conv_id % 3 <> 0 THEN conv_id * 17 + turn END AS user_id,
        text AS content FROM conversations WHERE role = 'user'""",
    "users": "SELECT c_custkey AS user_id, c_name AS name FROM customer",
    "items": """SELECT p_partkey AS item_id, p_name AS title, p_type || '/' || split_part(p_name, ' ', 2) AS types,
        p_brand AS directors, n_name AS country, replace(p_name, ' ', '/') AS casts,
        round((p_retailprice - 900) / 10, 2) AS rate, 1950 + p_size AS release_year, 60 + 2 * p_size AS duration,
        documents.text AS summary, coalesce(cc.n, 0) AS comment_len
        FROM part LEFT JOIN nation ON n_nationkey = p_size % 25 LEFT JOIN documents ON doc_id = p_partkey
        LEFT JOIN (SELECT item_id, count(*) AS n FROM comments GROUP BY 1) cc ON cc.item_id = p_partkey""",
    "rating_log": """SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity AS BIGINT) * 2 AS score10,
        o_orderdate AS ts, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ratings": """SELECT user_id, item_id, score10, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
        ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, score10 DESC) AS rn FROM rating_log) WHERE rn = 1""",
    "interactions": """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
        CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END AS behavior_type,
        CASE WHEN event_type = 'purchase' THEN least(100, CAST(floor(value) AS BIGINT)) END AS score10, ts
        FROM events""",
    "behaviors": """SELECT interactions.* FROM interactions JOIN part ON p_partkey = item_id WHERE behavior_type IN (1, 2, 3)
        AND (behavior_type <> 1 OR score10 BETWEEN 0 AND 100)""",
    "exposures": "SELECT item_id, count(*) AS exposure FROM behaviors GROUP BY 1",
    "bonus": """SELECT p_partkey AS item_id, coalesce(exposure, 0) AS exposure, round(1 - coalesce(exposure, 0) /
        greatest((SELECT max(exposure) FROM exposures), 1), 4) AS coverage_bonus
        FROM part LEFT JOIN exposures ON item_id = p_partkey""",
}


def sql(body: str, *views: str, **extra: str) -> str:
    """``WITH`` the named adapter views (and what they need), then ``extra`` ones, before ``body``."""
    needs = {"items": ["comments"], "ratings": ["rating_log"], "behaviors": ["interactions"],
             "exposures": ["interactions", "behaviors"], "bonus": ["interactions", "behaviors", "exposures"]}
    order: list[str] = []
    for view in views:
        for name in [*needs.get(view, []), view]:
            if name not in order:
                order.append(name)
    parts = [f"{name} AS ({VIEWS[name]})" for name in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def half_up(value: Column, digits: int) -> Column:
    """Rounded half up in whole units; a decimal tie whose binary value lies a hair below it counts as one."""
    return F.floor(value * 10.0**digits + 0.5 + 1e-6) / 10.0**digits


def half_up_sql(value: str, digits: int) -> str:
    return f"floor(({value}) * 1e{digits} + 0.5 + 1e-6) / 1e{digits}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


def behaviors(t: Tables) -> DataFrame:
    """Accepted behaviour events."""
    from marquee.operators import interactions as ix

    return ix.accepted(ix.validate_interactions(t.interactions(), t.raw("part").selectExpr("p_partkey AS item_id")))
