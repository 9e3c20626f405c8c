"""Tokenising and text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Feature stop words.
FEATURE_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "of", "for", "with",
    "我", "你", "他", "她", "它", "这", "那", "的", "了", "是", "在", "也", "有", "不", "就",
)

# Words each token also stands for.
SYNONYMS = {
    "悬疑": ("惊悚", "推理"),
    "惊悚": ("悬疑", "紧张"),
    "科幻": ("未来", "宇宙", "设定"),
    "犯罪": ("黑帮", "人性"),
    "剧情": ("叙事", "人物"),
    "亲情": ("治愈", "情感"),
    "dream": ("mind_bending", "sci_fi"),
    "sci-fi": ("future", "space"),
    "thriller": ("suspense", "mystery"),
    "mystery": ("thriller", "suspense"),
}

# Keyword found in a summary -> tag, in vocabulary order.
KEYWORD_TAGS = {
    "剧情": "drama",
    "悬疑": "suspense",
    "反转": "plot_twist",
    "镜头画面": "cinematic",
    "爱情": "romance",
    "亲情": "family_bond",
    "友情": "friendship",
    "治愈温暖": "heartwarming",
    "悲伤感动": "emotional",
    "紧张刺激": "thrilling",
    "慢热": "slow_burn",
    "节奏激烈": "fast_paced",
    "科幻": "sci_fi",
    "世界观": "world_building",
    "人性成长": "human_nature",
}

# English function words dropped from description similarity and term counts; callers may pass their own.
ENGLISH_STOP_WORDS = tuple("""
about above after again against all also am an and any are as at be because been before being below between
both but by can could did do does doing down during each few for from further had has have having he her here
hers herself him himself his how if in into is it its itself just me more most my myself no nor not now of off
on once only or other our ours ourselves out over own same she should so some such than that the their theirs
them themselves then there these they this those through to too under until up very was we were what when where
which while who whom why will with would you your yours yourself yourselves
""".split())

_SPACE = r"(?U)\s+"


def words(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def normalize_whitespace(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "))


def split_list(value: Column) -> Column:
    """``/`` separated list without its empty parts."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), "/"), lambda x: x != "")


def split_multi(value: Column, separator: str = "/") -> Column:
    """List separated by ``separator`` or comma, trimmed, without empty parts."""
    unified = F.replace(F.coalesce(value, F.lit("")), F.lit(","), F.lit(separator))
    return F.filter(F.transform(F.split(unified, separator), lambda x: F.btrim(x)), lambda x: x != "")


def distinct_sorted_list(value: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(split_multi(value))), "/")


def trimmed_list(value: Column) -> Column:
    return F.array_join(split_multi(value), "/")


def normalize_token(token: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(token)), "[^0-9a-zA-Z一-龥_+-]+", "")


def semantic_tokens(text: Column) -> Column:
    """Split on space and punctuation, lower-case, strip foreign characters, drop empties."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)[\s,，。/；;：:()（）|]+")
    return F.filter(F.transform(parts, normalize_token), lambda x: x != "")


def with_synonyms(tokens: Column, synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> Column:
    """Each token followed by its synonyms."""
    table = F.create_map(*[c for k, v in synonyms.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none))))


def first(values: Column, head: int | None) -> Column:
    """The first ``head`` values, or all of them."""
    return values if head is None else F.slice(values, 1, head)


def item_tokens(title: Column, types: Column, directors: Column, country: Column, summary: Column, *, head: int | None = None) -> Column:
    """Title, list values and summary tokens (all, or the first ``head``), with synonyms."""
    lists = [F.filter(F.transform(split_list(c), normalize_token), lambda x: x != "")
             for c in (types, directors, country)]
    return with_synonyms(F.concat(semantic_tokens(title), *lists, first(semantic_tokens(summary), head)))


def feature_tokens(text: Column, *, stop_words: Sequence[str] = FEATURE_STOP_WORDS, head: int | None = None) -> Column:
    """Lower-case tokens (all, or the first ``head``) longer than one character that are not stop words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s,，。/；;：:()（）.!?]+")
    kept = F.filter(parts, lambda t: (F.char_length(t) > 1) & ~t.isin(*stop_words))
    return first(kept, head)


def attribute_tokens(types: Column, directors: Column, country: Column, summary: Column, *, head: int | None = None) -> Column:
    """Distinct lower-case list values and summary words (all, or the first ``head``)."""
    lists = [F.transform(split_list(c), lambda x: F.lower(x)) for c in (types, directors, country)]
    spaced = F.translate(F.coalesce(summary, F.lit("")), "，。", "  ")
    summary_words = first(F.filter(F.split(spaced, _SPACE), lambda t: t != ""), head)
    return F.array_distinct(F.concat(*lists, F.transform(summary_words, lambda x: F.lower(x))))


def keyword_tags(text: Column, table: Mapping[str, str] = KEYWORD_TAGS, *, most: int | None = None) -> Column:
    """Tags (all, or the first ``most``) whose keyword occurs in the text, in vocabulary order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("tag")) for k, v in table.items()])
    body = F.coalesce(text, F.lit(""))
    found = F.filter(pairs, lambda p: F.contains(body, p["key"]))
    return first(F.transform(found, lambda p: p["tag"]), most)


def term_frequency(texts, column: str, *, n: int | None = 200, stop_words: Sequence[str] = ENGLISH_STOP_WORDS):
    """Most frequent words of a text column: term, n."""
    terms = texts.select(F.explode(words(F.col(column))).alias("term")).filter(~F.col("term").isin(*stop_words))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts if n is None else counts.orderBy(F.col("n").desc(), "term").limit(n)
