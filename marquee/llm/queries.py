"""Registered queries of this subpackage, op1 to op13, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").select(*columns)


@query("op1_exact_dedup", r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as s from documents),
     h as (select doc_id, s, sha256(s) as text_sha256 from t)
select doc_id, min(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
       doc_id = min(doc_id) over (partition by s) as kept, text_sha256 from h""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, folder, "documents", "doc_id", "text"), all_digests=True)


@query("op2_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents", "doc_id", "text"), path=public_tokenizers.path("word_bpe_49k.json"))


@query("op9_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.bpe import digests

    return digests(table(spark, folder, "documents", "doc_id", "text"), path=public_tokenizers.path("byte_bpe_50k.json")).drop("text")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op10_url_filter", r"""
with r as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                                 ('org', '/fr/', 'allow')) v(rule_host, rule_path, rule_verdict)),
     u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
     p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u)
select page_id, host, path, rule_host || rule_path as rule, coalesce(rule_verdict, 'allow') as verdict
from p left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
qualify row_number() over (partition by page_id order by length(rule_host) + length(rule_path) desc nulls last) = 1""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.url_filter import judge_urls, rules_table

    return judge_urls(table(spark, folder, "pages", "page_id", "url"), rules_table(spark, URL_RULES)).select(
        "page_id", "host", "path", "rule", "verdict")


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.quality import fit, fold

    docs = table(spark, folder, "documents", "doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit(docs, table(spark, folder, "labels", "doc_id", "quality"), usable=~held_out)
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_html_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.site_style import extract

    return extract(table(spark, folder, "pages", "page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_top_k")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.bit_sliced import top_k

    return top_k(table(spark, folder, "embeddings", "vec_id", "embedding"), k=20, query=F.col("vec_id") % 20 == 0)


@query("op6_suffix_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, folder, "documents", "doc_id", "text"), length=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op7_ngram_join")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@query("op8_lm_score")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.kneser_ney import score, train
    from marquee.llm.quality import fold

    docs = table(spark, folder, "documents", "doc_id", "text")
    held_out = fold(F.col("doc_id"), 10) == 0
    return score(docs, train(docs.filter(~held_out))).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.alignment import alignments

    return alignments(table(spark, folder, "documents", "doc_id", "text"), path_a=public_tokenizers.path("byte_bpe_50k.json"),
                      path_b=public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_prefix_trie", r"""
with tab as (select list(c order by n) as of_byte from (
         select n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) as c
         from (select unnest(range(256)) as n))),
     t as (select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as turn_key,
                  octet_length(encode(coalesce(text, ''))) as n_bytes,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place
           from conversations where conv_id is not null),
     c as (select conv_id, conv_id - conv_id % 5 as base, cast(conv_id as varchar) as s from t group by conv_id),
     h as (select conv_id, base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda k: ascii(substr(s, k, 1)))),
                  lambda a, b: xor(a >> 8, of_byte[(xor(a, b) & 255) + 1])), 4294967295) % 9 as shared from c, tab),
     taken as (select h.conv_id, t.place, turn_key, n_bytes from h join t on t.conv_id = h.base and t.place < h.shared),
     n_taken as (select conv_id, count(*) as n from taken group by conv_id),
     own as (select h.conv_id, coalesce(n, 0) + t.place - shared as place, turn_key, n_bytes
             from h join t on t.conv_id = h.conv_id left join n_taken on n_taken.conv_id = h.conv_id where t.place >= shared),
     turns as (select * from taken union all select * from own),
     depths as (select conv_id, place + 1 as depth, n_bytes, string_agg(turn_key, ',') over (partition by conv_id order by place) as key,
                       count(*) over (partition by conv_id) as n_turns from turns
                union all select conv_id, 0, 0, '', (select count(*) from turns where turns.conv_id = h.conv_id) from h),
     nodes as (select depth, key, min(conv_id) as conv_id, count(*) as n_convs, max(n_bytes) as n_bytes,
                      sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n_turns = depth), '')) as ends_sha256
               from depths group by depth, key),
     linked as (select nodes.*, p.key as up, p.conv_id as parent_conv_id from nodes
                left join nodes p on nodes.depth > 0 and p.depth = nodes.depth - 1 and p.key = substr(nodes.key, 1, greatest(0, 65 * (nodes.depth - 1) - 1))),
     kids as (select depth - 1 as depth, up as key, count(*) as n_children from linked where depth > 0 group by all),
     marked as (select linked.*, coalesce(n_children, 0) as n_children from linked left join kids using (depth, key)),
     sums as (select d as depth, substr(key, 1, greatest(0, 65 * d - 1)) as key, sum(case when n_children = 0 then 1 else 0 end) as n_leaves,
                     sum((n_convs - 1) * n_bytes) as saved_tokens from (select *, unnest(range(0, depth + 1)) as d from marked) group by all)
select conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, ends_sha256 from marked join sums using (depth, key)""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


@query("op13_language_id")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from marquee.llm.language_id import train
    from marquee.llm.quality import fold

    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    return train(docs, usable=~held_out).predict(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
