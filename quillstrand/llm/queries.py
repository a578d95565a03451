"""The queries of this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, scratch_path
from . import centroids, chat, collocations, oracles, packing, piece_codec, quality_rules, simhash, sketches, substring, topk, url_filter, warc, weak_quality

#: The rules that the URL query judges by.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; the folder is no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), HOST_RULES, keep=["page_id"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), packing.Packing(tokenizer("byte_bpe_50k.json")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality_classifier(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id"])


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.judged(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    return out.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in quality_rules.BASE], "base_failed", "kept")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.checked(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), piece_codec.Dropout(rate=0.1, seed=8))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    return warc.judged(spark, path).withColumnRenamed("id", "page_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of up to three turns each, judged by what the other half of the conversations teaches."""
    raw = chat.transcripts(read_table(spark, sf_dir, "conversations"))
    spec, rest = chat.Chat(folds=2), ["conv_id", "turn", "truth"]
    cut = chat.chunks(raw, "conv_id", "turn", "text", spec, rest)
    out = chat.judged(cut, chat.fit(cut, "truth", spec.folds), rest)
    return out.select("conv_id", "turn", "turns", F.array_join("roles", ",").alias("roles"), (F.col("roles") == F.col("truth.role")).alias("agrees"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.judged(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_packing, op3_simhash, op4_quality_classifier, op5_topk, op6_substring_dedup, op7_quality_rules, op8_sentencepiece, op9_warc, op10_chat_format, op11_fingerprints, op12_collocations, op13_kmeans)}

_GENERIC = "|".join(r.pattern for r in url_filter.GENERIC).replace(r"(?<![0-9a-z])", r"(?:^|[^0-9a-z])").replace(r"(?![0-9a-z])", r"(?:[^0-9a-z]|$)")

ORACLES = {
    "op1_url_filter": f"""
with rest as (
  select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as r from pages
), parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(regexp_replace(r, '^[^/?#]*', ''), '^[^?#]*') as path from rest
), judged as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/'
  end as rule from parts
)
select page_id, host, path, rule, case
  when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when regexp_matches(lower(host || path), '{_GENERIC}') then 'block' else 'allow' end as verdict
from judged""",
    "op5_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 5""",
    "op6_substring_dedup": r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), windows as (
  select doc_id, i, array_to_string(words[i:i + 49], ' ') as win from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)
), firsts as (select win, min(doc_id) as first from windows group by win),
hits as (select doc_id, i from windows join firsts using (win) where doc_id > first),
gone as (select distinct doc_id, i + k as pos from hits, (select unnest(range(0, 50)) as k)),
gone_lists as (select doc_id, list(pos) as ats from gone group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(ats), 0) as bigint) as n_removed,
  sha256(array_to_string(case when ats is null then words else [words[j] for j in range(1, len(words) + 1) if not list_contains(ats, j)] end, ' ')) as kept_sha256
from w left join gone_lists using (doc_id)""",
    "op7_quality_rules": rf"""
with d as (
  select doc_id, lang, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), grams as (select doc_id, i, words[i:i + 2] as g from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from d where len(words) >= 3)
), again as (select doc_id, i from grams join (select doc_id, g from grams group by all having count(*) > 1) using (doc_id, g)
), covered as (select doc_id, count(distinct i + k) as n from again, (select unnest(range(3)) as k) group by 1
), rows as (select doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
), lines as (select doc_id, count(*) as n, count(*) - count(distinct line) as dups, count(*) filter (where w <= 2) as short from rows where w > 0 group by 1
), base as (
  select doc_id, lang, cast(len(words) as bigint) as n_words, cast(list_sum(list_transform(words, lambda x: length(x))) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(dups, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, coalesce(lines.n, 0) as n_lines, coalesce(short, 0) as short,
    len(list_filter(words, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 4 and not regexp_matches(x, '[a-z]'))) as shouts
  from d left join lines using (doc_id) left join covered c using (doc_id)
), m as (
  select * replace (coalesce(word_chars, 0) as word_chars), n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    [least(n_symbols * {quality_rules.STEPS} // greatest(n_words, 1), {quality_rules.STEPS}), n_dup_lines * {quality_rules.STEPS} // (greatest(n_lines, 1) + 8), n_repeat_words * {quality_rules.STEPS} // (greatest(n_words, 1) + 40),
     shouts * {quality_rules.STEPS} // greatest(n_words, 1), short * {quality_rules.STEPS} // greatest(n_lines, 1)] as v from base
), good as (select doc_id from labels where doc_id is not null and quality is not null group by 1 having min(quality) = 1 and max(quality) = 1
), seen as (select lang, k, v[k] as x from m semi join good using (doc_id), (select unnest(range(1, 6)) as k) where not base_failed
), strata as (select count(distinct coalesce('=' || lang, '')) as n from seen
), sizes as (select lang, k, count(*) as n from seen group by 1, 2
), over as (select lang, k, n, c, (select count(*) from seen s where s.lang is not distinct from sizes.lang and s.k = sizes.k and s.x > c) as a from sizes, (select unnest(range({quality_rules.STEPS})) as c)
), judged as (
  select lang, k, c, o.n > 0 and a <= 0.01 * o.n and (select sum(exp(lgamma(o.n + 1) - lgamma(i + 1) - lgamma(o.n - i + 1) + i * ln(0.01) + (o.n - i) * ln(0.99))) from (select unnest(range(a + 1)) as i)) <= 0.05 / (5 * strata.n) as passes
  from (select lang, k, c, n, a from over) o, strata
), cutoffs as (select lang, k, coalesce(max(case when not passes then c end) + 1, 0) as cut from judged group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from cutoffs c where c.lang is not distinct from m.lang and c.cut < {quality_rules.STEPS} and m.v[c.k] > c.cut) as kept from m""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as n, sha1(body) as h, min(page_id) over (partition by body) as first from p),
b as (
  select *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, 1 + 5 * (k // 4), 5) as bigint) >> (15 - 5 * (k % 4))) & 31 as bigint), 1) for k in range(0, 32)], '') as digest from d
)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to from b""",
    "op12_collocations": oracles.phrase_sql(),
    "op13_kmeans": oracles.centroid_sql(),
}
