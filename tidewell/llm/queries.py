"""The registered queries of this folder, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontam, fim, hardneg, html, langid, license, neardup, pack, quality, rules, shard, simhash, store
from tidewell.llm.bpe import vocabulary_path
from tidewell.session import scratch, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    store.write_store(table(spark, sf_dir, "documents"), path, tokenizer=vocabulary_path("word_bpe_49k.json"), end_id=2)
    return store.summarise(spark, path).withColumnRenamed("key", "doc_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.contract(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.contract(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.contract(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.contract(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.contract(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.contract(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.contract(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.contract(table(spark, sf_dir, "documents"))


def op13_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contract(table(spark, sf_dir, "documents"))


def rules_base_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op6_quality_rules`` measures, without the learned verdict, so that SQL can say it too."""
    m = rules.measured(table(spark, sf_dir, "documents"))
    return m.select(F.col("k").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base places and labels of ``op7_license_scan``, without the method's own labels."""
    return license.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_OPERATORS = (op1_token_store, op2_decontamination, op3_minimax_shards, op4_quality_classifier, op5_near_duplicates, op6_quality_rules, op7_license_scan, op8_language_id, op9_packing, op10_main_text, op11_hard_negatives, op12_fill_in_middle, op13_simhash_classes)
QUERIES = {f.__name__: f for f in (*_OPERATORS, rules_base_numbers, license_base_places)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: SQL can't express the other operators on whole tables; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, 13 as n, array_to_string(w[pos : pos + 12], ' ') as p from (select item_id, w, unnest(generate_series(1, len(w) - 12)) as pos from i where len(w) >= 13)
  union select item_id, len(w), array_to_string(w, ' ') from i where len(w) between 1 and 12),
sizes as (select distinct n from windows),
places as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as pos from d, sizes where len(w) >= n),
hits as (select doc_id, pos, places.n, item_id from places join windows on places.n = windows.n and array_to_string(w[pos : pos + places.n - 1], ' ') = p),
hit as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(generate_series(pos, pos + n - 1)) as word from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits where item_id is not null) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join named using (doc_id)""",
    "op11_hard_negatives": """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.id as anchor, b.id, a.label = b.label as alike, cast(list_inner_product(a.q, b.q) as bigint) as s from v a join v b on a.id <> b.id where a.id % 100 = 0),
positives as (select anchor, id, s from (select *, row_number() over (partition by anchor order by s desc, id) as place from scores where alike) where place <= 5),
windows as (
  select p.anchor, p.id as positive, p.s as ps, n.id as negative, n.s as ns, row_number() over (partition by p.anchor, p.id order by n.s desc, n.id) as place
  from positives p join scores n on p.anchor = n.anchor where not n.alike and 30 * p.s <= 100 * n.s and 100 * n.s <= 90 * p.s)
select anchor as anchor_id, positive as positive_id, cast(place as integer) as rank, negative as negative_id, ps as positive_score, ns as negative_score from windows where place <= 10""",
    "op12_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
t as (select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w from d),
n as (select *, len(w) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from n),
p as (select doc_id, n, form, text, array_to_string(w[1 : a], '') as pre, array_to_string(w[a + 1 : b], '') as mid, array_to_string(w[b + 1 :], '') as suf from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256
from p""",
    "rules_base_numbers": r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, pos, array_to_string(w[pos : pos + 4], ' ') as p from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as pos from d where len(w) >= 5)),
often as (select doc_id, pos from windows join (select doc_id, p from windows group by doc_id, p having count(*) > 1) using (doc_id, p)),
repeats as (select doc_id, count(distinct word) as n from (select doc_id, unnest(generate_series(pos, pos + 4)) as word from often) group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
dups as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  coalesce(dups.n, 0) as n_dup_lines, coalesce(repeats.n, 0) as n_repeat_words, len(w) < 10 or 100 * coalesce(repeats.n, 0) > 20 * len(w) as base_failed
from d left join repeats using (doc_id) left join dups using (doc_id)""",
    "license_base_places": f"""
with d as (select doc_id, {_WORDS} as w from documents),
phrases as (select * from (values ('cc by', 2, 'cc-by'), ('general public license', 3, 'gpl'), ('all rights reserved', 3, 'reserved')) v(p, n, label)),
hits as (select doc_id, pos - 1 as pos, label from (select doc_id, w, unnest(generate_series(1, len(w))) as pos from d), phrases where array_to_string(w[pos : pos + n - 1], ' ') = p),
found as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels from d left join found using (doc_id)""",
}
