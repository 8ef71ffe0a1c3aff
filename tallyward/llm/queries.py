"""The operators of this package as queries over the given tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.alignment import align_documents
from tallyward.llm.bpe_chunks import encode_documents
from tallyward.llm.conversation_repair import damage_conversations, repair_conversations
from tallyward.llm.decontaminate import contamination
from tallyward.llm.embedding import embedding_near_duplicates
from tallyward.llm.language import identify_language
from tallyward.llm.licences import FILE_SHARE, TEMPLATES, scan_licences
from tallyward.llm.packing import pack_documents
from tallyward.llm.quality import score_quality
from tallyward.llm.secret_scan import scan_secrets
from tallyward.llm.simhash import simhash_near_duplicates
from tallyward.llm.storage import ship, table
from tallyward.llm.url_rules import judge_urls
from tallyward.llm.warc import archive_round_trip


def op1_cover_tree_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_indexed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), F.col("source"))
    return found.select("doc_id", "ordinal", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op6_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths of their own: they lie as ``source/language/id.txt``; one that is mostly licence lines speaks for its directory."""
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licences(table(spark, sf_dir, "documents"), path, file_share=FILE_SHARE)


def op9_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op11_byte_incidence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))


def op12_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_grammar_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage_conversations(table(spark, sf_dir, "conversations")))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {query.__name__: _shipped(query) for query in (
    op1_cover_tree_embeddings,
    op2_hierarchical_packing,
    op3_chunked_warc,
    op4_token_indexed_urls,
    op5_forest_secrets,
    op6_hierarchical_language,
    op7_nbsvm_quality,
    op8_licence_inheritance,
    op9_wu_manber_decontamination,
    op10_simhash_popcount,
    op11_byte_incidence_alignment,
    op12_chunked_bpe,
    op13_grammar_conversation_repair,
)}

_WORDS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_ABLE = """label is not null and vec_id is not null and len(embedding) > 0
  and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))"""

OP1_SQL = f"""
with recursive able as (select vec_id, label, cast(embedding as double[]) as v from embeddings where {_ABLE}),
links as (
  select a.vec_id as a, b.vec_id as b from able a join able b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(vec_id, other) as (
  select vec_id, vec_id from able union select r.vec_id, l.b from reach r join links l on r.other = l.a),
roots as (select vec_id, min(other) as component_id from reach group by vec_id),
counts as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(component_id, e.vec_id) as component_id,
  coalesce(component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join roots using (vec_id) left join counts using (vec_id)
"""

OP3_SQL = """
with payloads as (select page_id, coalesce(html, '') as p from pages),
measured as (select page_id, cast(strlen(p) as bigint) as payload_bytes, sha256(p) as payload_digest from payloads),
leaders as (select payload_digest, min(page_id) as leader from measured where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, m.payload_digest,
  case when leader is null or leader = page_id then 'response' else 'revisit' end as record_type,
  case when leader <> page_id then leader end as refers_to
from measured m left join leaders l on m.payload_digest = l.payload_digest
"""

OP4_SQL = r"""
with cut as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
rules as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) as r(h, p, v)),
fits as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from cut join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
own as (select *, host || path as t from cut)
select page_id, host, path, rule, coalesce(v, case when
    regexp_matches(t, '^(?:[^/]*\.)?(?:spam-|ads\.|adserver\.|tracker\.|casino\.)') or contains(t, '/casino/') or contains(t, '/poker/')
    or contains(t, '/porn/') or contains(t, '/xxx/') or contains(t, '-casino-') or contains(t, '-poker-') or contains(t, '/wp-login.php')
    or t like '%/affiliate/%/click/%' then 'block' else 'allow' end) as verdict
from own left join fits using (page_id)
"""

_TEMPLATE_ROWS = ", ".join(f"('{name}#{i}', '{name}', '{text}')" for name, texts in TEMPLATES.items() for i, text in enumerate(texts))
_LICENCE_WORDS = ("(?i)licen[sc]e|all rights reserved|copyright|creative commons|free software|permission is hereby|redistribution and use|"
                  "proprietary and confidential")

# The paths of op8 have no directories but source/language that could hold a licence file, and no line with licence words is longer than a piece.
OP8_SQL = f"""
with placed as (
  select doc_id, concat_ws('/', source, lang, doc_id || '.txt') as path, concat_ws('/', source, lang) as directory, coalesce(text, '') as text from documents),
cut as (select doc_id, length(text) as size, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) as line from placed),
candidates as (select * from cut where regexp_matches(line, '{_LICENCE_WORDS}')),
lines as (select distinct line from candidates),
templates as (select * from (values {_TEMPLATE_ROWS}) as t(template, licence, line)),
worded as (
  select line as item, null as licence, false as model, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+(?:\\.[0-9]+)*') as w from lines
  union all select template, licence, true, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+(?:\\.[0-9]+)*') from templates),
terms as (
  select item, licence, model, term, count(*) as tf from (
    select item, licence, model, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from worded)
  group by all),
weighed as (
  select t.*, tf * idf as v from terms t join (
    select term, ln((1.0 + (select count(*) from worded)) / (1.0 + count(*))) + 1.0 as idf from terms group by term) using (term)),
norms as (select item, model, sqrt(sum(v * v)) as norm from weighed group by item, model),
scored as (
  select a.item as line, b.licence, round(sum(a.v * b.v) / (any_value(na.norm) * any_value(nb.norm)), 9) as score
  from weighed a join weighed b on a.term = b.term and not a.model and b.model
  join norms na on na.item = a.item and not na.model join norms nb on nb.item = b.item and nb.model group by a.item, b.item, b.licence),
known as (
  select line, licence, score from scored where score >= 0.6
  qualify row_number() over (partition by line order by score desc, licence) = 1),
hits as (select distinct doc_id, size, line, licence, score from candidates join known using (line)),
own as (
  select doc_id, first(licence order by score desc, licence) as own, max(score) as own_score, sum(length(line)) / any_value(size) as share
  from hits group by doc_id),
votes as (
  select directory, own, count(*) as n, min(own_score) as score from own join placed using (doc_id) where share >= 0.3 group by directory, own),
declared as (select * from votes qualify row_number() over (partition by directory order by n desc, own, score) = 1)
select p.doc_id, p.path, coalesce(o.own, d.own) as licence, coalesce(o.own_score, d.score) as score,
  case when o.own is not null then 'own' when d.own is not null then 'inherited' else 'none' end as how,
  case when o.own is null then d.directory end as from_directory
from placed p left join own o using (doc_id) left join declared d on p.directory = d.directory
"""

OP9_SQL = f"""
with docs as (select doc_id, coalesce({_WORDS}, []) as w from documents),
items as (select item_id, {_WORDS} as w from benchmark where text is not null),
windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as gram
  from items, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as s(i) where len(w) > 0),
sizes as (select distinct n from windows),
grams as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as gram
  from docs, sizes, unnest(generate_series(1, len(w) - n + 1)) as s(i)),
found as (select g.doc_id, g.i, g.n, x.item_id from grams g join windows x on g.n = x.n and g.gram = x.gram),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from found) group by doc_id),
listed as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hits using (doc_id) left join listed using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_cover_tree_embeddings": OP1_SQL,
    "op3_chunked_warc": OP3_SQL,
    "op4_token_indexed_urls": OP4_SQL,
    "op8_licence_inheritance": OP8_SQL,
    "op9_wu_manber_decontamination": OP9_SQL,
}
