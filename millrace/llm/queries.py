"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents."""
    from millrace.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of each document by 13-word windows of benchmark items."""
    from millrace.llm.winnow import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of documents, read back from its token files."""
    from millrace.llm.tokens import token_report

    return token_report(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents."""
    from millrace.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of the base kinds, a digest of their spans, and all spans."""
    from millrace.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of documents."""
    from millrace.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page's revisit record, read from WARC bytes, resolves to."""
    from millrace.llm.warc import captures, read_records, resolve

    found = resolve(read_records(captures(table(spark, sf_dir, "pages"))))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda h: F.concat_ws(": ", h["key"], h["value"]))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):", 1).try_cast("long")
    return found.select(page("record_id").alias("page_id"), "canonical", "outcome", page("response_id").alias("response_page_id"), "status", F.array_join(lines, "\n").alias("headers"), "body_length", "body_sha256")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, a digest of their spans, and all spans."""
    from millrace.llm.secrets import BASE, joined, scan

    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed line numbers of every row of documents."""
    from millrace.llm.linejoin import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the risk-controlled rules for every row of documents."""
    from millrace.llm.rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_quality_classifier, op2_benchmark_decontamination, op3_token_files, op4_simhash_near_dedup, op5_pii, op6_sentencepiece, op7_warc_revisits, op8_secret_scan, op9_line_dedup, op10_quality_rules)
    }


_CONTAMINATION = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (
  select item_id::varchar as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') as g
  from (select *, unnest(range(0, greatest(len(w) - 13, 0) + 1)) as i from b where len(w) > 0)),
dw as (
  select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as g
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from w, (select distinct n from bw) where len(w) >= n)),
hit as (select distinct doc_id, i, n, g from dw semi join bw using (n, g)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
it as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, item_id from hit join bw using (n, g)) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from w left join pos using (doc_id) left join it using (doc_id)
"""


_REPEATED_LINES = r"""
with d as (select row_number() over (order by doc_id nulls last) as r, doc_id, string_split(text, chr(10)) as l from documents),
s as (select r, i, lower(regexp_replace(l[i + 1], '[\t\x0B\f\r]', ' ', 'g')) as s from (select r, l, unnest(range(0, len(l))) as i from d)),
w as (select r, i, list_sort(list_distinct(list_filter(string_split(s, ' '), lambda x: x <> ''))) as w from s),
o as (select r, i, w, row_number() over (order by r, i) as o from w where len(w) > 0),
c as (select w, len(w) as n, min(o) as o from o group by w),
u as (select o, n, unnest(w) as t from c),
f as (select t, count(*) as df from u group by t),
p as (select o, n, t from u join f using (t) qualify row_number() over (partition by o order by df, t) <= n - (4 * n + 4) // 5 + 1),
m as (select distinct a.o as a, b.o as b from p a join p b on a.t = b.t and a.o > b.o and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
later as (select distinct a.o from m join c a on a.o = m.a join c b on b.o = m.b where 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
gone as (
  select r, list(i::int order by i) as removed
  from o join (select w, o as first, o in (select o from later) as late from c) using (w) where late or o > first group by r)
select doc_id, coalesce(len(l), 0) as n_lines, coalesce(len(removed), 0) as n_removed, coalesce(removed, []::int[]) as removed from d left join gone using (r)
"""


def _secrets_sql() -> str:
    """Each rule's matches and the gaps between them; a match starts after all gaps and matches before it."""
    from millrace.llm.secrets import ADDED, BASE

    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    rules = [(i, r, quoted(r.search or r.pattern)) for i, r in enumerate((*BASE, *ADDED))]
    matches = " union all ".join(f"select doc_id, {i} as ord, '{r.kind}' as kind, regexp_extract_all(t, {p}) as m, regexp_split_to_array(t, {p}) as g from d" for i, r, p in rules)
    held = " ".join(f"when {i} then length(regexp_extract(s, {p}, {r.group})) >= {r.least}" for i, r, p in rules)
    counts = ", ".join(f"count(*) filter (ord = {i}) as n_{r.kind}" for i, r in enumerate(BASE))
    said = "string_agg(kind || ':' || a || ':' || (a + length(s)), ',' order by a, ord)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
r as ({matches}),
x as (
  select doc_id, ord, kind, m[k] as s, coalesce(list_sum(list_transform(g[1:k], lambda z: length(z))), 0)::bigint + coalesce(list_sum(list_transform(m[1:k-1], lambda z: length(z))), 0)::bigint as a
  from (select *, unnest(range(1, len(m) + 1)) as k from r)),
y as (select * from x where case ord {held} end),
z as (select doc_id, {counts}, {said} filter (ord < {len(BASE)}) as base, {said} as spans from y group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join z using (doc_id)
"""


def _revisits_sql() -> str:
    """Each page's revisit and the latest response before it, from the page alone, without any WARC bytes."""
    pattern = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?@]*@)?([^/?:]*)(?::(\d+))?([^?]*)(?:\?(.*))?$'"
    part = lambda i: f"regexp_extract(b, {pattern}, {i})"
    host = rf"regexp_replace(lower({part(2)}), '^www\d?\.|\.$', '', 'g')"
    port = f"case when {part(3)} = '' or lower({part(1)}) || ':' || {part(3)} in ('http:80', 'https:443') then '' else ':' || {part(3)} end"
    path = f"regexp_replace(regexp_replace({part(4)}, '/+', '/', 'g'), '/$', '')"
    tracking = "'ref', 'fbclid', 'gclid', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'sessionid'"
    asked = f"list_sort(list_filter(string_split({part(5)}, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({tracking})))"
    query = f"case when len({asked}) > 0 then '?' || array_to_string({asked}, '&') else '' end"
    canonical = f"case when {host} <> '' then {host} || {port} || {path} || {query} else b end"
    date = "strftime(make_timestamp({} * 1000000), '%a, %d %b %Y %H:%M:%S GMT')"
    return rf"""
with p as (
  select page_id, coalesce(url, '') as u, coalesce(html, '') as html, 1600000000 + (page_id * 7919) % 1000000 as t,
    case when page_id % 7 = 3 then md5(coalesce(html, '') || 'changed') else md5(coalesce(html, '')) end as seen from pages),
f as (select page_id, t, html, regexp_replace(trim(u), '#.*$', '') as b from p),
r as (select page_id, t, html, 'urn:page:' || page_id || ':response' as id, {canonical} as c from f),
g as (
  select page_id, t + (page_id % 5 - 1) * 50000 + 1 as t, seen, regexp_replace(trim(case when starts_with(u, 'https:') then 'http' || u[6:] when starts_with(u, 'http:') then 'https' || u[5:] else u end), '#.*$', '') as b from p),
v as (select page_id, t, seen, 'urn:page:' || page_id || ':revisit' as id, {canonical} as c from g),
j as (
  select v.page_id, v.c, v.t, v.seen, r.page_id as rp, r.t as rt, r.html
  from v left join r on r.c = v.c and (r.t < v.t or r.t = v.t and r.id < v.id)
  qualify row_number() over (partition by v.page_id order by r.t desc nulls last, r.id desc) = 1),
o as (select *, case when rp is null then 'missing' when seen = md5(html) then 'resolved' else 'mismatch' end as outcome from j)
select page_id, c as canonical, outcome, case when outcome = 'resolved' then rp end as response_page_id, case when outcome = 'resolved' then 200 end as status,
  case when outcome = 'resolved' then 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || strlen(html) || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10)
    || 'date: ' || {date.format("t")} || chr(10) || 'etag: "' || md5(html) || '"' || chr(10) || 'last-modified: ' || {date.format("rt")} end as headers,
  case when outcome = 'resolved' then strlen(html) end as body_length, case when outcome = 'resolved' then sha256(html) end as body_sha256
from o
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_revisits": _revisits_sql(), "op2_benchmark_decontamination": _CONTAMINATION, "op8_secret_scan": _secrets_sql(), "op9_line_dedup": _REPEATED_LINES}
