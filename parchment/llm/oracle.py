"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
with d as (
  select doc_id, coalesce('h' || source, '') host, coalesce(text, '') text, {WORDS} ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls
  from documents
),
windows as (select doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) p from d)),
twice as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) n from windows) where n > 1),
repeats as (
  select doc_id, sum(step) n from (
    select doc_id, least(3, coalesce(lead(p) over (partition by doc_id order by p) - p, 3)) step from twice)
  group by doc_id),
each_line as (
  select doc_id, host, text, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) n,
    lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) line
  from (select doc_id, host, text, unnest(ls) l from d)),
frequent as (
  select host, line from (select host, line, count(distinct text) n_with from each_line group by all)
  join (select host, count(distinct text) n_docs from d group by all) using (host)
  where n_with > 10 and n_with > least(0.02 * n_docs, 100)),
removed as (select doc_id, sum(n) n from each_line join frequent using (host, line) group by all),
m as (
  select doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) n_symbols,
    len(ls) - len(list_distinct(ls)) n_dup_lines,
    coalesce(repeats.n, 0) n_repeat_words, len(ws) - coalesce(removed.n, 0) n_words_left
  from d left join repeats using (doc_id) left join removed using (doc_id))
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
  n_repeat_words::bigint n_repeat_words, n_words_left::bigint n_words_left,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words_left >= 0.5 * n_words kept
from m
"""

OP3 = r"""
with p as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) path
  from pages),
rules(r_host, r_path, r_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
select page_id, host, path, r_host || r_path as rule, coalesce(r_verdict, 'allow') as verdict
from p left join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
qualify row_number() over (partition by page_id order by length(r_host || r_path) desc nulls last) = 1
"""

OP10 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest,
    min(page_id) over (partition by coalesce(html, '')) first_id
  from pages)
select page_id, payload_bytes::bigint payload_bytes, payload_digest, true as intact,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end refers_to
from p
"""

OP11 = r"""
with d as (
  select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') terms
  from documents),
c as (select lang, source, term, count(*) c, count(distinct id) docs from (select lang, source, id, unnest(terms) term from d) group by all),
k as (select lang, term, sum(c) c from c group by all having sum(docs) >= 10),
v as (select lang, count(*) v, sum(c) n from k group by all),
g as (select lang, source, coalesce(sum(c.c), 0) n from (select distinct lang, source from d) left join (select c.* from c semi join k using (lang, term)) c using (lang, source) group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) c, 1 + 1000000000::hugeint * (coalesce(c.c, 0) + 2) // (g.n + 2 * v.v) p,
    1 + 1000000000::hugeint * (k.c + 2) // (v.n + 2 * v.v) q
  from g join k using (lang) join v using (lang) left join c on (c.lang = g.lang and c.source = g.source and c.term = k.term)),
f as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(s.value, 0) as value
  from g a join g b on (a.lang = b.lang and a.source <> b.source)
  left join (select a.lang, a.source, b.source other, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
    from p a join p b on (a.lang = b.lang and a.term = b.term and a.source <> b.source) group by all) s
  on (s.lang = a.lang and s.source = a.source and s.other = b.source)
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where c > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) rank from f)
where part = 'pair' or rank <= 10
"""

SQL = {"op1_quality_rules": OP1, "op3_url_filters": OP3, "op10_warc": OP10, "op11_source_divergence": OP11}
