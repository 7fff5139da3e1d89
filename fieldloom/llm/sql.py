"""SQL counterparts of the queries, written independently of the operators."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, HEX, TOKEN
from .url_filter import SOFT_TERMS, STRICT_TERMS

WS = r"\x20\x09-\x0D"


def _mix(steps: int = 6, slices: int = 16) -> str:
    parts = [r"""
with t as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens from documents),
tok as (select * from t where n_tokens > 0),
tot as (select source, sum(n_tokens)::bigint as tokens from tok group by source),
al as (select sum(tokens)::double as total, count(*) as n from tot),
sh as (select source, tokens, tokens / total as share, total, n from tot, al),
s0 as (select 0.0::double as lo, 1.0::double as hi)"""]
    for i in range(1, steps + 1):
        parts.append(f"""
g{i} as (select k, lo + (hi - lo) * k / {slices}.0 as a from s{i - 1}, range({slices + 1}) r(k)),
h{i} as (select k, any_value(a) as a, ln(sum(pow(share, a))) - sum(pow(share, a) * ln(share) * a) / sum(pow(share, a)) as h
  from g{i}, sh group by k),
c{i} as (select count(*) as k from h{i} where h >= (select 0.98 * ln(n) from al)),
s{i} as (select (select a from g{i} where g{i}.k = greatest(c{i}.k - 1, 0)) as lo,
  (select a from g{i} where g{i}.k = least(c{i}.k, {slices})) as hi from c{i})""")
    parts.append(f"""
ex as (select case when n > 1 then round((select lo from s{steps}), 6) else 1.0 end as e from al),
pl as (select source, tokens, round(pow(share, e) / (select sum(pow(share, e)) from sh), 9) as weight, total from sh, ex),
bu as (select *, floor(weight * total)::bigint as budget, ceil(tokens / 200000.0)::bigint as blocks from pl),
fu as (select *, floor(budget / tokens)::bigint as n_full, budget - floor(budget / tokens)::bigint * tokens as rest from bu),
pc as (select t.doc_id, t.source, t.n_tokens, f.tokens, f.weight, f.budget, f.n_full, f.rest,
    ('0x' || substr(md5('7|' || t.doc_id), 1, 12))::bigint % f.blocks as block,
    unnest(range(case when f.rest > 0 then f.n_full + 1 else f.n_full end)) as pass
  from tok t join fu f on t.source is not distinct from f.source),
bl as (select source, pass, block, sum(n_tokens) as s from pc group by all),
bs as (select source, pass, block, coalesce(sum(s) over (partition by source, pass
    order by md5('7|' || coalesce(source || '|', '') || pass || '|' || block), block
    rows between unbounded preceding and 1 preceding), 0) as start from bl),
al2 as (select pc.*, bs.start + coalesce(sum(pc.n_tokens) over (partition by pc.source, pc.pass, pc.block
    order by md5('7|' || pc.pass || '|' || pc.doc_id), pc.doc_id, pc.n_tokens
    rows between unbounded preceding and 1 preceding), 0) as before
  from pc join bs on pc.source is not distinct from bs.source and pc.pass = bs.pass and pc.block = bs.block)
select doc_id, source, n_tokens::bigint as n_tokens, pass::bigint as pass, weight,
  round((pass * tokens + before) / budget, 9) as mix_pos
from al2 where pass < n_full or before < rest""")
    return ",".join(parts)


MIX = _mix()


def urls(rules) -> str:
    def lit(t: str) -> str:
        return "'" + t.replace("'", "''") + "'"

    fits = lambda r: f"((host = {lit(r.host)} or host like {lit('%.' + r.host)}) and starts_with(path, {lit(r.path)}))"
    ordered = sorted(rules, key=lambda r: -len(r.text))
    case = lambda field: "case " + " ".join(f"when {fits(r)} then {lit(getattr(r, field))}" for r in ordered) + " end"
    hit = lambda t: f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t}([^\\p{{L}}\\p{{N}}]|$)')"
    strict = " or ".join(hit(t) for t in STRICT_TERMS)
    soft = " + ".join(hit(t) + "::int" for t in SOFT_TERMS)
    return f"""
with r as (select page_id, url, lower(coalesce(url, '')) as low,
  case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path, {case('text')} as rule,
  coalesce({case('verdict')}, case when {strict} or {soft} >= 2 then 'block' else 'allow' end) as verdict from h"""


LINES = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by doc_id"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secrets() -> str:
    kinds = [("assign", 0, ASSIGN, 2, 6), ("access", 1, ACCESS, 0, 0), ("hex", 2, HEX, 0, 0), ("owned", 3, TOKEN, 0, 0)]
    select = []
    for name, k, pattern, group, least in kinds:
        q = _quoted(pattern)
        select.append(f"""
select doc_id, owner, repo, '{name}' as kind, {k} as k, start, start + length(m) as stop, v as value, {least} as least from (
  select doc_id, owner, repo, ms[i] as m, vs[i] as v,
    list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as start
  from (select *, unnest(range(1, len(ms) + 1)) as i from (
    select doc_id, coalesce(source, chr(1)) as owner, coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1)) as repo,
      regexp_extract_all(text, {q}) as ms, regexp_extract_all(text, {q}, {group}) as vs,
      regexp_split_to_array(text, {q}) as ps from documents)))""")
    return f"""
with a as ({' union all '.join(select)}),
b as (select * from a where k < 3 and length(value) >= least),
m as (select * from a where k = 3 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
  and len(list_distinct(string_split(value, ''))) >= 10
  and not exists (select 1 from b where b.doc_id = a.doc_id and a.start < b.stop and b.start < a.stop)),
c as (select * from b union all select * from m),
o as (select value, count(distinct owner) as owners, count(distinct repo) as repos from c group by value),
s as (select c.*, owners <= 1 and repos <= 2 as live from c join o using (value)),
z as (select doc_id, k, kind || ':' || start::bigint || ':' || stop::bigint as t, start, live from s where k < 3 or live),
g as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access,
    count(*) filter (where k = 2) as n_hex, sha256(coalesce(string_agg(t, ',' order by start, k) filter (where k < 3), '')) as base_sha256,
    string_agg(t, ',' order by start, k) as spans, count(*) filter (where live) as n_live,
    count(*) filter (where not live) as n_copied from z group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live,
  coalesce(n_copied, 0) as n_copied
from documents d left join g on d.doc_id = g.doc_id"""


SECRETS = _secrets()


JACCARD = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from t),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id != b.doc_id group by all),
e as (select x, y from i join n p on x = p.doc_id join n q on y = q.doc_id where 100 * c >= 75 * (p.n + q.n - c)),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select t.doc_id, coalesce(any_value(n.n), 0) as n_shingles, least(t.doc_id, coalesce(min(r.y), t.doc_id)) as component_id
from t left join n on t.doc_id = n.doc_id left join r on t.doc_id = r.x group by t.doc_id"""


REPEATS = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (select doc_id, b, unnest(range(1, octet_length(b) - 98)) as i from d where octet_length(b) >= 100),
k as (select doc_id, i, row_number() over (partition by b[i:i + 99] order by doc_id, i) as r from w),
s as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as new from k where r > 1),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from s),
p as (select doc_id, g, min(i) as a, max(i) + 100 as e from g group by doc_id, g),
q as (select doc_id, coalesce(lag(e) over (partition by doc_id order by a), 1) as f, a - 1 as t, e - a as removed from p
  union all select doc_id, max(e), 2000000000, 0 from p group by doc_id),
o as (select q.doc_id, sum(removed) as n_removed, count(*) - 1 as n_spans,
    sha256(unhex(string_agg(case when f <= t then hex(b[f:t]) else '' end, '' order by f))) as kept_sha256
  from q join d using (doc_id) group by q.doc_id)
select d.doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  coalesce(kept_sha256, sha256(b)) as kept_sha256
from d left join o using (doc_id)"""


PHRASES = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from w, range(1, 6) r(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 100),
inner_ as (select lang, f, string_split(phrase, ' ') as x, k, unnest(range(2, k)) as m from f where k > 2),
held as (select lang, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(x[i:i + m - 1], ' '))) as phrase, f from inner_),
top as (select lang, phrase, max(f) as longer from held group by all),
c as (select f.lang, f.phrase, f.f as a, string_split(f.phrase, ' ') as x, unnest(range(1, k)) as j
  from f left join top using (lang, phrase) where k > 1 and (longer is null or longer < f.f)),
s as (select c.lang, c.phrase, a, j, l.f as l, r.f as r, n, (1000::hugeint * a * n) // (l.f::hugeint * r.f) as score
  from c join f l on l.lang = c.lang and l.phrase = array_to_string(x[1:j], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(x[j + 1:], ' ') join n on n.lang = c.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from b qualify rank <= 2000"""
