"""DuckDB SQL for the corpus queries that SQL can express on whole tables.

Token counts (a library's), byte repeats (a hundred-byte string for every byte is too slow), and language
identification (a trained model) have none; tests/llm compares them with plain Python.
"""

from __future__ import annotations

from .mixing import RATE_STEP, TERMS
from .quality import QualityRules
from .sharding import lookup_table

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def quality(rules: QualityRules) -> str:
    ns = [*rules.ngram_limits]
    grams = ", ".join(
        f"g{n} as (select doc_id, pos, row_number() over (partition by doc_id, g order by pos) as k, count(*) over (partition by doc_id, g) as c from (select doc_id, pos,"
        f" string_agg(w, ' ') over win as g, count(*) over win as len from words window win as (partition by doc_id order by pos rows between current row and {n - 1} following))"
        f" where len = {n})" for n in sorted({*ns, rules.window}))
    covers = ", ".join(
        f"c{n} as (select doc_id, cast(sum(length(w)) as bigint) as x from (select distinct words.doc_id, words.pos, words.w from words join g{n} g on g.doc_id = words.doc_id"
        f" and g.k > 1 and words.pos between g.pos and g.pos + {n - 1}) group by doc_id)" for n in ns)
    chars = ", ".join(f"coalesce(c{n}.x, 0) as dup_chars_{n}" for n in ns)
    joins = " ".join(f"left join c{n} on c{n}.doc_id = d.doc_id" for n in ns)
    bad = " and ".join(f"not dup_chars_{n} > cast({limit} as double) * word_chars" for n, limit in rules.ngram_limits.items())
    return rf"""with words as (select doc_id, unnest(ws) as w, unnest(range(0, len(ws))) as pos from (select doc_id, {_WORDS} as ws from documents)),
base as (select doc_id, count(*) as n_words, cast(sum(length(w)) as bigint) as word_chars from words group by doc_id),
lines as (select doc_id, line, row_number() over (partition by doc_id, line) as k from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, '[^\x20\x09-\x0D]')),
l as (select doc_id, count(*) as n_lines, count(*) filter (k > 1) as n_dup, cast(coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) filter (k > 1), 0) as bigint) as chars from lines group by doc_id),
{grams}, {covers},
r as (select doc_id, count(*) as x from (select distinct words.doc_id, words.pos from words join g{rules.window} g on g.doc_id = words.doc_id and g.c > 1 and words.pos between g.pos and g.pos + {rules.window - 1}) group by doc_id),
m as (select d.doc_id, coalesce(base.n_words, 0) as n_words, coalesce(base.word_chars, 0) as word_chars, cast(coalesce(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')), 0) as bigint) as n_symbols, coalesce(l.n_dup, 0) as n_dup_lines, coalesce(r.x, 0) as n_repeat_words, coalesce(l.n_lines, 0) as n_lines, coalesce(l.chars, 0) as dup_line_chars, {chars}
  from documents d left join base on base.doc_id = d.doc_id left join l on l.doc_id = d.doc_id left join r on r.doc_id = d.doc_id {joins}),
f as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.window_percent} * n_words as base_failed from m)
select *, not base_failed and not n_dup_lines > cast({rules.line_share} as double) * n_lines and not dup_line_chars > cast({rules.line_chars} as double) * word_chars and not n_symbols > cast({rules.symbols_per_word} as double) * n_words and {bad} as kept from f"""


def url_filter(rules: list[tuple[str, str]], default: str = "allow") -> str:
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "substr(url, instr(url, '://') + 3)"
    return f"""with rules(verdict, rule, host, path) as (values {values}),
p as (select page_id, case when contains(url, '://') then {lower.format(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} else '' end as host, case when contains(url, '://') then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end as path from pages)
select page_id, host, path, rule, coalesce(verdict, '{default}') as verdict from (
  select p.page_id, p.host, p.path, r.rule, r.verdict, row_number() over (partition by p.page_id order by length(r.rule) desc) as k from p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)) where k = 1"""


def decontamination(n: int) -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with d as (select doc_id, coalesce({words}, []) as ws from documents), b as (select cast(item_id as varchar) as item, coalesce({words}, []) as ws from benchmark),
w as (select distinct item, least(len(ws), {n}) as len, array_to_string(ws[k:k + least(len(ws), {n}) - 1], ' ') as g from (select item, ws, unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) as k from b where len(ws) > 0)),
lens as (select distinct len from w),
g as (select doc_id, k, len, array_to_string(ws[k:k + len - 1], ' ') as g from (select doc_id, ws, len, unnest(range(1, len(ws) - len + 2)) as k from d, lens where len(ws) >= len)),
h as (select g.doc_id, g.k, g.len, w.item from g join w using (len, g)),
hit as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + len)) as pos from h) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from h group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit on hit.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""


def mixing(weights: dict[str, float], seed: int) -> str:
    case = "case " + " ".join(f"when source = '{s}' then {float(w)!r}::double" for s, w in weights.items()) + " else 1.0::double end"
    uniform = f"((('0x' || substr(md5('{seed}|' || coalesce(cast(doc_id as varchar), 'text:' || md5(coalesce(text, ''))) || '|' || cast(step as varchar)), 1, 13))::bigint + 0.5::double) / {float(1 << 52)!r}::double)"
    return f"""with c as (select source, count(*)::double as n, {case} as w from documents group by source),
r as (select source, (select sum(n) from c) * w / (select sum(w) from c) / n as rate from c),
s as (select source, rate, greatest(1, ceil(rate / {RATE_STEP!r}::double)) as steps from r),
terms as (select source, steps, k, sum(exp(-(rate / steps) + case when k = 0 then 0 when rate = 0 then -1e300 else k * ln(rate / steps) - lgamma(k + 1) end)) over (partition by source order by k) as cdf from s, range(0, {TERMS + 1}) as t(k)),
u as (select d.doc_id as doc_id, d.source as source, step, {uniform} as u from documents d join s on d.source is not distinct from s.source, lateral (select unnest(range(0, cast(steps as bigint))) as step)),
n as (select doc_id, count(*) filter (t.cdf < u.u) as copies from u join terms t on t.source is not distinct from u.source group by doc_id)
select d.*, copy from documents d join n using (doc_id), lateral (select unnest(range(0, copies)) as copy)"""


def near_dedup(shingle: int, percent: int) -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""with recursive d as (select doc_id, coalesce({words}, []) as ws from documents),
s as materialized (select distinct doc_id, array_to_string(ws[k:k + {shingle - 1}], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {shingle - 1}, 1) + 1)) as k from d where len(ws) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
e as materialized (select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all) p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * i >= {percent} * (na.n + nb.n - i)),
c as (select doc_id as a, doc_id as b from d union select c.a, e.b from c join e on e.a = c.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from d left join n on n.doc_id = d.doc_id join (select a, min(b) as component_id from c group by a) m on m.a = d.doc_id"""


def sharding(n_shards: int, slots: int) -> str:
    table = lookup_table([f"shard-{k}" for k in range(n_shards)], slots)
    return f"with t as (select {table} as slots) select documents.*, cast(slots[1 + ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint % {slots}] as bigint) as shard from documents, t"


def word_windows(n: int) -> str:
    return f"""with d as (select doc_id, coalesce({_WORDS}, []) as ws from documents),
w as (select doc_id, k, md5(array_to_string(ws[k:k + {n - 1}], ' ')) as g from (select doc_id, ws, unnest(range(1, len(ws) - {n - 2})) as k from d where len(ws) >= {n})),
twice as (select doc_id, k from (select doc_id, k, count(*) over (partition by g) as c from w) where c > 1),
gone as (select distinct doc_id, unnest(range(k, k + {n})) as pos from twice),
kept as (select v.doc_id, count(g.pos) as n_removed, coalesce(string_agg(v.w, ' ' order by v.pos) filter (g.pos is null), '') as txt from (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as pos from d) v left join gone g on g.doc_id = v.doc_id and g.pos = v.pos group by v.doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(txt, '')) as kept_sha256 from d left join kept k on k.doc_id = d.doc_id"""
