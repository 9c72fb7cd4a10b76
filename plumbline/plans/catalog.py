"""All queries of the verification engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scanner
from ..functions import text as tx
from ..operators import cache, fidelity, gate, images, leaks, markdown, packing, regions, units
from ..schemas import KINDS, UNIT_ID
from ..sources import files, sinks
from ..streaming import flow
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **derived: str) -> Callable[[Query], Query]:
    """Register a query; derived views become the oracle's common table expressions."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            head = ", ".join(f"{name} as ({v.duck(text)})" for name, text in derived.items())
            ORACLES[fn.__name__] = (f"with {head} " if head else "") + sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# DuckDB forms that several oracles share.
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = "(select doc_id, unnest(string_split({0}, chr(10))) as line, unnest(range(1, len(string_split({0}, chr(10))) + 1)) as n from {1})"
_W = r"[\p{L}\p{N}_]"
_TOKEN = r"\[\[(?:EQ|IMG|CITE):[^\]\r\n]+\]\]"
_NUMS = r"""list_sort(list_transform(regexp_extract_all(regexp_replace({0}, '""" + _TOKEN + r"""', '', 'g'), '(?:^|[^\p{L}\p{N}_.])([+\-−]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[eE][+\-−]?[0-9]+)?(?:\s*[%％])?)', 1), lambda x: translate(regexp_replace(x, '\s+', '', 'g'), '−％,', '-%')))"""


def nums(c: str) -> str:
    return _NUMS.replace("{0}", c)


def toks(c: str) -> str:
    return f"list_sort(regexp_extract_all({c}, '{_TOKEN}'))"


# ---- Markdown and text


@query(
    r"""select doc_id, cast(count(*) filter (hit) as bigint) as n_hits, cast(min(n) filter (hit) as bigint) as first_line, cast(max(m) as bigint) as n_markers from (
  select doc_id, n, m, s <> '' and not (starts_with(s, '$$') or starts_with(s, '![') or starts_with(s, '#') or starts_with(s, '|') or starts_with(s, '`') or starts_with(s, 'http') or starts_with(s, '- [') or starts_with(s, '[') or starts_with(s, '>') or contains(s, chr(92)))
    and length(regexp_replace(s, '[^A-Za-z]', '', 'g')) > 60 and not regexp_matches(s, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]') as hit
  from (select doc_id, n, regexp_replace(line, '^\s+|\s+$', '', 'g') as s, m from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n, cast(contains(text, 'English original') as int) + cast(contains(text, '**English**') as int) as m from documents))
) group by doc_id having count(*) filter (hit) > 0 or max(m) > 0"""
)
def english_residue(spark, sf_dir):
    return markdown.english_residue(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    r"select doc_id, cast(len(list_filter(string_split(md, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') = '$$')) as bigint) as display_lines,"
    r" cast(len(replace(md, '$$', '')) - len(replace(replace(md, '$$', ''), '$', '')) as bigint) as inline_dollars, cast((len(md) - len(replace(md, chr(92) || '(',"
    r" ''))) / 2 + (len(md) - len(replace(md, chr(92) || ')', ''))) / 2 as bigint) as bracket_delims from d_md",
    d_md=v.MD,
)
def delimiter_parity(spark, sf_dir):
    return markdown.delimiter_parity(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md")


@query(
    "select doc_id, cast(len(replace(text, '$$', '')) - len(replace(replace(text, '$$', ''), '$', '')) as bigint) as dollars from documents where (len(replace(text, '$$',"
    " '')) - len(replace(replace(text, '$$', ''), '$', ''))) % 2 = 1")
def dollar_parity(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", tx.count_of(F.replace(F.col("text"), F.lit("$$"), F.lit("")), "$").alias("dollars")).filter("dollars % 2 = 1")


@query(
    r"""select doc_id, array_to_string(list_filter(range(1, 4), lambda n: not list_contains(nums, n)), ',') as missing, array_to_string(list_filter(list_sort(list_distinct(nums)), lambda n: n > 3 or n < 1), ',') as extra,
  array_to_string(list_sort(list_distinct(list_filter(tags, lambda t: len(list_filter(tags, lambda u: u = t)) > 2))), ',') as repeated
from (select doc_id, tags, list_concat(list_transform(tags, lambda t: cast(t as bigint)), list_transform(regexp_extract_all(md, '\\text\{\(([0-9]+)[a-z]?\)\}', 1), lambda t: cast(t as bigint))) as nums from (select doc_id, md, list_filter(regexp_extract_all(md, '\\tag\{([^}]+)\}', 1), lambda t: regexp_full_match(t, '[0-9]+')) as tags from d_md))""",
    d_md=v.MD,
)
def equation_numbers(spark, sf_dir):
    return markdown.equation_numbers(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md", 3)


@query(
    r"""select doc_id, block, n_left, n_right, open_envs from (select doc_id, block, cast((len(t) - len(replace(t, '\left', ''))) / 5 - (len(t) - len(replace(t, '\leftarrow', ''))) / 10 as bigint) as n_left, cast((len(t) - len(replace(t, '\right', ''))) / 6 - (len(t) - len(replace(t, '\rightarrow', ''))) / 11 as bigint) as n_right,
  cast(len(list_filter(regexp_extract_all(t, '\\begin\{([\p{L}\p{N}_]+)\}', 1), lambda e: (len(t) - len(replace(t, '\begin{' || e || '}', ''))) / (len(e) + 8) <> (len(t) - len(replace(t, '\end{' || e || '}', ''))) / (len(e) + 6))) as bigint) as open_envs
from (select doc_id, unnest(b) as t, cast(unnest(range(0, len(b))) as bigint) as block from (select doc_id, regexp_extract_all(md, '(?s)\$\$(.+?)\$\$', 1) as b from d_md))) where n_left <> n_right or open_envs > 0""",
    d_md=v.MD,
)
def bracket_pairs(spark, sf_dir):
    return markdown.bracket_pairs(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md")


@query(
    r"""select doc_id, block, cast(len(list_filter(list_concat(regexp_extract_all(t, '(?s)\\left\((.{1,80}?)\\right\)\s*\\left\((.{1,140}?)\\right\)', 2), regexp_extract_all(replace(t, '\left(', chr(1)), '(?s)\(([^()\x01]{1,80})\)\s*\(([^()\x01]{1,140})\)', 2)), lambda g: regexp_matches(g, '[-−]') and not regexp_matches(g, '\\frac|\\begin\{'))) as bigint) as n_hints
from (select doc_id, unnest(b) as t, cast(unnest(range(0, len(b))) as bigint) as block from (select doc_id, regexp_extract_all(md, '(?s)\$\$(.+?)\$\$', 1) as b from d_md)) where n_hints > 0""",
    d_md=v.MD,
)
def scope_ambiguity(spark, sf_dir):
    return markdown.scope_ambiguity(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md")


@query(
    r"""select doc_id, cast(n as bigint) as block, kind, ok from (select doc_id, unnest(b) as t, unnest(range(0, len(b))) as n from (select doc_id, regexp_extract_all(md, '(?s)\$\$(.+?)\$\$', 1) as b from d_md)), (select 'braces' as kind, '{' as o, '}' as c union all select 'parens', '(', ')') as k,
  lateral (select d.depth = 0 and d.low >= 0 as ok from (select list_reduce(list_prepend({'depth': 0, 'low': 0, 'ch': ''}, list_transform(string_split(regexp_replace(t, '(?s)\\.?', '', 'g'), ''), lambda ch: {'depth': 0, 'low': 0, 'ch': ch})), lambda s, x: {'depth': s.depth + case when x.ch = o then 1 when x.ch = c then -1 else 0 end, 'low': least(s.low, s.depth + case when x.ch = o then 1 when x.ch = c then -1 else 0 end), 'ch': ''}) as d)) where not ok""",
    d_md=v.MD,
)
def delimiter_balance(spark, sf_dir):
    b = markdown.formula_blocks(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md")
    kinds = F.explode(F.array(F.struct(F.lit("braces").alias("kind"), tx.balanced("tex", "{", "}").alias("ok")), F.struct(F.lit("parens").alias("kind"), tx.balanced("tex", "(", ")").alias("ok"))))
    return b.select("doc_id", "block", kinds.alias("x")).select("doc_id", "block", "x.kind", "x.ok").filter("not ok")


@query(
    "select doc_id, count(*) as n_missing, string_agg(cast(id as varchar), ',' order by id) as missing from (select d.doc_id, w.id from d_md d, (select 0 as id,"
    " 'Method summary' as text union all select item_id + 1, text from benchmark) w where not contains(d.md, w.text)) group by doc_id",
    d_md=v.MD,
)
def missing_sections(spark, sf_dir):
    wanted = _t(spark, sf_dir, "benchmark").select((F.col("item_id") + 1).alias("id"), "text").unionByName(spark.range(1).select("id", F.lit("Method summary").alias("text")))
    return markdown.missing_texts(v.spark_view(spark, sf_dir, v.MD), wanted, "doc_id", "md", "id", "text")


_REFS = r"select doc_id, regexp_extract(r, '[^/]+$') as name from (select doc_id, unnest(regexp_extract_all(md, '!\[[^\]]*\]\(([^)]+\.png)\)', 1)) as r from d_md)"


@query(
    f"select distinct doc_id, name, 'missing' as finding from ({_REFS}) r where not exists (select 1 from d_assets a where a.doc_id = r.doc_id and a.name = r.name)"
    f" union all select distinct doc_id, name, 'unreferenced' from d_assets a where lower(name) like '%.png' and not exists (select 1 from ({_REFS}) r where a.doc_id = r.doc_id"
    f" and a.name = r.name)", d_md=v.MD, d_assets=v.ASSETS)
def asset_references(spark, sf_dir):
    refs = markdown.image_refs(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md")
    return markdown.asset_diff(refs, v.spark_view(spark, sf_dir, v.ASSETS), "doc_id")


@query(
    r"select doc_id, cast(n as bigint) as ord, regexp_replace(t, '^\s+|\s+$', '', 'g') as tex from (select doc_id, unnest(b) as t, unnest(range(0, len(b))) as n"
    r" from (select doc_id, regexp_extract_all(md, '\$\$([\s\S]+?)\$\$', 1) as b from d_md))", d_md=v.MD)
def display_formulas(spark, sf_dir):
    return markdown.formulas(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md").filter("kind = 'block'").select("doc_id", "ord", "tex")


# Inline formulas have single dollars at both ends: with a mark around each run of dollars, no look-around is needed.
_INLINE = r"regexp_extract_all(regexp_replace(regexp_replace(md, '\$\$[\s\S]+?\$\$', '', 'g'), '(\$+)', chr(1) || '\1' || chr(1), 'g'), '\x01\$\x01([^$\n\x01]+)\x01\$\x01', 1)"


@query(
    rf"""select doc_id, cast(k as bigint) as ord, case when k < n then 'block' else 'inline' end as kind, regexp_replace(t, '^\s+|\s+$', '', 'g') as tex
from (select doc_id, len(b) as n, unnest(list_concat(b, i)) as t, unnest(range(0, len(b) + len(i))) as k from (select doc_id, regexp_extract_all(md, '\$\$([\s\S]+?)\$\$', 1) as b, {_INLINE} as i from d_md))""",
    d_md=v.MD,
)
def formulas(spark, sf_dir):
    return markdown.formulas(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md")


_TEXT_ORACLE = " union all ".join(
    rf"select doc_id as subject_id, '{name}' as rule, 'error' as severity, cast(unnest(range(0, len(m))) as bigint) as ord, unnest(m) as match from (select doc_id, regexp_extract_all(md, '{pattern}') as m from d_md)"
    for name, pattern in {
        "latex_in_prose": r"\\[A-Za-z]{2,}|\\[^A-Za-z\s]",
        "prose_script": r"[_^]\{[^{}\s]{1,32}\}",
        "md_strike": r"~~[^\n~]{1,60}~~",
        "md_bold": r"\*\*[^*\n]{1,80}\*\*",
        "md_quote": r"(?m)^>\s",
        "doubled_backslash": r"\\\\[A-Za-z]+",
        "leaked_paths": r"_extracted[\p{L}\p{N}_\-]*|assets/raw|assets\\raw|[A-Za-z]:\\|/mnt/|_work\\|_fixwork|_bak_fix|_extract\\|_translate\\",
    }.items()
)


@query(_TEXT_ORACLE, d_md=v.MD)
def text_leaks(spark, sf_dir):
    return leaks.regex_findings(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md", leaks.TEXT_RULES)


@query(f"select d.doc_id, cast(count(f.rule) as bigint) as n_blocking, count(f.rule) = 0 as ok from d_md d left join ({_TEXT_ORACLE}) f on f.subject_id = d.doc_id group by d.doc_id", d_md=v.MD)
def leak_verdicts(spark, sf_dir):
    return leaks.judge(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md", leaks.TEXT_RULES)


@query(
    r"select 'documents' as kind, doc_id as id, cast(len(regexp_extract_all(text, '\*\*[^*\n]{1,80}\*\*')) as bigint) as n from documents where regexp_matches(text,"
    r" '\*\*[^*\n]{1,80}\*\*') union all select 'pages', page_id, cast(len(regexp_extract_all(html, '\*\*[^*\n]{1,80}\*\*')) as bigint) from pages where regexp_matches(html,"
    r" '\*\*[^*\n]{1,80}\*\*')")
def md_bold_residue(spark, sf_dir):
    n = lambda c: F.regexp_count(F.col(c), F.lit(leaks.TEXT_RULES["md_bold"][0])).cast("long").alias("n")
    d = _t(spark, sf_dir, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), n("text"))
    p = _t(spark, sf_dir, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), n("html"))
    return d.unionByName(p).filter("n > 0")


@query(
    "select doc_id, cast(n as bigint) as line, line as text from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text,"
    " chr(10))) + 1)) as n from documents) where contains(lower(line), 'http') or contains(lower(line), 'the thin')"
)
def keyword_lines(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.lines("text")).alias("k", "text"))
    return files.lines_with(rows, ["HTTP", "The thin"]).select("doc_id", (F.col("k") + 1).cast("long").alias("line"), "text")


@query(
    f"select subject_id, rule, string_agg(match, ' | ' order by k) filter (k <= 2) as shown, greatest(count(*) - 2, 0) as omitted from (select *,"
    f" row_number() over (partition by subject_id, rule order by ord) as k from ({_TEXT_ORACLE})) group by subject_id, rule",
    d_md=v.MD,
)
def leak_examples(spark, sf_dir):
    return leaks.examples(leaks.regex_findings(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md", leaks.TEXT_RULES), 2)


@query(
    r"select doc_id, n_refs, expected from (select doc_id, cast(len(regexp_extract_all(md, '!\[[^\]]*\]\(([^)]+\.png)\)', 1)) as bigint) as n_refs,"
    r" cast(doc_id % 4 as bigint) as expected from d_md) where expected <> 0 and n_refs <> expected", d_md=v.MD)
def image_counts(spark, sf_dir):
    return markdown.image_count_diff(v.spark_view(spark, sf_dir, v.MD), "doc_id", "md", F.col("doc_id") % 4)


@query("select doc_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source})) as fingerprint, sha256(text) as text_sha256 from documents")
def fingerprint(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", tx.fingerprint(F.struct("doc_id", "lang", "n_chars", "source")).alias("fingerprint"), F.sha2("text", 256).alias("text_sha256"))


# ---- HTML

_VISIBLE = (
    r"regexp_replace(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', ' ', 'g'), '(?i)<(?:script|style|pre|code|textarea|option|noscript)\b[^>]*>[^<]*</[A-Za-z][^>]*>',"
    r" ' ', 'g'), '<[A-Za-z/!?][^>]*>', ' ', 'g')"
)


@query(f"select page_id, cast(length({_VISIBLE}) as bigint) as n_chars, sha256({_VISIBLE}) as sha from pages")
def visible_text(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", tx.visible_text("html").alias("v"))
    return p.select("page_id", F.length("v").cast("long").alias("n_chars"), F.sha2("v", 256).alias("sha"))


@query(rf"select page_id, cast(len({_VISIBLE}) - len(replace({_VISIBLE}, '$', '')) as bigint) as dollars from d_html where contains({_VISIBLE}, '$')", d_html=v.HTML)
def leftover_dollar(spark, sf_dir):
    p = v.spark_view(spark, sf_dir, v.HTML).select("page_id", tx.count_of(tx.visible_text("html"), "$").alias("dollars"))
    return p.filter("dollars > 0")


@query(r"""select page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '[\s\x{A0}]+', ' ', 'g'), '^ | $', '', 'g') as text from pages""")
def plain_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.plain_text("html").alias("text"))


@query(
    r"""select page_id, cast(len(regexp_extract_all(html, '<img\b[^>]*?>>')) as bigint) as img_stray_gt, cast(len(regexp_extract_all(html, '<span class="katex-error"')) as bigint) as katex_errors, cast(len(regexp_extract_all(html, '<(?:script|link)[^>]*?(?:src|href)="((?:http|//)[^"]*)"')) as bigint) as external_refs, cast(len(regexp_extract_all(html, 'url\(\s*[''"]?(?:https?:)?//')) as bigint) as external_css
from d_html where regexp_matches(html, '<img\b[^>]*?>>') or contains(html, '<span class="katex-error"') or regexp_matches(html, '<(?:script|link)[^>]*?(?:src|href)="((?:http|//)[^"]*)"') or regexp_matches(html, 'url\(\s*[''"]?(?:https?:)?//')""",
    d_html=v.HTML,
)
def html_leaks(spark, sf_dir):
    return leaks.rule_counts(v.spark_view(spark, sf_dir, v.HTML), "page_id", "html", leaks.HTML_RULES)


@query("select page_id from d_html where not regexp_matches(html, '参考文献|REFERENCES|References')", d_html=v.HTML)
def refs_missing(spark, sf_dir):
    return v.spark_view(spark, sf_dir, v.HTML).filter(~F.regexp_like("html", F.lit("参考文献|REFERENCES|References"))).select("page_id")


_BODY = r"regexp_replace(case when contains(html, '<body>') then substr(html, instr(html, '<body>')) else html end, '<script[\s\S]*?</script>', '', 'g')"
_IMGS = rf"""(select page_id, idx, src, alt, case when starts_with(src, 'data:image') then try(from_base64(p || repeat('=', (4 - length(p) % 4) % 4))) end as data from (
  select page_id, cast(idx as bigint) as idx, regexp_extract(tag, '\bsrc="([^"]*)"', 1) as src, regexp_extract(tag, '\balt="([^"]*)"', 1) as alt, regexp_replace(split_part(regexp_extract(tag, '\bsrc="([^"]*)"', 1), ',', -1), '[^A-Za-z0-9+/]', '', 'g') as p
  from (select page_id, unnest(t) as tag, unnest(range(0, len(t))) as idx from (select page_id, regexp_extract_all({_BODY}, '<img\b[^>]*?>') as t from d_html))))"""
_be = lambda at: f"(cast(concat('0x', substr(hex(data), {2 * at - 1}, 8)) as bigint))"
_le = lambda at: f"(cast(concat('0x', substr(hex(data), {2 * at + 1}, 2), substr(hex(data), {2 * at - 1}, 2)) as bigint))"
# The derived pages have a frame header behind segments of these two lengths.
_jpeg_side = lambda k: f"coalesce(try_cast(concat('0x', regexp_extract(hex(data), '^FFD8(?:FFE00004.{{4}}|FFFE0006.{{8}})*FFC0000B08(.{{4}})(.{{4}})', {k})) as bigint), 0)"
_DIMS = f"""(select page_id, idx, src, alt, data, case when data is not null then sha256(data) end as sha, cast(octet_length(data) as bigint) as nbytes,
  case when data is null then null when starts_with(hex(data), '89504E470D0A1A0A') and octet_length(data) >= 24 then 'png' when starts_with(hex(data), '474946') and octet_length(data) >= 10 then 'gif' when starts_with(hex(data), 'FFD8') then 'jpeg' else '?' end as kind,
  case when data is null then null when starts_with(hex(data), '89504E470D0A1A0A') and octet_length(data) >= 24 then {_be(17)} when starts_with(hex(data), '474946') and octet_length(data) >= 10 then {_le(7)} else {_jpeg_side(2)} end as w,
  case when data is null then null when starts_with(hex(data), '89504E470D0A1A0A') and octet_length(data) >= 24 then {_be(21)} when starts_with(hex(data), '474946') and octet_length(data) >= 10 then {_le(9)} else {_jpeg_side(1)} end as h from {_IMGS})"""


def _images(spark, sf_dir):
    return images.extract(v.spark_view(spark, sf_dir, v.HTML), "page_id", "html")


@query(f"select page_id, idx, src, alt, sha, nbytes, kind, w, h from {_DIMS}", d_html=v.HTML)
def embedded_images(spark, sf_dir):
    return _images(spark, sf_dir)


@query(f"select page_id, idx, src from {_IMGS} where not starts_with(src, 'data:')", d_html=v.HTML)
def non_embedded_images(spark, sf_dir):
    return images.not_embedded(_images(spark, sf_dir), "page_id")


@query(f"select page_id, idx from {_DIMS} where starts_with(src, 'data:image') and (sha is null or kind = '?' or w = 0)", d_html=v.HTML)
def broken_images(spark, sf_dir):
    return images.broken(_images(spark, sf_dir), "page_id")


@query(f"select page_id, sha, count(*) as n, count(distinct alt) as n_alt from {_DIMS} where sha is not null group by page_id, sha having count(*) > 1 and count(distinct alt) > 1", d_html=v.HTML)
def dup_image_bytes(spark, sf_dir):
    return images.duplicate_bytes(_images(spark, sf_dir), "page_id")


@query(f"select page_id, sha, count(*) as n from {_DIMS} where sha is not null group by page_id, sha having count(*) > 1", d_html=v.HTML)
def same_image_bytes(spark, sf_dir):
    return images.same_bytes(_images(spark, sf_dir), "page_id")


@query(f"select page_id, w, h, nbytes, count(*) as n from {_DIMS} where kind = 'png' group by page_id, w, h, nbytes having count(*) > 1", d_html=v.HTML)
def dup_dims_bytes(spark, sf_dir):
    return images.duplicate_sizes(_images(spark, sf_dir), "page_id")


@query(
    f"select page_id, key, count(*) as n, string_agg(cast(idx as varchar), ',' order by idx) as idxs from (select page_id, idx, case when starts_with(src,"
    f" 'data:') then substr(src, 1, 120) || '#' || cast(length(src) as varchar) else src end as key from {_IMGS}) group by page_id, key having count(*) > 1", d_html=v.HTML)
def dup_src(spark, sf_dir):
    return images.reused_sources(_images(spark, sf_dir), "page_id")


@query(f"select page_id, idx, kind, w from {_DIMS} where kind is not null and (kind <> 'png' or w < 200)", d_html=v.HTML)
def narrow_images(spark, sf_dir):
    return images.narrow(_images(spark, sf_dir), "page_id")


_FORMS = [(kind, pattern if exact else f"(?i){pattern}") for kind, _, pattern, exact in fixed.IMAGE_NAMES]
_form_kind = "case " + " ".join(f"when regexp_matches(alt, '{p}') then '{kind}'" for kind, p in _FORMS) + " end"
_form_num = "case " + " ".join(f"when regexp_matches(alt, '{p}') then regexp_extract(alt, '{p}', 1)" for _, p in _FORMS) + " end"


@query(f"select page_id, idx, {_form_kind} as declared_kind, try_cast({_form_num} as bigint) as declared_num from {_IMGS}", d_html=v.HTML)
def image_identity(spark, sf_dir):
    return images.identity(_images(spark, sf_dir), "page_id")


_EVENTS = (
    r"(select page_id, cast(unnest(range(0, len(e))) as bigint) as ord, starts_with(unnest(e), '<img') as is_img, try_cast(regexp_extract(unnest(e), '^图\s*([0-9]+)',"
    r" 1) as bigint) as num from (select page_id, regexp_extract_all(html, '<img\b[^>]*>|图\s*(?:[0-9]+)[：:]') as e from d_html))"
)


def _events(spark, sf_dir):
    return images.caption_sequence(v.spark_view(spark, sf_dir, v.HTML), "page_id", "html")


@query(
    f"select page_id, ord, num, cast(seen - coalesce(lag(seen) over (partition by page_id order by ord), 0) as bigint) as n_images from (select *,"
    f" sum(cast(is_img as int)) over (partition by page_id order by ord) as seen from {_EVENTS}) where not is_img", d_html=v.HTML)
def imgs_per_caption(spark, sf_dir):
    return images.images_per_caption(_events(spark, sf_dir), "page_id")


@query(f"select page_id, before, num as after from (select page_id, num, lag(num) over (partition by page_id order by ord) as before from {_EVENTS} where num is not null) where num < before", d_html=v.HTML)
def caption_inversions(spark, sf_dir):
    return images.caption_inversions(_events(spark, sf_dir), "page_id")


@query(f"select page_id, num, count(*) as n from {_EVENTS} where num is not null group by page_id, num having count(*) > 1", d_html=v.HTML)
def caption_dups(spark, sf_dir):
    return images.caption_duplicates(_events(spark, sf_dir), "page_id")


@query(
    f"select * from (select page_id, array_to_string(list_filter(range(1, 4), lambda n: not list_contains(got, n)), ',') as missing, array_to_string(list_filter(got,"
    f" lambda n: n > 3), ',') as extra from (select page_id, list_sort(list_distinct(list(num) filter (num is not null))) as got from {_EVENTS} group by page_id))"
    f" where missing <> '' or extra <> ''", d_html=v.HTML)
def expected_diff(spark, sf_dir):
    return images.expected_diff(_events(spark, sf_dir), "page_id", 3)


@query(
    r"select distinct page_id, cast(num as bigint) as num from (select page_id, unnest(regexp_extract_all(html, '图\s*([0-9]+)', 1)) as num from d_html) r"
    r" where not exists (select 1 from (select page_id, unnest(regexp_extract_all(html, '图\s*([0-9]+)\s*[：:．.、，]', 1)) as num from d_html) c where c.page_id = r.page_id"
    r" and c.num = r.num)", d_html=v.HTML)
def missing_figures(spark, sf_dir):
    return images.missing_figures(v.spark_view(spark, sf_dir, v.HTML), "page_id", "html")


# ---- Units, translations, reviews

_PAIRED = "(select u.*, coalesce(t.text, '') as output from d_units u left join d_translations t on t.doc_id = u.doc_id and t.id = u.id)"
_BLANK = r"regexp_replace(output, '^\s+|\s+$', '', 'g') = ''"
_ALIGN = (
    "(select e.doc_id, e.ids as expected, a.ids as actual from (select doc_id, list(id order by ord) as ids from d_units group by doc_id) e left join (select doc_id, list(id"
    " order by ord) as ids from d_translations group by doc_id) a on a.doc_id = e.doc_id)"
)
_PRESENT = rf"regexp_matches(p.source, '(?i)(^|[^\p{{L}}\p{{N}}_])' || x.source || '([^\p{{L}}\p{{N}}_]|$)')"
_TERM_ISSUES = (
    f"(select p.doc_id, p.id as unit_id, x.id as term_id, x.source as term, x.target from {_PAIRED} p join (select doc_id, id, source, target, variants,"
    f" unnest(unit_ids) as unit_id from d_terms where status = 'approved') x on x.doc_id = p.doc_id and x.unit_id = p.id where {_PRESENT} and not contains(p.output, x.target)"
    f" and len(list_filter(x.variants, lambda w: contains(p.output, w))) = 0)"
)
_ISSUES = f"""(select doc_id, unit_id || ':' || code as id, unit_id, code, severity from (
  select doc_id, id as unit_id, 'empty_translation' as code, 'error' as severity from {_PAIRED} where {_BLANK}
  union all select doc_id, id, 'protected_tokens', 'error' from {_PAIRED} where {toks('source')} <> {toks('output')}
  union all select doc_id, id, 'numbers', 'candidate' from {_PAIRED} where {nums('source')} <> {nums('output')}
  union all select doc_id, 'document', 'alignment', 'error' from {_ALIGN} where expected is distinct from actual
  union all select doc_id, unit_id, 'term-' || term_id, 'candidate' from {_TERM_ISSUES}))"""
_V = {"d_units": v.UNITS, "d_translations": v.TRANSLATIONS, "d_terms": v.TERMS, "d_reviews": v.REVIEWS, "d_decisions": v.DECISIONS}
_UT = {k: _V[k] for k in ("d_units", "d_translations")}


def _v(spark, sf_dir, *names):
    return [v.spark_view(spark, sf_dir, _V[n]) for n in names]


@query(f"select doc_id, cast(len(expected) as bigint) as n_expected, cast(coalesce(len(actual), 0) as bigint) as n_actual from {_ALIGN} where expected is distinct from actual", **_UT)
def unit_alignment(spark, sf_dir):
    return units.alignment(*_v(spark, sf_dir, "d_units", "d_translations"))


@query(f"select doc_id, id from {_PAIRED} where {_BLANK}", **_UT)
def empty_translation(spark, sf_dir):
    return units.pair(*_v(spark, sf_dir, "d_units", "d_translations")).filter(tx.blank("output")).select("doc_id", "id")


@query(f"select doc_id, id, array_to_string({nums('source')}, ' ') as wanted, array_to_string({nums('output')}, ' ') as got from {_PAIRED} where {nums('source')} <> {nums('output')}", **_UT)
def number_multiset_diff(spark, sf_dir):
    p = units.pair(*_v(spark, sf_dir, "d_units", "d_translations"))
    a, b = tx.numbers("source"), tx.numbers("output")
    return p.filter(a != b).select("doc_id", "id", F.array_join(a, " ").alias("wanted"), F.array_join(b, " ").alias("got"))


@query(f"select doc_id, id from {_PAIRED} where {toks('source')} <> {toks('output')}", **_UT)
def protected_token_diff(spark, sf_dir):
    p = units.pair(*_v(spark, sf_dir, "d_units", "d_translations"))
    return p.filter(tx.tokens("source") != tx.tokens("output")).select("doc_id", "id")


@query(f"select * from {_TERM_ISSUES}", **{k: _V[k] for k in ("d_units", "d_translations", "d_terms")})
def term_presence(spark, sf_dir):
    u, t, terms = _v(spark, sf_dir, "d_units", "d_translations", "d_terms")
    return units.term_issues(units.pair(u, t), terms)


@query(
    "select a.doc_id, lower(a.source) as word, a.id as a_id, b.id as b_id from d_terms a join d_terms b on a.doc_id = b.doc_id and lower(a.source) = lower(b.source)"
    " and a.ord < b.ord where a.status = 'approved' and b.status = 'approved' and list_has_any(a.unit_ids, b.unit_ids) and (a.target <> b.target or a.sense <> b.sense)", d_terms=v.TERMS)
def term_conflicts(spark, sf_dir):
    return units.term_conflicts(*_v(spark, sf_dir, "d_terms"))


@query(
    "select t.doc_id, t.id as term_id, t.unit_id from (select doc_id, id, unnest(unit_ids) as unit_id from d_terms) t where not exists (select 1 from d_units u"
    " where u.doc_id = t.doc_id and u.id = t.unit_id)", d_units=v.UNITS, d_terms=v.TERMS)
def dangling_terms(spark, sf_dir):
    u, t = _v(spark, sf_dir, "d_units", "d_terms")
    return units.dangling(t.select("doc_id", F.col("id").alias("term_id"), F.explode("unit_ids").alias("unit_id")), u).select("doc_id", "term_id", "unit_id")


@query(f"select * from {_ISSUES}", **{k: _V[k] for k in ("d_units", "d_translations", "d_terms")})
def inspect_issues(spark, sf_dir):
    return units.inspect(*_v(spark, sf_dir, "d_units", "d_translations", "d_terms"))


_REQ = (
    "list_sort(list_filter(['claim_strength','coverage','logic','numbers_units','readability','terminology', case kind when 'algorithm' then 'variables_control_flow'"
    " when 'caption' then 'panel_mapping' when 'reference' then 'bibliographic_identity' when 'table' then 'cells_footnotes' when 'theorem' then 'conditions_quantifiers' end],"
    " lambda x: x is not null))"
)


@query(f"select doc_id, id, array_to_string({_REQ}, ',') as checks from d_units", d_units=v.UNITS)
def required_checks(spark, sf_dir):
    (u,) = _v(spark, sf_dir, "d_units")
    return u.select("doc_id", "id", F.array_join(units.required_checks(F.col("kind")), ",").alias("checks"))


_GAPS = (
    f"(select u.doc_id, u.id as unit_id from d_units u left join d_reviews r on r.doc_id = u.doc_id and r.id = u.id where not coalesce(r.verdict = 'passed' and r.n_findings = 0"
    f" and len(list_filter({_REQ}, lambda x: not list_contains(r.checks, x))) = 0, false))"
)
_COVER = "(select distinct coalesce(u.doc_id, r.doc_id) as doc_id from d_units u full join d_reviews r on r.doc_id = u.doc_id and r.id = u.id where u.id is null or r.id is null)"


@query(f"select * from {_GAPS}", d_units=v.UNITS, d_reviews=v.REVIEWS)
def review_gaps(spark, sf_dir):
    return units.review_gaps(*_v(spark, sf_dir, "d_units", "d_reviews"))


@query(f"select * from {_COVER}", d_units=v.UNITS, d_reviews=v.REVIEWS)
def review_coverage(spark, sf_dir):
    return units.review_coverage(*_v(spark, sf_dir, "d_units", "d_reviews"))


_OPEN = rf"(select i.* from {_ISSUES} i left join d_decisions d on d.doc_id = i.doc_id and d.issue_id = i.id where i.severity = 'error' or regexp_replace(coalesce(d.reason, ''), '^\s+|\s+$', '', 'g') = '')"


@query(f"select * from {_OPEN}", **{k: _V[k] for k in ("d_units", "d_translations", "d_terms", "d_decisions")})
def issue_decisions(spark, sf_dir):
    u, t, terms, d = _v(spark, sf_dir, "d_units", "d_translations", "d_terms", "d_decisions")
    return units.open_issues(units.inspect(u, t, terms), d)


_HEADS = """(select u.doc_id, unnest(list_filter([case when h.doc_id is null then 'semantic_review_missing' end, case when h.stale then 'stale_review' end, case when trim(h.reviewer) = '' then 'reviewer_missing' end], lambda x: x is not null)) as blocker
  from (select distinct doc_id from d_units) u left join d_heads h on h.doc_id = u.doc_id)"""
_REVIEWED = f"(select doc_id, id as blocker from {_OPEN} where severity <> 'error' union all select doc_id, unit_id || ':semantic_review' from {_GAPS} union all select doc_id, 'review_coverage' from {_COVER})"


def _review_heads(spark, sf_dir, u, t):
    """A review of each document, of its current version unless it is stale."""
    current = units.versions(u, t)
    heads = v.spark_view(spark, sf_dir, v.REVIEW_HEADS).join(current, "doc_id")
    return current, heads.select("doc_id", "document_sha256", F.when(F.col("stale"), F.lit("older")).otherwise(F.col("translation_sha256")).alias("translation_sha256"), "reviewer")


@query(f"select * from {_HEADS}", d_units=v.UNITS, d_heads=v.REVIEW_HEADS)
def review_states(spark, sf_dir):
    u, t = _v(spark, sf_dir, "d_units", "d_translations")
    return units.review_state(*_review_heads(spark, sf_dir, u, t))


@query(
    f"select u.doc_id, cast(count(b.blocker) as bigint) as n_blockers, case when count(b.blocker) > 0 then 'needs_review' else 'reviewed' end as status"
    f" from (select distinct doc_id from d_units) u left join (select doc_id, id as blocker from {_ISSUES} where severity = 'error' union all select * from {_HEADS}"
    f" union all select * from {_REVIEWED} r where r.doc_id in (select doc_id from d_heads)) b on b.doc_id = u.doc_id group by u.doc_id",
    **_V, d_heads=v.REVIEW_HEADS,
)
def assess_status(spark, sf_dir):
    u, t, terms, r, d = _v(spark, sf_dir, *_V)
    current, heads = _review_heads(spark, sf_dir, u, t)
    return units.assess(u, t, terms, heads, r, d, current)


@query(
    f"select cast(max(case status when 'reviewed' then 0 else 2 end) as bigint) as code, count(*) as n from (select u.doc_id, case"
    f" when count(b.blocker) > 0 then 'needs_review' else 'reviewed' end as status from (select distinct doc_id from d_units) u left join (select doc_id, unit_id as blocker"
    f" from {_GAPS}) b on b.doc_id = u.doc_id group by u.doc_id)", d_units=v.UNITS, d_reviews=v.REVIEWS)
def review_gate(spark, sf_dir):
    u, r = _v(spark, sf_dir, "d_units", "d_reviews")
    bad = units.review_gaps(u, r).select("doc_id").distinct().withColumn("status", F.lit("needs_review"))
    return gate.gate(u.select("doc_id").distinct().join(bad, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("reviewed"))))


@query("select doc_id, id, string_agg(id, ',') over (partition by doc_id order by ord rows between 1 preceding and 1 following) as near from d_units", d_units=v.UNITS)
def neighbor_context(spark, sf_dir):
    return units.neighbours(*_v(spark, sf_dir, "d_units"))


@query(
    "select doc_id, ord, id from (select doc_id, ord, id, ord % 5 = 0 as chosen, coalesce(lag(ord % 5 = 0) over w, false) or coalesce(lead(ord % 5 = 0) over w,"
    " false) as beside from d_units window w as (partition by doc_id order by ord)) where not chosen and (beside or ord = 1)", d_units=v.UNITS)
def read_only_context(spark, sf_dir):
    (u,) = _v(spark, sf_dir, "d_units")
    return units.read_only_context(u, u.filter("ord % 5 = 0"), u.filter("ord = 1"))


@query(
    """, packed as (
  select doc_id, ord, 1 as step, cast(1 as bigint) as n, cost as bytes, cast(0 as bigint) as batch_no, cost from costs where step = 1
  union all
  select c.doc_id, c.ord, c.step, case when p.n + 1 > 8 or p.bytes + c.cost > 4000 then 1 else p.n + 1 end, case when p.n + 1 > 8 or p.bytes + c.cost > 4000 then c.cost else p.bytes + c.cost end, p.batch_no + cast(p.n + 1 > 8 or p.bytes + c.cost > 4000 as int), c.cost
  from packed p join costs c on c.doc_id = p.doc_id and c.step = p.step + 1)
select doc_id, ord, batch_no, cost <= 4000 as fits from packed"""
)
def greedy_batches(spark, sf_dir):
    (u,) = _v(spark, sf_dir, "d_units")
    return packing.pack_additive(u.select("doc_id", "ord", F.octet_length("source").alias("cost")), 4000, 8)


ORACLES["greedy_batches"] = (
    f"with recursive d_units as ({v.duck(v.UNITS)}), costs as materialized (select doc_id, ord, row_number() over (partition by doc_id order by ord) as step,"
    f" cast(strlen(source) as bigint) as cost from d_units)"
) + ORACLES["greedy_batches"]


@query("select doc_id, cast(sum(length(source)) as bigint) as content_chars, cast(sum(strlen(source)) as bigint) as content_utf8_bytes, count(*) as n_units from d_units group by doc_id", d_units=v.UNITS)
def packet_bytes(spark, sf_dir):
    return units.packet_sizes(*_v(spark, sf_dir, "d_units"))


@query(
    "select doc_id, unit_id, unnest(list_filter([case when kind in ('table', 'algorithm', 'theorem') then 'structured_' || kind end, case when contains(source,"
    " '[[EQ:') then 'protected_formula' end, case when length(source) > 1200 then 'long_source_unit' end], lambda x: x is not null)) as reason, substr(source, 1,"
    " 160) as source_quote from (select *, id as unit_id from d_units)", d_units=v.UNITS)
def risk_units(spark, sf_dir):
    return units.risks(*_v(spark, sf_dir, "d_units"))


# ---- Cache and ledger

_PUT = (
    f"(select block_id, seq, sha256(source) as source_sha256, translation, sha256(translation) as translation_sha256, case when validated and issues <> '' then 'rejected'"
    f" when validated then 'validated' else 'needs_review' end as status, issues from (select *, array_to_string(list_filter([case"
    f" when translation = '' then 'empty_translation' end, case when {toks('source')} <> {toks('translation')} then 'protected_tokens_changed' end], lambda x: x is not null),"
    f" ',') as issues from d_log))"
)
_LAST = f"(select * from {_PUT} where status <> 'rejected' qualify row_number() over (partition by block_id order by seq desc) = 1)"


@query(f"select block_id, seq, source_sha256, translation_sha256, status, issues from {_LAST}", d_log=v.CACHE_LOG)
def cache_latest(spark, sf_dir):
    return cache.latest(cache.put(v.spark_view(spark, sf_dir, v.CACHE_LOG))).drop("translation")


@query(
    f"select w.block_id, case when b.status = 'validated' and b.source_sha256 = w.source_sha256 then case"
    f" when sha256(b.translation) = b.translation_sha256 then 'hit' else 'corrupt' end else 'miss' end as outcome from (select d.block_id, sha256(t.text) as source_sha256"
    f" from d_wanted d join documents t on t.doc_id = d.last_id) w left join {_LAST} b on b.block_id = w.block_id", d_log=v.CACHE_LOG, d_wanted=v.CACHE_WANTED)
def cache_probe(spark, sf_dir):
    wanted = v.spark_view(spark, sf_dir, v.CACHE_WANTED).join(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("last_id"), F.sha2("text", 256).alias("source_sha256")), "last_id")
    return cache.probe(wanted.select("block_id", "source_sha256"), cache.latest(cache.put(v.spark_view(spark, sf_dir, v.CACHE_LOG))))


@query(f"select status, count(*) as n from {_LAST} group by status", d_log=v.CACHE_LOG)
def cache_summary(spark, sf_dir):
    return cache.summary(cache.latest(cache.put(v.spark_view(spark, sf_dir, v.CACHE_LOG))))


@query("select doc_id, request_id, count(*) as n, count(distinct response_sha256) as n_responses from d_ledger group by doc_id, request_id having count(distinct response_sha256) > 1", d_ledger=v.LEDGER)
def ledger_conflicts(spark, sf_dir):
    return cache.ledger_conflicts(v.spark_view(spark, sf_dir, v.LEDGER))


@query("select doc_id, request_id, min(seq) as seq, arg_min(response_sha256, seq) as response_sha256 from d_ledger group by doc_id, request_id", d_ledger=v.LEDGER)
def ledger_accepted(spark, sf_dir):
    return cache.ledger_accepted(v.spark_view(spark, sf_dir, v.LEDGER))


# ---- Regions and measured images


@query(
    "select doc_id, page, box, kind, num from (select b.doc_id, b.page, b.box, r.kind, r.num, row_number() over (partition by b.doc_id, b.page, b.box"
    " order by (r.x1 - r.x0) * (r.y1 - r.y0), r.ord) as k from d_boxes b join d_regions r on r.doc_id = b.doc_id and r.page = b.page and (b.x0 + b.x1) / 2 between r.x0 - 6"
    " and r.x1 + 6 and (b.y0 + b.y1) / 2 between r.y0 - 6 and r.y1 + 6) where k = 1", d_boxes=v.BOXES, d_regions=v.REGIONS)
def region_hit(spark, sf_dir):
    return regions.locate(v.spark_view(spark, sf_dir, v.BOXES), v.spark_view(spark, sf_dir, v.REGIONS))


@query(
    "select i.doc_id, i.box, r.ord, cast(row_number() over (partition by i.doc_id, i.box order by r.ord) as bigint) as rank from d_boxes i"
    " join d_regions r on r.doc_id = i.doc_id and r.kind = case when i.box % 3 = 0 then 'tab' else 'fig' end and r.num = 1 + i.box % 2 qualify rank <= 3", d_boxes=v.BOXES, d_regions=v.REGIONS)
def declared_regions(spark, sf_dir):
    b = v.spark_view(spark, sf_dir, v.BOXES).withColumn("declared_kind", F.when(F.col("box") % 3 == 0, "tab").otherwise("fig")).withColumn("declared_num", 1 + F.col("box") % 2)
    return regions.declared(b, v.spark_view(spark, sf_dir, v.REGIONS))


_HITS = (
    "(select doc_id, kind, num from (select b.doc_id, b.page, b.box, r.kind, r.num, row_number() over (partition by b.doc_id, b.page, b.box"
    " order by (r.x1 - r.x0) * (r.y1 - r.y0), r.ord) as k from d_boxes b join d_regions r on r.doc_id = b.doc_id and r.page = b.page and (b.x0 + b.x1) / 2 between r.x0 - 6"
    " and r.x1 + 6 and (b.y0 + b.y1) / 2 between r.y0 - 6 and r.y1 + 6) where k = 1)"
)


@query(
    f"select * from (select r.doc_id, r.kind, r.num, case when m.n is null then 'uncovered' when m.n > 1 then 'duplicated' end as state from (select distinct doc_id, kind, num"
    f" from d_regions) r left join (select doc_id, kind, num, count(*) as n from {_HITS} group by all) m using (doc_id, kind, num)) where state is not null", d_boxes=v.BOXES, d_regions=v.REGIONS)
def region_coverage(spark, sf_dir):
    r = v.spark_view(spark, sf_dir, v.REGIONS)
    return regions.coverage(r, regions.locate(v.spark_view(spark, sf_dir, v.BOXES), r))


@query("select doc_id, box, ord, score, sqdiff, cast(row_number() over (partition by doc_id, box order by score desc, ord) as bigint) as rank from d_scores qualify rank <= 3", d_scores=v.SCORES)
def top3_regions(spark, sf_dir):
    return regions.top_candidates(v.spark_view(spark, sf_dir, v.SCORES))


@query(
    "select doc_id, box, ord, next_ord from (select *, lead(sqdiff) over w as next_sqdiff, lead(ord) over w as next_ord, row_number() over w as k"
    " from d_scores window w as (partition by doc_id, box order by sqdiff, ord)) where k = 1 and next_ord <> ord and next_sqdiff < greatest(0.0015, 2.5 * sqdiff)", d_scores=v.SCORES)
def ambiguous_regions(spark, sf_dir):
    return regions.ambiguous(v.spark_view(spark, sf_dir, v.SCORES))


@query("select doc_id, page, num, col, y0, y1, coalesce(lag(y1) over (partition by doc_id, page, col order by y0, num), 40.0) as top from d_captions", d_captions=v.CAPTIONS)
def prev_caption(spark, sf_dir):
    return regions.crop_tops(v.spark_view(spark, sf_dir, v.CAPTIONS))


@query(
    """select doc_id, page, num, case when use then ux0 else 0.0 end as x0, case when use then uy0 else top end as y0, case when use then ux1 else 300.0 end as x1, case when use then uy1 else bottom end as y1 from (
  select z.doc_id, z.page, z.num, top, bottom, min(b.x0) filter (i) as ux0, min(b.y0) filter (i) as uy0, max(b.x1) filter (i) as ux1, max(b.y1) filter (i) as uy1, coalesce(max(b.x1) filter (i) - min(b.x0) filter (i) >= 0.55 * 300, false) as use
  from (select doc_id, page, num, coalesce(lag(y1) over (partition by doc_id, page, col order by y0, num), 40.0) as top, y0 as bottom from d_captions) z left join d_boxes b on b.doc_id = z.doc_id and b.page = z.page, lateral (select b.x0 >= -1 and b.x1 <= 301 and b.y0 >= top and b.y1 <= bottom as i) group by all)""",
    d_captions=v.CAPTIONS,
    d_boxes=v.BOXES,
)
def crop_boxes(spark, sf_dir):
    z = regions.crop_tops(v.spark_view(spark, sf_dir, v.CAPTIONS)).select("doc_id", "page", "num", F.lit(0.0).alias("x0"), F.lit(300.0).alias("x1"), "top", F.col("y0").alias("bottom"))
    return regions.crop_boxes(z, v.spark_view(spark, sf_dir, v.BOXES))


_LIMIT = "case img_type when 'lineart' then 0.05::double when 'halftone' then 0.35::double else 0.20::double end"


def _severity_sql(label: str, otherwise: str, *steps: tuple[str, str]) -> str:
    return "case " + " ".join(f"when {condition} then {x}" for condition, x in steps) + f" else {otherwise} end as {label}"


_MAJOR = "coalesce(iou < 0.35, false) or coalesce(missing / lim > 3, false) or coalesce(extra / lim > 3, false) or coalesce(cc < 0.40, false)"
_LESS = "coalesce(iou < 0.60, false) or coalesce(missing / lim > 1, false) or coalesce(extra / lim > 1, false)"
_MINOR = "coalesce(missing / lim > 0.5, false) or coalesce(extra / lim > 0.5, false)"


@query(
    "select doc_id, "
    + _severity_sql("severity", "'ok'", ("dup or mismatch or unmatched", "'critical'"), ("not ok", "'unknown'"), (f"{_MAJOR} or {_LESS}", "'major'"), ("coalesce(iou < 0.80, false)", "'moderate'"), (_MINOR, "'minor'"))
    + ", cast("
    + _severity_sql("x", "9", ("dup", "0"), ("mismatch", "1"), ("unmatched", "2"), ("not ok", "5"), (_MAJOR, "3"), (_LESS, "4"), ("coalesce(iou < 0.80, false)", "6"), (_MINOR, "7")).removesuffix(" as x")
    + f" as bigint) as rank from (select *, {_LIMIT} as lim from d_metrics)",
    d_metrics=v.METRICS,
)
def severity_ladder(spark, sf_dir):
    return regions.severity(v.spark_view(spark, sf_dir, v.METRICS), "doc_id")


_FLAGS = {
    "UNDECODABLE": "not decoded",
    "DUPLICATE_BYTES": "decoded and dup",
    "UNMATCHED": "decoded and unmatched",
    "LOW_CORRELATION": "placed and cc < 0.70",
    "INK_MISSING": "placed and ok and missing > lim",
    "INK_EXTRA": "placed and ok and extra > lim",
    "SOLID_BLOB": "placed and ok and img_type = 'lineart' and blobs > 0",
    "GLYPH_VANISHED": "placed and ok and img_type = 'lineart' and vanished_area > 40",
    "STRETCHY_GLYPH_LOSS": "placed and ok and img_type = 'lineart' and stretchy_page > stretchy_crop and missing > 0.02",
    "PAGE_REGION": "placed and page_share > 0.45",
    "SLOT_MISMATCH": "placed and mismatch",
    "LABEL_CONFLICT": "placed and label_conflict",
    "NOT_AT_DECLARED_SLOT": "placed and declared_sqdiff > 0.020 and not mismatch",
}


@query(
    "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when {c} then '{name}' end" for name, c in _FLAGS.items()) + f"], lambda x: x is not null), ',') as flags from (select *, decoded and not unmatched as placed, {_LIMIT} as lim from d_metrics)",
    d_metrics=v.METRICS,
)
def image_flags(spark, sf_dir):
    return regions.flags(v.spark_view(spark, sf_dir, v.METRICS), "doc_id")


@query("select doc_id, coalesce(declared_kind = hit_kind and declared_num <> 0 and hit_num <> declared_num and not ambiguous, false) as mismatch from d_metrics", d_metrics=v.METRICS)
def slot_mismatches(spark, sf_dir):
    mismatch = regions.slot_mismatch(*map(F.col, ("declared_kind", "declared_num", "hit_kind", "hit_num", "ambiguous")))
    return v.spark_view(spark, sf_dir, v.METRICS).select("doc_id", mismatch.alias("mismatch"))


@query(
    "select band, count(*) as n from (select case when sqdiff is null then 'unknown' when sqdiff <= 0.0003 then 'clean' when sqdiff <= 0.0092 then 'minor'"
    " when sqdiff <= 0.16 then 'suspect' else 'nonmatch' end as band from d_metrics) group by band", d_metrics=v.METRICS)
def match_bands(spark, sf_dir):
    return v.spark_view(spark, sf_dir, v.METRICS).groupBy(regions.band(F.col("sqdiff")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "select doc_id, case when coalesce(med > 2 or iou < 0.30 or ink < 200, true) then 'unverified' when unexplained >= 0.02 and vanished <= unexplained / 3"
    " and ratio between 1.03 and 1.8 then 'ghost' else 'clean' end as class from d_metrics", d_metrics=v.METRICS)
def ghost_class(spark, sf_dir):
    c = regions.ghost_class(*[F.col(x) for x in ("med", "iou", "ink", "unexplained", "vanished", "ratio")])
    return v.spark_view(spark, sf_dir, v.METRICS).select("doc_id", c.alias("class"))


@query(
    """select doc_id, page, kind, num, round(case when kind = 'eq' then width * 0.04::double else greatest(0, x0 - 10) end, 1) as x0, round(case when kind = 'eq' then y0 - 46 else greatest(0, y0 - 400) end, 1) as y0, round(case when kind = 'eq' then x1 + 18 else least(width, x1 + 10) end, 1) as x1, round(case when kind = 'eq' then y1 + 26 else y1 + 2 end, 1) as y1
from (select doc_id, page, 'eq' as kind, cast(regexp_extract(text, '^\\(([0-9]{1,3})\\)$', 1) as int) as num, x0, y0, x1, y1, 600::double as width from d_words where regexp_matches(text, '^\\([0-9]{1,3}\\)$') and x0 > 0.42::double * width
  union all select doc_id, page, kind, cast(regexp_extract(text, '[0-9]+') as int), x0, y0, x1, y1, 600::double from (select *, case when regexp_matches(text, '(?i)^\\s*Table\\s*[0-9]+') then 'tab' when regexp_matches(text, '(?i)^\\s*Fig(?:ure)?\\.?\\s*[0-9]+') then 'fig' end as kind from d_blocks) where kind is not null)""",
    d_words=v.PDF_WORDS,
    d_blocks=v.BLOCKS,
)
def candidate_rects(spark, sf_dir):
    anchors = files.anchors(v.spark_view(spark, sf_dir, v.PDF_WORDS), v.spark_view(spark, sf_dir, v.BLOCKS))
    return regions.candidate_rects(anchors.withColumn("width", F.lit(600.0)))


@query(
    "select doc_id, ord, size, rank from (select doc_id, box as ord, (x1 - x0) * (y1 - y0 + box % 3) as size, row_number() over (partition by doc_id"
    " order by (x1 - x0) * (y1 - y0 + box % 3) desc, box) as rank from d_boxes) where rank <= 2", d_boxes=v.BOXES)
def largest_boxes(spark, sf_dir):
    boxes = v.spark_view(spark, sf_dir, v.BOXES).withColumn("ord", F.col("box"))
    return regions.largest(boxes, ["doc_id"], (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0") + F.col("box") % 3), 2).select("doc_id", "ord", "size", "rank")


@query("select doc_id, page, box, x0 * 72 / 150::double as x0, y0 * 72 / 150::double as y0, round_even(612 * (x0 / 600), 1) as left_share from d_boxes", d_boxes=v.BOXES)
def point_boxes(spark, sf_dir):
    b = v.spark_view(spark, sf_dir, v.BOXES)
    share = F.bround(F.lit(612.0) * (F.col("x0") / 600), 1).alias("left_share")
    return b.select("doc_id", "page", "box", regions.to_points(F.col("x0"), 150).alias("x0"), regions.to_points(F.col("y0"), 150).alias("y0"), share)


_LINES_READ = "select doc_id, page, x0 as x, y0 * 7 as y, text, cast(doc_id % 100 as double) / 100 as score from d_words"


@query(f"select doc_id, page, string_agg(text || ' (' || printf('%.2f', score) || ')', ' | ' order by round_even(y / 20, 0), x, text) as text from ({_LINES_READ}) group by doc_id, page", d_words=v.PDF_WORDS)
def recognised_lines(spark, sf_dir):
    w = v.spark_view(spark, sf_dir, v.PDF_WORDS)
    rows = w.select("doc_id", "page", F.col("x0").alias("x"), (F.col("y0") * 7).alias("y"), "text", ((F.col("doc_id") % 100).cast("double") / 100).alias("score"))
    return files.read_order(rows, ["doc_id", "page"])


@query(f"select page_id, idx, alt from {_IMGS} where idx < 2", d_html=v.HTML)
def first_images(spark, sf_dir):
    return images.first_images(_images(spark, sf_dir), 2).select("page_id", "idx", "alt")


# ---- Rasters


def _threshold(c: str) -> str:
    """Otsu's threshold of a column of grey levels, the lowest of equals."""
    return f"""(select doc_id, t from (select doc_id, t, sum(n) filter (v <= t) as w, sum(n * v) filter (v <= t) as m, sum(n) as total, sum(n * v) as whole from (select doc_id, {c} as v, count(*) as n from d_pixels group by all), (select unnest(range(0, 256)) as t) group by doc_id, t)
  where w > 0 and w < total qualify row_number() over (partition by doc_id order by (whole * w - m * total)::double * (whole * w - m * total)::double / (w * (total - w))::double desc, t) = 1)"""


_INKED = f"(select p.*, p.a <= ta.t as ia, p.b <= tb.t as ib, ta.t as t from d_pixels p join {_threshold('a')} ta using (doc_id) join {_threshold('b')} tb on tb.doc_id = p.doc_id)"


def _pixels(spark, sf_dir):
    """One row an item: the arrays of both rasters."""
    rows = v.spark_view(spark, sf_dir, v.PIXELS).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "a", "b"))).alias("p"), (F.max("x") + 1).alias("w"))
    return rows.select("doc_id", "w", *[F.col(f"p.{c}").alias(c) for c in ("a", "b")])


@query(
    """select doc_id, case when avg(case when a between 40 and 215 then 1.0 else 0.0 end) > 0.18 then 'halftone' else 'lineart' end as img_type, cast(any_value(t) as bigint) as threshold, count(*) filter (ia) as ink, count(*) filter (ib and not near_a) as missing, count(*) filter (ia and not near_b) as extra, count(*) filter (ia and ib) as common
from (select p.doc_id, p.x, p.y, p.a, p.t, p.ia, p.ib, bool_or(q.ia) as near_a, bool_or(q.ib) as near_b from inked p join inked q on q.doc_id = p.doc_id and abs(q.x - p.x) <= 1 and abs(q.y - p.y) <= 1 group by all) group by doc_id""",
    d_pixels=v.PIXELS,
    inked=f"select * from {_INKED}",
)
def raster_measures(spark, sf_dir):
    return fidelity.measure(_pixels(spark, sf_dir)).select("doc_id", "img_type", "threshold", "ink", "missing", "extra", "common")


@query()
def raster_components(spark, sf_dir):
    return fidelity.measure(_pixels(spark, sf_dir)).select("doc_id", "n_components", "n_blobs", "n_tall")


PAGE_W, PAGE_H = 320, 240
_PLACES = (("fig", 1, 0.0, 0.0, 19.2, 28.8), ("fig", 2, 19.2, 0.0, 38.4, 28.8))  # both halves of a page, in points


def _drawn(batches):
    """A page for each text, with strokes by its bytes, and three images: a true crop, one with a part lost (of another number for
    every third item), and one that cannot be decoded or doubles its strokes."""
    import numpy as np
    import pandas as pd

    from ..functions import rasters

    for pdf in batches:
        rows = []
        for i, text in zip(pdf["item_id"], pdf["text"]):
            page = np.full((PAGE_H, PAGE_W), 245, np.uint8)
            for k, c in enumerate((text or " ").encode()[:160]):
                y, x = (k * 37 + c * 5) % (PAGE_H - 24), (k * 53 + c * 11) % (PAGE_W - 24)
                page[y : y + 4 + c % 17, x : x + 4 + c % 13] = 20 + c % 40
            lost = page[40:200, 180:300].copy()
            lost[60:120, 40:90] = 245
            part = page[30:210, 10:150]
            doubled = np.minimum(part, np.roll(part, (9, 11), (0, 1)))
            images = [(0, rasters.encode_png(page[20:200, 20:140]), 1), (1, rasters.encode_png(lost), 1 if i % 3 == 0 else 2), (2, b"no image" if i % 5 == 0 else rasters.encode_png(doubled), 1)]
            rows += [(i, 1, rasters.encode_png(page), n, content, num) for n, content, num in images]
        yield pd.DataFrame(rows, columns=["doc_id", "page", "sheet", "idx", "content", "declared_num"])


def _cut(spark, sf_dir):
    """images, pages and places drawn from the benchmark's texts."""
    rows = _t(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(_drawn, "doc_id long, page long, sheet binary, idx long, content binary, declared_num long")
    pages = rows.filter("idx = 0").select("doc_id", "page", F.col("sheet").alias("content"))
    places = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("kind", "num", "x0", "y0", "x1", "y1"), place)]) for place in _PLACES]))
    images_ = rows.select("doc_id", "idx", "content", F.lit("fig").alias("declared_kind"), "declared_num", (F.col("doc_id") % 7 == 0).alias("label_conflict"))
    return images_, pages, pages.select("doc_id", "page", places.alias("p")).select("doc_id", "page", "p.*").withColumn("num", F.col("num").cast("long"))


@query()
def crop_fidelity(spark, sf_dir):
    """Severity and flags of images against the pages that they were cut from."""
    images_, pages, places = _cut(spark, sf_dir)
    return fidelity.judge(images_, fidelity.locate(images_, pages, places))


@query()
def image_ghosts(spark, sf_dir):
    images_, pages, _ = _cut(spark, sf_dir)
    return fidelity.ghosts(images_, pages).select("doc_id", "idx", "class")


# ---- Scans that keep positions (no SQL form; tests compare them with small examples)


@query()
def text_nodes(spark, sf_dir):
    return scanner.text_nodes(v.spark_view(spark, sf_dir, v.HTML), "page_id", "html")


@query()
def math_spans(spark, sf_dir):
    shown = v.spark_view(spark, sf_dir, v.HTML).withColumn("html", F.concat(F.lit("<script>renderMathInElement(document.body, {delimiters: [{left: '$$', right: '$$', display: true}, {left: '$', right: '$', display: false}]});</script>"), "html"))
    return scanner.math_spans(shown, "page_id", "html")


@query()
def image_captions(spark, sf_dir):
    return scanner.captions(v.spark_view(spark, sf_dir, v.HTML), "page_id", "html")


@query()
def image_contexts(spark, sf_dir):
    return scanner.image_contexts(v.spark_view(spark, sf_dir, v.HTML), "page_id", "html")


@query()
def declared_identity(spark, sf_dir):
    """What each image claims to be by its label or the captions around it; image_identity reads the label alone."""
    return scanner.image_identities(v.spark_view(spark, sf_dir, v.HTML), "page_id", "html")


@query()
def page_audit(spark, sf_dir):
    return scanner.page_findings(v.spark_view(spark, sf_dir, v.HTML), "page_id", "html")


@query()
def page_verdicts(spark, sf_dir):
    """Whether a page has no blocking finding of any rule, structural or of its images."""
    pages = v.spark_view(spark, sf_dir, v.HTML)
    found = scanner.page_findings(pages, "page_id", "html").select(F.col("page_id").alias("subject_id"), "severity")
    found = found.unionByName(leaks.reference_findings(pages, "page_id", "html").select("subject_id", "severity"))
    return leaks.verdicts(pages, found.unionByName(images.findings(images.extract(pages, "page_id", "html"), "page_id").select("subject_id", "severity")), "page_id")


# Lines of documents as units, as split_units makes them, with their place in the document and running bytes.
_SIZED = """sized as materialized (select *, sum(size) over (partition by doc_id order by k) as until, count(*) over (partition by doc_id) as n from (select doc_id, ord, octet_length(encode(line)) as size, row_number() over (partition by doc_id order by ord) as k
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as ord from documents) where line <> ''))"""


@query(
    f"""with recursive {_SIZED},
cost as materialized (select a.doc_id, a.ord, a.k, a.n, b.k as first, coalesce(c.until, a.until) - coalesce(d.until, 0) as bytes from sized a join sized b on b.doc_id = a.doc_id and b.k between a.k - 7 and a.k left join sized c on c.doc_id = a.doc_id and c.k = a.k + 1 left join sized d on d.doc_id = a.doc_id and d.k = b.k - 2),
bad as (select distinct doc_id from cost where first = k and bytes > 24000),
walk as (select doc_id, ord, k, k as first, 0 as batch_no from sized where k = 1
  union all select x.doc_id, x.ord, x.k, case when x.k - w.first < 8 and y.bytes <= 24000 then w.first else x.k end, w.batch_no + case when x.k - w.first < 8 and y.bytes <= 24000 then 0 else 1 end from walk w join sized x on x.doc_id = w.doc_id and x.k = w.k + 1 left join cost y on y.doc_id = x.doc_id and y.k = x.k and y.first = w.first)
select doc_id, cast(ord as bigint) as ord, cast(batch_no as bigint) as batch_no, cast(null as varchar) as error from walk where doc_id not in (select doc_id from bad) union all select doc_id, null, null, 'a unit with its full context exceeds the budget' from bad"""
)
def exact_batches(spark, sf_dir):
    u = units.split_units(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "ord", F.octet_length("source").alias("size"))
    return packing.pack_exact(u, packing.with_neighbours, 24_000, 8)


# ---- Workflow


_blank_units = r"(select doc_id, bool_or(regexp_full_match(line, '\s*')) as bad from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where line <> '' group by doc_id)"


@query(
    f"""select cast(doc_id as varchar) as doc_id, cast(seq as bigint) as seq, case when bad then 'rejected' when seq = 1 then 'started' else 'request' end as outcome, case when not bad then 'analyze' end as phase,
  case when bad and seq = 1 then 'a unit''s kind or source is invalid' when bad then 'the flow has not started' end as detail from {_blank_units}, (select 1 as seq union all select 2)"""
)
def flow_outcomes(spark, sf_dir):
    """Starts a flow for every document and asks for its first request."""
    u = units.split_units(_t(spark, sf_dir, "documents"), "doc_id", "text")
    unit = F.struct(F.col("ord"), F.col("id"), F.lit("prose").alias("kind"), F.lit(1).alias("page"), "source")
    payload = u.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(unit)).alias("units"), F.lit(200_000).alias("budget"))).alias("payload"))
    both = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("seq"), F.lit("start").alias("kind")), F.struct(F.lit(2).cast("long").alias("seq"), F.lit("next").alias("kind"))))
    events = payload.select(F.col("doc_id").cast("string").alias("doc_id"), both.alias("e"), "payload").select("doc_id", "e.seq", "e.kind", F.lit(None).cast("string").alias("request_id"), F.when(F.col("e.kind") == "start", F.col("payload")).alias("payload"))
    return flow.run_batch(events).select("doc_id", "seq", "outcome", "phase", "detail")


# ---- Sources, sinks and workflow checks


def _patched(before: str, patch: str, marker: str) -> str:
    text = patch.replace("'", "''")
    out = f"case when instr(html, '{before}') > 0 and not contains(html, '{marker}') then substr(html, 1, instr(html, '{before}') - 1) || '{text}' || substr(html, instr(html, '{before}')) else html end"
    return f"select page_id, {out} <> html as changed, sha256({out}) as sha from pages"


@query(_patched("</style>", sinks.OVERLAP_CSS, "plumbline:tags"))
def overlap_patch(spark, sf_dir):
    return sinks.patch_overlap(_t(spark, sf_dir, "pages"), "html").select("page_id", "changed", F.sha2("html", 256).alias("sha"))


@query(_patched("</body>", sinks.WIDE_JS, "plumbline:wide"))
def wide_patch(spark, sf_dir):
    return sinks.patch_wide(_t(spark, sf_dir, "pages"), "html").select("page_id", "changed", F.sha2("html", 256).alias("sha"))


@query(
    r"""select doc_id, sha256(case when doc_id % 7 = 0 then md else replace(md, '(assets/fig' || (doc_id % 50) || '.png)', '(data:image/png;base64,' || base64(encode('fig' || (doc_id % 50) || '.png')) || ')') end) as sha,
  array_to_string(list_sort(list_filter(['assets/fig' || (doc_id % 50 + 1) || '.png', case when doc_id % 7 = 0 then 'assets/fig' || (doc_id % 50) || '.png' end], lambda x: x is not null)), ',') as missing from d_md""",
    d_md=v.MD,
)
def self_contained_markdown(spark, sf_dir):
    held = v.spark_view(spark, sf_dir, v.ASSETS).filter(F.col("name") == F.concat(F.lit("fig"), (F.col("doc_id") % 50).cast("string"), F.lit(".png")))
    held = held.select("doc_id", F.concat(F.lit("assets/"), "name").alias("name"), F.encode("name", "utf-8").alias("content"))
    return sinks.self_contained(v.spark_view(spark, sf_dir, v.MD), held, "doc_id", "md").select("doc_id", F.sha2("md", 256).alias("sha"), "missing")


@query(
    """select key, path as src, dir || '/' || name as dst, 'overwrite' as action from j where ends_with(lower(name), '.html')
union all select distinct key, path, dir || '/' || regexp_extract(path, '[^/]+$'), 'copy' from j where key not in (select key from j where ends_with(lower(name), '.html'))""",
    d_files=v.FILES,
    d_targets=v.TARGETS,
    j="select upper(f.key) as key, path, dir, name from d_files f join d_targets t on upper(f.key) = upper(t.key) where regexp_full_match(f.key, '[A-Za-z0-9]{8}')",
)
def overwrite_plan(spark, sf_dir):
    return sinks.overwrite_plan(v.spark_view(spark, sf_dir, v.FILES).drop("doc_id"), v.spark_view(spark, sf_dir, v.TARGETS))


@query(
    "select doc_id, sha256(string_agg(text, chr(10) || chr(10) order by ord) || chr(10)) as sha from d_translations where doc_id in (select doc_id from d_states"
    " where phase = 'text_reviewed') group by doc_id", d_translations=v.TRANSLATIONS, d_states=v.STATES)
def exported_markdown(spark, sf_dir):
    out = sinks.export_tables(v.spark_view(spark, sf_dir, v.STATES), *_v(spark, sf_dir, "d_translations"))
    return out.select("doc_id", F.sha2("markdown", 256).alias("sha"))


@query(
    r"select doc_id, page, num, col, y0 from (select *, cast(regexp_extract(string_split(text, chr(10))[1], '^Fig(?:ure)?\.?\s*([0-9]+)\s*[.:]', 1) as int) as num, case"
    r" when x0 < 300 then 'L' else 'R' end as col from (select * from d_blocks where regexp_matches(string_split(text, chr(10))[1], '^Fig(?:ure)?\.?\s*([0-9]+)\s*[.:]')"
    r" and len(string_split(text, chr(10))) <= 6))",
    d_blocks=v.BLOCKS,
)
def caption_blocks(spark, sf_dir):
    return files.captions(v.spark_view(spark, sf_dir, v.BLOCKS)).select("doc_id", "page", "num", "col", "y0")


@query(
    r"""select doc_id, page, 'eq' as kind, cast(regexp_extract(text, '^\(([0-9]{1,3})\)$', 1) as int) as num, x0, y0, x1, y1 from d_words where regexp_matches(text, '^\([0-9]{1,3}\)$') and x0 > 0.42::double * width
union all select doc_id, page, kind, cast(regexp_extract(text, '[0-9]+') as int), x0, y0, x1, y1 from (select *, case when regexp_matches(text, '(?i)^\s*Table\s*[0-9]+') then 'tab' when regexp_matches(text, '(?i)^\s*Fig(?:ure)?\.?\s*[0-9]+') then 'fig' end as kind from d_blocks) where kind is not null""",
    d_words=v.PDF_WORDS,
    d_blocks=v.BLOCKS,
)
def pdf_anchors(spark, sf_dir):
    return files.anchors(v.spark_view(spark, sf_dir, v.PDF_WORDS), v.spark_view(spark, sf_dir, v.BLOCKS))


@query(
    "select q.doc_id, q.unit_id, q.quote from d_quotes q left join d_units u on u.doc_id = q.doc_id and u.id = q.unit_id where u.id is null or not contains(u.source,"
    " q.quote) or trim(q.quote) = ''", d_quotes=v.QUOTES, d_units=v.UNITS)
def unsupported_quotes(spark, sf_dir):
    return units.unquoted(v.spark_view(spark, sf_dir, v.QUOTES), *_v(spark, sf_dir, "d_units"))


@query(
    "select doc_id, row_number() over (partition by doc_id order by first_ord) as ord, id, kind from (select doc_id, kind, min(ord) as first_ord, max_by(id, ord) as id"
    " from d_units group by doc_id, kind)", d_units=v.UNITS)
def last_of_kind(spark, sf_dir):
    return units.last_wins(v.spark_view(spark, sf_dir, v.UNITS), "kind")


_PERSONAL = [("the", "der"), ("et", "und"), ("rose", "stieg"), ("nowhere", "nirgends")]
_personal_sql = " union all ".join(rf"select distinct doc_id, '{a}' as term, '{b}' as target from d_units where regexp_matches(source, '(?i)(^|[^\p{{L}}\p{{N}}_]){a}($|[^\p{{L}}\p{{N}}_])')" for a, b in _PERSONAL)


@query(_personal_sql, d_units=v.UNITS)
def personal_terms(spark, sf_dir):
    return units.relevant_terms(*_v(spark, sf_dir, "d_units"), spark.createDataFrame(_PERSONAL, "term string, target string"))


@query(
    """select doc_id, id, rule from (select doc_id, id, unnest(list_filter([case when not regexp_matches(id, '""" + UNIT_ID + """') then 'unit_id' end, case when kind not in ("""
    + ", ".join(f"'{k}'" for k in KINDS)
    + """) then 'kind' end, case when trim(source) = '' then 'blank_source' end, case when page <= 0 then 'page' end], lambda x: x is not null)) as rule from d_bad)
union all select doc_id, id, 'duplicate_id' from d_bad group by doc_id, id having count(*) > 1""",
    d_bad=v.BAD_UNITS,
)
def invalid_units(spark, sf_dir):
    return units.unit_violations(v.spark_view(spark, sf_dir, v.BAD_UNITS))


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, following in flow.PROCESSING.items() for b in following)


@query(
    f"select doc_id, seq, before, status from (select *, lag(status) over (partition by doc_id order by seq) as before from d_history) where before is not null and (before,"
    f" status) not in ({_LEGAL})", d_history=v.HISTORY)
def illegal_steps(spark, sf_dir):
    return flow.illegal_transitions(v.spark_view(spark, sf_dir, v.HISTORY))


@query("select r.path, r.sha256, n.sha256 as now from d_inputs r left join d_now n on n.path = r.path where n.sha256 is distinct from r.sha256", d_inputs=v.INPUTS, d_now=v.INPUTS_NOW)
def changed_inputs(spark, sf_dir):
    return cache.changed_inputs(v.spark_view(spark, sf_dir, v.INPUTS), v.spark_view(spark, sf_dir, v.INPUTS_NOW))


@query(
    """select page_id, array_to_string(bad, ',') as problems, len(bad) = 0 as ok from (select page_id, list_filter([case when "overlaps" <> 0 then 'overlaps' end, case when broken <> 0 then 'broken' end, case when nonEmbedded <> 0 then 'nonEmbedded' end, case when leftoverDollar <> 0 then 'leftoverDollar' end], lambda x: x is not null) as bad from d_stats)""",
    d_stats=v.STATS,
)
def probe_verdicts(spark, sf_dir):
    return files.judge(v.spark_view(spark, sf_dir, v.STATS), "page_id")
