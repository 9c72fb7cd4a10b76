"""Derived inputs. The same SQL text builds them in Spark and in the oracle, so both engines check the same rows.

The driver's tables hold no markup, formulas, translations or measurements; these views add them to whole texts, with
defects at known rates by modular arithmetic on ids.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..schemas import BASE_CHECKS, KIND_CHECKS, KINDS

B = "chr(92)"

#: Only the oracle reads lines by this text; Spark makes them with posexplode.
_DUCK_LINES = "select doc_id, cast(k as bigint) as ord, parts[k] as line from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as k from (select doc_id, string_split(text, chr(10)) as parts from documents))"

MD = f"""
select doc_id, concat(text, chr(10),
  case when doc_id % 5 <> 0 then concat('Method summary', chr(10)) else '' end,
  '$$', chr(10), {B}, 'left( a + b ', case when doc_id % 7 = 3 then '' else concat({B}, 'right') end, ' ) ', {B}, 'tag{{1}}', chr(10), '$$', chr(10),
  case when doc_id % 6 <> 1 then concat('$$ E = m_{{ab}} ', {B}, 'rightarrow c ', {B}, 'tag{{2}} $$', chr(10)) else '' end,
  case when doc_id % 8 = 3 then concat({B}, 'tag{{9}}', chr(10)) else '' end,
  case when doc_id % 9 = 2 then concat({B}, 'tag{{1}} ', {B}, 'tag{{1}} ', {B}, 'tag{{1}}', chr(10)) else '' end,
  case when doc_id % 4 <> 0 then concat({B}, 'text{{(3b)}}', chr(10)) else '' end,
  case when doc_id % 11 = 4 then concat('$$', chr(10)) else '' end,
  case when doc_id % 13 = 5 then concat('cost $5', chr(10)) else '' end,
  case when doc_id % 10 = 5 then concat({B}, '(z', {B}, ')', chr(10)) else '' end,
  '![fig](assets/fig', cast(doc_id % 50 as varchar(9)), '.png)', chr(10),
  '![fig](assets/fig', cast(doc_id % 50 + 1 as varchar(9)), '.png)', chr(10),
  case when doc_id % 4 = 1 then concat('~~gone~~', chr(10)) else '' end,
  case when doc_id % 17 = 3 then concat('see /mnt/data', chr(10)) else '' end,
  case when doc_id % 19 = 2 then concat({B}, {B}, 'alpha', chr(10)) else '' end,
  case when doc_id % 21 = 1 then concat('> quoted', chr(10)) else '' end,
  case when doc_id % 16 = 3 then concat('$$ (I - a)(b - c) $$', chr(10)) else '' end,
  '$$ ', {B}, 'begin{{matrix}} 1 (2 ', case when doc_id % 3 = 0 then '' else concat(') ', {B}, 'end{{matrix}}') end, ' $$', chr(10),
  'x [[EQ:e', cast(doc_id as varchar(20)), ']] = ', cast(doc_id % 97 as varchar(9)), '.5%') as md
from {{documents}}
""".replace("{{", "{").replace("}}", "}")

ASSETS = " union all ".join(f"select doc_id, concat('fig', cast(doc_id % 50 + {k} as varchar(9)), '.png') as name from {{documents}}" + (" where doc_id % 7 <> 0" if k == 0 else "") for k in (0, 1, 2))


def _png(w: str, h: str) -> str:
    return f"base64(unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex(cast({w} as bigint)), 8, '0'), lpad(hex(cast({h} as bigint)), 8, '0'))))"


def _jpeg() -> str:
    """A frame header behind one segment or two."""
    size = lambda x: f"lpad(hex(cast({x} as bigint)), 4, '0')"
    return f"base64(unhex(concat('FFD8FFE000046162', case when page_id % 2 = 0 then 'FFFE00066A706567' else '' end, 'FFC0000B08', {size('page_id % 300 + 20')}, {size('page_id % 500 + 50')}, '01011100')))"


def _img(k: int) -> str:
    w = f"case when page_id % 9 = 0 then 150 else 100 + 50 * ((page_id + {k}) % 5) end"
    num = f"case when page_id % 7 = 2 then {5 - k} when page_id % 8 = 5 and {k} = 3 then 2 else {k} end"
    extra = "case when page_id % 6 = 1 then '>' else '' end" if k == 2 else "''"
    return f"""'<img src="data:image/png;base64,', {_png(w, '80')}, '" alt="图 {k}">', {extra}, '<p>图 ', cast({num} as varchar(9)), '：示例</p>'"""


HTML = f"""
select page_id, concat(html, {', '.join(_img(k) for k in (1, 2, 3))},
  case when page_id % 6 = 4 then '<img src="http://img.example.com/y.png" alt="remote">' else '' end,
  case when page_id % 11 = 3 then '<img src="data:image/png;base64,!!!!" alt="图 8">' else '' end,
  case when page_id % 3 = 1 then concat('<img src="data:image/gif;base64,', base64(unhex('4749463839612C01C800')), '" alt="eq (7)">') else '' end,
  case when page_id % 5 = 3 then '<script src="https://cdn.example.com/a.js"></script>' else '' end,
  case when page_id % 10 = 7 then '<span class="katex-error" title="x">y</span>' else '' end,
  case when page_id % 4 = 2 then '<p>见图 6 所示</p>' else '' end,
  case when page_id % 14 = 1 then '<p>参考文献 [1] A 2001</p>' else '' end,
  case when page_id % 15 = 2 then '<p>cost $3 **bold**</p>' else '' end,
  case when page_id % 13 = 6 then concat('<img src="data:image/jpeg;base64,', {_jpeg()}, '" alt="assets/eq_12.png">')
    when page_id % 13 = 7 then concat('<img src="data:image/jpeg;base64,', base64(unhex('FFD8FFE0000461620000000000000000')), '" alt="式 3">')
    when page_id % 13 = 8 then concat('<img src="data:image/png;base64,', {_png('250', '90')}, '" alt="fig-7">')
    when page_id % 13 = 9 then concat('<img src="data:image/png;base64,', {_png('260', '90')}, '" alt="table_2">')
    when page_id % 13 = 10 then concat('<img src="data:image/png;base64,', {_png('270', '90')}, '" alt="Equation 4 of 表 5">') else '' end) as html
from {{pages}}
"""

_kind = "case cast((ord + doc_id) % 7 as int) " + " ".join(f"when {k} then '{name}'" for k, name in enumerate(KINDS)) + " end"
UNITS = f"""
select doc_id, ord, concat('d', cast(doc_id as varchar(20)), '-b', cast(ord as varchar(20))) as id, 1 + cast(floor(ord / 10) as bigint) as page, {_kind} as kind,
  concat(line, case when ord % 3 = 0 then concat(' [[EQ:e', cast(ord as varchar(20)), ']] rose 3.5 % to ', cast(doc_id as varchar(20))) else '' end) as source
from ({{lines}}) as l where line <> ''
"""
TRANSLATIONS = f"""
select doc_id, ord, id, case when (doc_id * 31 + ord) % 17 = 0 then ' ' when (doc_id * 31 + ord) % 13 = 0 then concat(source, ' 77') when (doc_id * 31 + ord) % 19 = 0 then replace(source, 'EQ:e', 'EQ:f') else source end as text
from ({UNITS}) as u where (doc_id * 31 + ord) % 11 <> 0
"""
_unit = lambda k: f"concat('d', cast(doc_id as varchar(20)), '-b{k}')"
TERMS = f"""
select doc_id, cast(1 as bigint) as ord, 't1' as id, 'the' as source, case when doc_id % 2 = 0 then 'the' else 'nowhere' end as target, 'article' as sense, {{arr}}({_unit(1)}, {_unit(2)}) as unit_ids, 'approved' as status, {{arr}}('ninguno') as variants from {{documents}}
union all
select doc_id, cast(2 as bigint), 't2', 'The', case when doc_id % 2 = 0 then 'the' else 'nowhere' end, case when doc_id % 3 = 0 then 'noun' else 'article' end, {{arr}}({_unit(2)}, {_unit(3)}), 'approved', {{arr}}('ninguno') from {{documents}}
union all
select doc_id, cast(3 as bigint), 't3', 'of', 'nowhere', 'any', {{arr}}({_unit(1)}), 'candidate', {{arr}}('ninguno') from {{documents}}
"""


def _checks(kind: str, drop: bool) -> str:
    names = sorted([*BASE_CHECKS, *([KIND_CHECKS[kind]] if kind in KIND_CHECKS else [])])[1 if drop else 0 :]
    return "{arr}(" + ", ".join(f"'{n}'" for n in names) + ")"


_checks_case = "case when (doc_id + ord) % 29 = 0 then case kind " + " ".join(f"when '{k}' then {_checks(k, True)}" for k in KINDS) + " end else case kind " + " ".join(f"when '{k}' then {_checks(k, False)}" for k in KINDS) + " end end"
REVIEWS = f"""
select doc_id, ord, id, case when (doc_id + ord) % 23 = 0 then 'needs_review' else 'passed' end as verdict, {_checks_case} as checks, cast(case when (doc_id + ord) % 31 = 0 then 1 else 0 end as bigint) as n_findings
from ({UNITS}) as u where (doc_id + ord) % 97 <> 0
"""
#: One review a document: none for some, of an older translation for others, unsigned for others.
REVIEW_HEADS = "select doc_id, doc_id % 17 = 0 as stale, case when doc_id % 23 = 1 then ' ' else 'reader' end as reviewer from {documents} where doc_id % 19 <> 0"
DECISIONS = f"select doc_id, concat(id, ':numbers') as issue_id, case when ord % 4 = 0 then ' ' else 'unit converted' end as reason from ({UNITS}) as u where ord % 2 = 0"

CACHE_LOG = """
select concat('b', cast(doc_id % 500 as varchar(9))) as block_id, doc_id as seq, text as source, case when doc_id % 13 = 0 then '' when doc_id % 17 = 0 then concat(text, '[[IMG:x]]') else text end as translation, doc_id % 3 <> 0 as validated
from {documents}
"""
CACHE_WANTED = """
select concat('b', cast(doc_id % 700 as varchar(9))) as block_id, max(doc_id) as last_id from {documents} group by concat('b', cast(doc_id % 700 as varchar(9)))
"""
LEDGER = """
select doc_id % 300 as doc_id, concat('r', cast(doc_id % 5 as varchar(9))) as request_id, doc_id as seq, case when doc_id % 77 = 0 then concat('h', cast(doc_id as varchar(20))) else concat('h', cast(doc_id % 300 as varchar(9))) end as response_sha256 from {documents}
"""
_n = "select doc_id, cast(k as bigint) as k from {documents}, (select 0 as k union all select 1 union all select 2 union all select 3) as ks"
REGIONS = f"""
select doc_id, k % 2 as page, k as ord, case when k % 3 = 0 then 'tab' else 'fig' end as kind, cast(floor(k / 2) as bigint) + 1 as num,
  cast((doc_id * 7 + k * 40) % 300 as double) as x0, cast((doc_id * 11 + k * 60) % 500 as double) as y0,
  cast((doc_id * 7 + k * 40) % 300 + 80 + 30 * (k % 2) as double) as x1, cast((doc_id * 11 + k * 60) % 500 + 100 as double) as y1
from ({_n}) as r
"""
BOXES = f"""
select doc_id, k % 2 as page, k as box, cast((doc_id * 5 + k * 37) % 300 as double) as x0, cast((doc_id * 11 + k * 53) % 500 as double) as y0,
  cast((doc_id * 5 + k * 37) % 300 + 60 as double) as x1, cast((doc_id * 11 + k * 53) % 500 + 70 as double) as y1
from ({_n}) as r
"""
SCORES = f"""
select doc_id, box, ord, cast((doc_id * 13 + box * 7 + ord * 29) % 17 as double) / 16 as score, cast((doc_id * 5 + box * 3 + ord * 11) % 23 as double) / 10000 as sqdiff
from (select a.doc_id, a.k as box, b.k as ord from ({_n}) as a join ({_n}) as b on a.doc_id = b.doc_id) as p
"""
CAPTIONS = f"""
select doc_id, k % 2 as page, k as num, case when (doc_id + k) % 3 = 0 then 'R' else 'L' end as col, cast((doc_id * 3 + k * 101) % 600 as double) as y0, cast((doc_id * 3 + k * 101) % 600 + 12 as double) as y1
from ({_n}) as r
"""
METRICS = """
select doc_id, doc_id % 41 = 0 as dup, doc_id % 43 = 0 as mismatch, doc_id % 47 = 0 as unmatched, doc_id % 37 <> 0 as decoded, doc_id % 53 <> 0 as ok,
  case when doc_id % 53 = 0 then null else cast(doc_id % 21 as double) / 20 end as iou, case when doc_id % 53 = 0 then null else cast(doc_id % 33 as double) / 200 end as missing,
  case when doc_id % 53 = 0 then null else cast(doc_id % 25 as double) / 150 end as extra,
  case when doc_id % 7 = 0 then null else cast(doc_id % 11 as double) / 10 end as cc, case when doc_id % 5 = 0 then 'halftone' when doc_id % 17 = 0 then 'unknown' else 'lineart' end as img_type,
  case when doc_id % 59 = 0 then null else cast(doc_id % 19 as double) * 0.0102 end as sqdiff, case when doc_id % 3 = 0 then null else cast(doc_id % 9 as double) / 200 end as declared_sqdiff,
  cast(doc_id % 4 as bigint) as blobs, cast(doc_id % 90 as bigint) as vanished_area, cast(doc_id % 3 as bigint) as stretchy_page, cast(doc_id % 2 as bigint) as stretchy_crop, cast(doc_id % 20 as double) / 20 as page_share, doc_id % 29 = 0 as label_conflict,
  case when doc_id % 6 = 0 then null when doc_id % 2 = 0 then 'fig' else 'eq' end as declared_kind, cast(doc_id % 4 as bigint) as declared_num, case when doc_id % 8 = 0 then null when doc_id % 3 = 0 then 'fig' else 'eq' end as hit_kind, case when doc_id % 10 = 0 then null else cast(doc_id % 3 as bigint) end as hit_num, doc_id % 12 = 1 as ambiguous,
  cast(doc_id % 8 as double) / 2 as med, cast(100 * (doc_id % 5) + 100 as bigint) as ink, cast(doc_id % 9 as double) / 100 as unexplained, cast(doc_id % 4 as double) / 200 as vanished, 1 + cast(doc_id % 12 as double) / 10 as ratio
from {documents}
"""


#: Two small grey rasters an item, by arithmetic on ids and places: strokes or mid-grey; the second lacks a part or has a block more.
_digit = "(select 0 as d union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9)"
PIXELS = f"""
select doc_id, x, y, a, case when doc_id % 3 = 0 and x > 30 then 250 when doc_id % 5 = 1 and x < 12 and y < 12 then 10 else a end as b
from (select doc_id, x, y, cast(case when doc_id % 4 = 0 then 40 + (x * 7 + y * 11 + doc_id * 3) % 200 when (cast(floor(x / 3.0) as int) + doc_id) % 5 = 0 and y % 12 < 10 then 20 else 250 end as int) as a
  from (select item_id as doc_id, cast(k % 40 as int) as x, cast(floor(k / 40.0) as int) as y from {{benchmark}}, (select a.d + 10 * b.d + 100 * c.d as k from {_digit} as a, {_digit} as b, {_digit} as c) as ks where k < 960) as places) as pixels
""".replace("{{", "{").replace("}}", "}")

BLOCKS = f"""
select doc_id, k % 2 as page, cast((doc_id * 5 + k * 97) % 600 as double) as x0, cast((doc_id * 7 + k * 131) % 700 as double) as y0, cast((doc_id * 5 + k * 97) % 600 + 90 as double) as x1, cast((doc_id * 7 + k * 131) % 700 + 24 as double) as y1,
  case when k = 0 then concat('Figure ', cast(doc_id % 9 as varchar(9)), '. A plot') when k = 1 then concat('Table ', cast(doc_id % 5 as varchar(9)), ' rows') when k = 2 and doc_id % 7 = 0 then concat('Fig. 4: long', repeat(concat(chr(10), 'more'), 7)) when k = 2 then concat('fig 3', chr(10), 'and a line') else 'plain text' end as text
from ({_n}) as r
"""
PDF_WORDS = f"""
select doc_id, k % 2 as page, cast((doc_id * 11 + k * 150) % 600 as double) as x0, cast(100 + k as double) as y0, cast((doc_id * 11 + k * 150) % 600 + 20 as double) as x1, cast(112 + k as double) as y1, cast(600 as double) as width,
  case when k = 0 then concat('(', cast(doc_id % 150 as varchar(9)), ')') when k = 1 then '(x)' when k = 2 then concat('(', cast(1000 + doc_id as varchar(20)), ')') else '(7)' end as text
from ({_n}) as r
"""
FILES = """
select doc_id, case when doc_id % 9 = 4 then 'bad-key' else concat('abcd', lpad(cast(doc_id % 10000 as varchar(9)), 4, '0')) end as key, concat('/out/paper', cast(doc_id as varchar(20)), '.html') as path from {documents}
"""
TARGETS = """
select concat('ABCD', lpad(cast(doc_id % 10000 as varchar(9)), 4, '0')) as key, concat('/lib/', cast(doc_id as varchar(20))) as dir, case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then 'old.HTML' when doc_id % 5 = 2 then 'notes.pdf' else 'a.html' end as name from {documents} where doc_id % 3 <> 1
"""
STATES = "select doc_id, case when doc_id % 3 = 0 then 'needs_review' when doc_id % 3 = 1 then 'text_reviewed' else 'draft' end as phase from {documents}"
QUOTES = (
    f"select doc_id, case when ord % 12 = 5 then 'gone' else id end as unit_id, case when ord % 5 = 0 then concat(substr(source, 1, 9), '~')"
    f" when ord % 7 = 0 then ' ' else substr(source, 2, 12) end as quote from ({UNITS}) as u"
)
HISTORY = (
    f"select doc_id, k as seq, case cast((doc_id + k * (1 + doc_id % 2)) % 7 as int) when 0 then 'new' when 1 then 'extracted' when 2 then 'translated' when 3 then 'reviewed'"
    f" when 4 then 'built' when 5 then 'checked' else 'failed' end as status from ({_n}) as r"
)
INPUTS = "select concat('/in/', cast(doc_id as varchar(20))) as path, concat('h', cast(doc_id % 50 as varchar(9))) as sha256 from {documents}"
INPUTS_NOW = "select concat('/in/', cast(doc_id as varchar(20))) as path, case when doc_id % 10 = 3 then 'changed' else concat('h', cast(doc_id % 50 as varchar(9))) end as sha256 from {documents} where doc_id % 17 <> 2"
STATS = "select page_id, page_id % 5 as overlaps, page_id % 3 as broken, case when page_id % 4 = 0 then null else page_id % 2 end as nonEmbedded, page_id % 7 as leftoverDollar from {pages}"
BAD_UNITS = (
    f"select doc_id, case when ord % 9 = 3 then 'bad id!' when ord % 9 = 4 then 'twice' else id end as id, case when ord % 11 = 2 then 'poem' else kind end as kind, page - case"
    f" when ord % 8 = 1 then 9 else 0 end as page, case when ord % 10 = 7 then ' ' else source end as source from ({UNITS}) as u"
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived view over the tables that it names in braces."""
    from pyspark.sql import functions as F

    sql = sql.replace("{arr}", "array")
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        if "{" + name + "}" in sql:
            view = f"plumbline_{name}_{abs(hash(sf_dir)) % 10**9}"
            _read(spark, sf_dir, name).createOrReplaceTempView(view)
            sql = sql.replace("{" + name + "}", view)
    if "{lines}" in sql:
        view = f"plumbline_lines_{abs(hash(sf_dir)) % 10**9}"
        docs = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
        docs.select("doc_id", (F.col("k") + 1).cast("long").alias("ord"), "line").createOrReplaceTempView(view)
        sql = sql.replace("({lines})", view)
    return spark.sql(sql)


def duck(sql: str) -> str:
    """The same text for the oracle."""
    sql = sql.replace("{arr}", "list_value").replace("{lines}", _DUCK_LINES)
    return re.sub(r"\{(documents|pages|benchmark|labels|conversations)\}", r"\1", sql)
