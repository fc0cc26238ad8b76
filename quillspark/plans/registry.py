"""All registered queries and the SQL that says the same.

Tables hold no papers, so inputs for many operators are built from columns, by one expression that both Spark and SQL read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import protect as P
from quillspark.functions import text as X
from quillspark.operators import glossary as G
from quillspark.operators import html_tables, paper, pricing, requests, tables, translate, units
from quillspark.operators.store import ResultStore
from quillspark.settings import Settings
from quillspark.shared import new_path, spread, written
from quillspark.sources import fetch, files
from quillspark.sources import html as H
from quillspark.sources import udtf
from quillspark.sources import write_back as W
from quillspark.streaming import glossary as SG

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as blocks: one paragraph a line, each seventh a heading."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("block_idx", "text"))
    return lines.withColumn("kind", F.when(F.col("block_idx") % 7 == 6, "heading").otherwise("paragraph"))


_BLOCKS = """
with lines as (select doc_id, lang, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as block_idx from documents),
blocks as (select *, case when block_idx % 7 = 6 then 'heading' else 'paragraph' end as kind from lines)
"""


@query(_BLOCKS + "select doc_id, block_idx, kind, cast(length(text) as bigint) as n from blocks")
def doc_paragraph_blocks(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "block_idx", "kind", F.length("text").cast("long").alias("n"))


@query(
    _BLOCKS.replace("with lines", "with recursive lines")
    + r""", b as (select doc_id, lang, block_idx, kind, length(regexp_replace(text, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g')) as n from blocks),
fold as (
  select doc_id, lang, block_idx, n, 0 as unit, case when kind = 'paragraph' and n < 1500 then kind end as open, n as total from b where block_idx = 0
  union all
  select b.doc_id, b.lang, b.block_idx, b.n,
    case when b.kind = f.open and f.total + b.n <= 1500 then f.unit else f.unit + 1 end,
    case when b.kind <> 'paragraph' then null
         when f.open is null then case when b.n < 1500 then b.kind end
         when f.total + b.n > 1500 then null
         when f.total + b.n >= 1500 or (f.total + b.n >= 1000 and f.total + b.n + b.n >= 1500) then null else b.kind end,
    case when b.kind = f.open and f.total + b.n <= 1500 then f.total + b.n else b.n end
  from fold f join b on b.doc_id = f.doc_id and b.block_idx = f.block_idx + 1
), u as (select doc_id, lang, unit, count(*) as size, sum(n) as chars from fold group by all)
select lang, count(*) as units, cast(sum(case when size > 1 then 1 else 0 end) as bigint) as merged, cast(sum(size) as bigint) as blocks, cast(sum(chars) as bigint) as chars from u group by lang"""
)
def unit_packing_stats(spark, sf_dir):
    blocks = paragraphs(spark, sf_dir)
    packed = units.pack_units(blocks)
    per = packed.groupBy("doc_id", "lang", "unit_id").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length(X.strip(F.col("text")))).alias("chars"))
    return per.groupBy("lang").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("size") > 1).alias("merged"), F.sum("size").alias("blocks"), F.sum("chars").alias("chars"))


_PAPER = "concat('https://arxiv.org/abs/', lpad(cast(p_partkey % 9999 as string), 4, '0'), '.', lpad(cast(p_size as string), 5, '0'), case when p_partkey % 3 = 0 then concat('v', cast(p_size % 5 + 1 as string)) else '' end)"


@query(f"select p_partkey, regexp_extract({_PAPER}, '(\\d{{4}}\\.\\d{{4,5}}(v\\d+)?)', 1) as paper, regexp_replace(regexp_extract({_PAPER}, '(\\d{{4}}\\.\\d{{4,5}}(v\\d+)?)', 1), 'v\\d+$', '') as base from part")
def arxiv_id_extract(spark, sf_dir):
    paper = X.require_arxiv_id(F.expr(_PAPER))
    return table(spark, sf_dir, "part").select("p_partkey", paper.alias("paper"), X.without_version(paper).alias("base"))


@query("select o_custkey % 50 as paper, 'v' || max(o_orderkey % 12 + 1) as version from orders group by 1")
def latest_version(spark, sf_dir):
    v = (F.col("o_orderkey") % 12 + 1).alias("v")
    links = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("paper"), v)
    return links.groupBy("paper").agg(F.max_by(F.concat(F.lit("v"), F.col("v").cast("string")), "v").alias("version"))


@query("select doc_id, 'https://www.bing.com/search?q=' || replace(lang || ' source ' || source, ' ', '%20') as url from documents")
def search_url(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.search_url(F.concat_ws(" ", "lang", F.lit("source"), "source")).alias("url"))


@query("""select doc_id, length(tex) <= 25 and not regexp_matches(tex, '\\\\(begin|aligned|sum|int|frac|prod|lim|displaystyle|choose|binom|cases|matrix)') as inline
from (select doc_id, case doc_id % 3 when 0 then '\\frac{a}{' || n_chars || '}' when 1 then 'x_' || n_chars else repeat('y+', cast(n_chars % 20 as int)) || 'z' end as tex from documents)""")
def inline_math_predicate(spark, sf_dir):
    tex = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\\frac{a}{"), F.col("n_chars").cast("string"), F.lit("}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x_"), F.col("n_chars").cast("string"))).otherwise(F.concat(F.expr("repeat('y+', cast(n_chars % 20 as int))"), F.lit("z")))
    return table(spark, sf_dir, "documents").select("doc_id", X.is_inline_math(tex).alias("inline"))


_MIXED = "concat('使用A', lang, '方法', doc_id, '在', source, '上 ok')"


@query(f"select doc_id, regexp_replace({_MIXED}, '([一-鿿])([A-Za-z0-9])|([A-Za-z0-9])([一-鿿])', '\\1\\3 \\2\\4', 'g') as spaced, regexp_matches({_MIXED}, '[一-鿿]') as cjk from documents")
def cjk_spacing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.space_cjk(F.expr(_MIXED)).alias("spaced"), X.has_cjk(F.expr(_MIXED)).alias("cjk"))


@query("""select doc_id, case when n = '' then 'paper' else n end as name from (
  select doc_id, case when length(s) > 120 then regexp_replace(regexp_replace(substr(s, 1, 120), '[\\s\\p{Z}]+$', ''), '\\.+$', '') else s end as n from (
    select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\p{C}', '', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '^\\.+|\\.+$', '', 'g'), '[\\s\\p{Z}]{2,}', ' ', 'g') as s
    from (select doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, chr(92), '＼'), '/', '、'), ':', '：'), '*', '＊'), '?', '？'), '"', '”'), '<', '＜'), '>', '＞'), '|', '｜'), chr(10), ''), chr(13), ''), chr(9), '') as t from documents)))""")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.safe_filename(F.col("text")).alias("name"))


_CELL = "case p_partkey % 8 when 0 then p_type when 1 then cast(p_size as string) when 2 then 'ASR' when 3 then '$x_1$' when 4 then concat(p_brand, '-v2') when 5 then '<b>Qwen</b>' when 6 then '方法' else concat('**', p_type, ' rate**') end"


@query("select p_partkey, p_partkey % 8 in (4, 7) or (p_partkey % 8 = 0 and not (not contains(p_type, ' ')) and not regexp_matches(p_type, '^[A-Z]{1,5}( [A-Z]{1,5})*$')) as translatable from part")
def cell_translatable(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.is_cell_translatable(F.expr(_CELL)).alias("translatable"))


_BARE = r"regexp_replace({}, '^[\s\x0b\p{{Z}}\x1c-\x1f\x85]+|[\s\x0b\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')"
_SAME = r"trim(regexp_replace(regexp_replace(lower({}), '^[\s\-.]+|[\s\-.]+$', '', 'g'), '[\s\-.]+', ' ', 'g'))"


@query(_BLOCKS + f""", t as (select doc_id, block_idx, {_BARE.format("text")} as t, lang as o from blocks)
select doc_id, block_idx, t <> '' and {_SAME.format("t")} <> {_SAME.format("o")} and length(t) <= 80
  and len(regexp_extract_all(regexp_replace(t, '[0-9]\\.[0-9][0-9.]*', '', 'g'), '[。.!?！？；;…]')) <= 2 as heading from t""")
def heading_plausible(spark, sf_dir):
    """Every line of every text as the translation of a short heading."""
    return paragraphs(spark, sf_dir).select("doc_id", "block_idx", X.is_plausible_heading(F.col("text"), F.col("lang")).alias("heading"))




@query("""with p as (select doc_id, string_split(replace(text, '. ', chr(7)), chr(7)) as parts from documents)
select doc_id, unnest(list_transform(parts, lambda x: regexp_replace(x, '^\\n+|\\n+$', '', 'g'))) as part, cast(unnest(range(len(parts))) as int) as pos from p""")
def newpar_split(spark, sf_dir):
    """Every text, its sentences taken for paragraphs."""
    text = F.regexp_replace("text", r"\. ", "\n⟦NEWPAR⟧\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.paragraph_parts(text)).alias("pos", "part"))




@query("select doc_id, 'AB' || doc_id as en, 'Alpha Beta ' || lang as en_full from documents union all select doc_id, 'CD' || doc_id, 'Cee Dee ' || source from documents")
def abbrev_defs(spark, sf_dir):
    text = F.expr("concat('We use AB', doc_id, ' = Alpha Beta ', lang, ', and CD', doc_id, ' (Cee Dee ', source, '); XY: X.')")
    return G.abbreviations(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", "en", "en_full")


_TERMS = "event_id as ord, user_id % 50 as doc_id, event_type as en, case when event_id % 11 = 0 then '<KEEP>' when event_id % 7 = 0 then '' else concat('译', event_id % 13) end as zh, case when event_id % 5 = 0 then concat('full', event_id % 17) else '' end as en_full, case when event_id % 9 = 0 then concat('note', event_id % 3) end as note"


@query(f"""with e as (select {_TERMS} from events), k as (select * from e where zh <> '')
select doc_id, en as en_key, min(ord) as ord, case when arg_min(zh, ord) = '<KEEP>' then '<KEEP>' else arg_max(zh, ord) filter (where zh <> '<KEEP>') end as zh,
  arg_min(en_full, ord) filter (where en_full <> '') as en_full, arg_min(note, ord) filter (where note is not null) as note from k group by 1, 2""")
def glossary_ingest_last_wins(spark, sf_dir):
    return G.ingest_terms(table(spark, sf_dir, "events").selectExpr(*_split(_TERMS))).drop("seen")


@query(f"""with e as (select {_TERMS} from events), l as (select *, min(case when zh = '<KEEP>' then ord end) over (partition by doc_id, en) as lock from e)
select doc_id, en as en_key, min(ord) as ord, case when max(case when zh = '<KEEP>' then 1 else 0 end) = 1 then '<KEEP>' else arg_min(zh, ord) filter (where zh <> '') end as zh,
  arg_min(en_full, ord) filter (where en_full <> '' and (lock is null or ord <= lock)) as en_full, arg_min(note, ord) filter (where note is not null and (lock is null or ord <= lock)) as note from l group by 1, 2""")
def glossary_finalize_keep_wins(spark, sf_dir):
    return G.finalize_terms(table(spark, sf_dir, "events").selectExpr(*_split(_TERMS)))


def _split(columns: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


_SAID = "case doc_id % 3 when 0 then text when 1 then replace(text, ' of ', ' 的 ') else replace(text, 'the', '那') end"
_WORD = r"regexp_matches({}, '(^|[^\p{{L}}\p{{N}}_]){}([^\p{{L}}\p{{N}}_]|$)', 'i')"


@query(f"""with d as (select doc_id, text, {_SAID} as said from documents)
select doc_id, 0 as block_idx, 'term' as rule from d
where {_BARE.format("said")} <> '' and ({_WORD.format("said", "the")} and not contains(said, '那') or {_WORD.format("text", "of")} and not {_WORD.format("said", "of")})""")
def needs_repair(spark, sf_dir):
    """Every text with a translation made from it: one term is used or not, another is to stay in English."""
    docs = table(spark, sf_dir, "documents")
    said = docs.select("doc_id", F.lit(0).alias("block_idx"), "text", F.expr(_SAID).alias("translation"))
    terms = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("the").alias("en_key"), F.lit("那").alias("zh")), F.struct(F.lit("of").alias("en_key"), F.lit(G.KEEP).alias("zh")))).alias("t")).select("doc_id", "t.*")
    return G.needs_repair(said, terms.distinct())


_ZH_BY_LENGTH = "case length(en_key) % 3 when 0 then '<KEEP>' when 1 then '那' else '的' end"
_RESAID = "case doc_id % 5 when 0 then text when 1 then replace(text, 'the', '那') when 2 then concat(text, case block_idx % 4 when 0 then ' 锐利边界' when 1 then ' @@MATH' when 2 then ' 副产物' else ' 的' end) when 3 then replace(text, 'e', 'E') else concat('那的', text) end"


@query(_BLOCKS + f""", said as (select doc_id, block_idx, text, {_RESAID} as said from blocks),
src as (select distinct doc_id, block_idx, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as w from said where {_BARE.format("said")} <> ''),
tgt as (select distinct doc_id, block_idx, said, unnest(regexp_extract_all(lower(said), '[\\p{{L}}\\p{{N}}_]+')) as w from said where {_BARE.format("said")} <> ''),
g as (select doc_id, en_key, {_ZH_BY_LENGTH} as zh from (select distinct doc_id, w as en_key from src where length(w) >= 7)),
found as (
  select doc_id, block_idx, 'term' as rule from src join g using (doc_id) where w = en_key and zh = '<KEEP>' and not exists (select 1 from tgt t where t.doc_id = src.doc_id and t.block_idx = src.block_idx and t.w = src.w)
  union all select doc_id, block_idx, 'term' from tgt join g using (doc_id) where w = en_key and zh <> '<KEEP>' and not contains(said, zh)
  union all select doc_id, block_idx, case when contains(said, '@@MATH') then 'residue' when contains(said, '锐利边界') then 'awkward' else 'variant' end from said where contains(said, '@@MATH') or contains(said, '锐利边界') or contains(said, '副产物')
) select doc_id, block_idx, min(rule) as rule from found group by 1, 2""")
def needs_repair_by_glossary(spark, sf_dir):
    """Every line of every text against a glossary of all longer words of its document; all rules fire."""
    said = paragraphs(spark, sf_dir).select("doc_id", "block_idx", "text", F.expr(_RESAID).alias("translation"))
    # a line with such a word is never blank in translation, and no word goes beyond a line
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= 7)).alias("words")
    entries = F.expr(f"transform(words, en_key -> named_struct('en_key', en_key, 'zh', {_ZH_BY_LENGTH}))").alias("entries")
    terms = table(spark, sf_dir, "documents").select("doc_id", words).select("doc_id", entries)
    return G.needs_repair(said, terms)




@query("select doc_id, case doc_id % 4 when 0 then '引言' when 1 then '相关工作' when 2 then '结论' end as title from documents")
def section_title_join(spark, sf_dir):
    name = F.expr("case doc_id % 4 when 0 then ' Introduction' when 1 then 'Related Work ' when 2 then 'CONCLUSIONS' else '1 Introduction' end")
    return table(spark, sf_dir, "documents").select("doc_id", X.section_title(name).alias("title"))


@query("select conv_id as doc_id, cast(turn // 2 as bigint) as unit_id from conversations group by 1, 2 having not bool_and(length(text) % 3 <> 0)")
def pending_units_anti(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), F.expr("turn div 2").alias("unit_id"), "text")
    return units.pending_units(turns.drop("text"), turns.where(F.length("text") % 3 != 0))


_USAGE = "case event_type when 'click' then 'DeepSeek-V4-Flash-0731' when 'view' then 'deepseek-v4-pro' when 'purchase' then 'unknown-model' else 'deepseek-v4' end"
_PRICES = [(0, "deepseek-v4-flash", 0.02, 1.0, 2.0), (1, "deepseek-v4-pro", 0.1, 3.0, 6.0)]


def _priced(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    usage = table(spark, sf_dir, "events").select(F.expr(_USAGE).alias("model"), F.expr("100 + event_id % 900").alias("prompt"), F.expr("event_id % 300").alias("completion"), F.expr("event_id % 90").alias("cache_hit"), F.lit(1).cast("long").alias("requests"))
    prices = spark.createDataFrame(_PRICES, "ord int, model string, cache_hit_price double, cache_miss_price double, output_price double")
    return pricing.usage_totals(usage, "model"), prices


@query(f"""with u as (select {_USAGE} as model, sum(100 + event_id % 900) as prompt, sum(event_id % 300) as completion, sum(event_id % 90) as cache_hit, count(*) as requests from events group by 1)
select model, cast(prompt as bigint) as prompt, cast(completion as bigint) as completion, cast(cache_hit as bigint) as cache_hit, requests,
 round(case when model = 'unknown-model' then null when model = 'deepseek-v4-pro' then cache_hit / 1e6 * 0.1 + (prompt - cache_hit) / 1e6 * 3.0 + completion / 1e6 * 6.0
 else cache_hit / 1e6 * 0.02 + (prompt - cache_hit) / 1e6 * 1.0 + completion / 1e6 * 2.0 end, 6) as cost from u""")
def token_usage_cost(spark, sf_dir):
    totals, prices = _priced(spark, sf_dir)
    return pricing.estimate_cost(totals, prices).select("model", "prompt", "completion", "cache_hit", "requests", F.round("cost", 6).alias("cost"))


@query(f"select distinct model, case model when 'deepseek-v4-pro' then 'deepseek-v4-pro' else 'deepseek-v4-flash' end as priced from (select {_USAGE} as model from events) where model <> 'unknown-model'")
def price_lookup_prefix(spark, sf_dir):
    totals, prices = _priced(spark, sf_dir)
    return pricing.price_lookup(totals, prices).select("model", "priced")


@query(f"""with u as (select {_USAGE} as model, sum(100 + event_id % 900) as p, sum(event_id % 300) as c, sum(event_id % 90) as h from events group by 1)
select model, round(100.0 * h / p, 2) as hit_pct, round(100.0 * (p - h) / p, 2) as miss_pct, round(100.0 * c / (p + c), 2) as output_pct from u""")
def token_usage_report(spark, sf_dir):
    return pricing.usage_report(_priced(spark, sf_dir)[0]).select("model", *(F.col(c).cast("double").alias(c) for c in ("hit_pct", "miss_pct", "output_pct")))


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), F.when(F.col("role") == "user", "paragraph").otherwise("heading").alias("kind"), F.when(F.col("turn") == 0, "abstract").alias("section"), "text")


@query("select doc_id, block_idx, seed from (select conv_id as doc_id, turn as block_idx, cast(row_number() over (partition by conv_id order by turn) as int) as seed from conversations where role = 'user' and trim(text) <> '') where seed <= 4")
def seed_text_limit4(spark, sf_dir):
    return units.seed_texts(_turns(spark, sf_dir)).select("doc_id", "block_idx", "seed")


@query("""with p as (select conv_id, turn, text, turn = 0 as abs, row_number() over (partition by conv_id, turn = 0 order by turn) as n from conversations where role = 'user')
select conv_id as doc_id, coalesce(nullif(string_agg(text, chr(10) order by turn) filter (where abs), ''), string_agg(text, chr(10) order by turn) filter (where not abs and n <= 3)) as summary from p where abs or n <= 3 group by 1""")
def abstract_fallback3(spark, sf_dir):
    return units.abstract_or_first(_turns(spark, sf_dir))


@query("select l_orderkey, l_linenumber, last_value(case when l_linenumber % 3 = 1 then l_returnflag end ignore nulls) over (partition by l_orderkey order by l_linenumber) as filled from (select l_orderkey, l_linenumber, max(l_returnflag) as l_returnflag from lineitem group by 1, 2)")
def grid_fill_down(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    cells = cells.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag")).otherwise("").alias("text"))
    return tables.fill_down(cells, "text", "l_linenumber", "l_orderkey").select("l_orderkey", "l_linenumber", "filled")


@query("select l_orderkey, l_linenumber as r, min(case when l_quantity < 40 then 1 else 0 end) over (partition by l_orderkey order by l_linenumber) = 1 as is_header from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by 1, 2)")
def header_prefix_run(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("r")).agg(F.max("l_quantity").alias("l_quantity"))
    return tables.header_run(rows, F.col("l_quantity") < 40, "l_orderkey").select("l_orderkey", "r", "is_header")


@query("""with c as (select l_orderkey as table_id, l_linenumber - 1 as c, case when l_linenumber <= l_quantity % 6 then l_linestatus else '' end as text from lineitem)
select table_id, c, text from (select *, greatest(coalesce(max(case when text <> '' then c end) over (partition by table_id), -1), 1) as last from c) where c <= last""")
def trim_tail_cols(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as table_id", "l_linenumber - 1 as c", "case when l_linenumber <= l_quantity % 6 then l_linestatus else '' end as text")
    return tables.trim_empty_columns(cells).select("table_id", "c", "text")


@query("select conv_id as doc_id, string_agg(text, chr(10) order by turn) as markdown from conversations group by 1")
def markdown_assemble(spark, sf_dir):
    return units.assemble(_turns(spark, sf_dir), "text")


@query("""select user_id % 20 as doc_id, string_agg('- ' || event_type || ' → 【译' || n || '】', chr(10) order by n) as prompt from (select user_id % 20 as user_id, event_type, min(event_id) as n from events group by 1, 2) group by 1""")
def glossary_prompt(spark, sf_dir):
    terms = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("doc_id"), F.col("event_type").alias("en_key")).agg(F.min("event_id").alias("ord"))
    return G.prompt_lines(terms.select("doc_id", "ord", "en_key", F.concat(F.lit("译"), F.col("ord").cast("string")).alias("zh"), F.lit(None).cast("string").alias("en_full"), F.lit(None).cast("string").alias("note")))


@query("select p_partkey, least(power(2.0, p_size % 9), 30.0) as delay, not (400 + p_size between 400 and 499) or 400 + p_size = 429 as again from part")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.retry_delay(F.col("p_size") % 9).alias("delay"), X.may_retry(F.col("p_size") + 400).alias("again"))


_FORMULAS = "replace(replace(text, '$', ''), ', ', ' $x_1$ [3], ')"


@query(f"select doc_id, {_FORMULAS} as text, cast(length(replace(text, '$', '')) - length(replace(replace(text, '$', ''), ', ', '')) as int) as n from documents where text is not null")
def protect_restore_roundtrip(spark, sf_dir):
    """Every text, without its dollars, with a formula and a reference before each comma: how many are protected, and the text restored."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", P.protect(F.expr(_FORMULAS)).alias("p"))
    return docs.select("doc_id", P.restore("p.text", "p.entries").alias("text"), F.size("p.entries").alias("n"))




@query("select doc_id, 'A ⟦MATH_0⟧ b ⟦REF_X1⟧ ⟦REF_X2⟧' as text, cast(3 as bigint) as n from documents")
def protect_counts(spark, sf_dir):
    text = F.expr("concat('A $x_', doc_id, '$ b [1, ', doc_id, '] [t](http://e/', doc_id, ')')")
    return table(spark, sf_dir, "documents").select("doc_id", P.protect(text).alias("p")).select("doc_id", "p.text", F.size("p.entries").cast("long").alias("n"))


@query("select page_id, cast(len(regexp_extract_all(html, '<a href=')) as bigint) as links from pages")
def page_links(spark, sf_dir):
    return H.links(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")).groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("links"))


@query()
def page_blocks(spark, sf_dir):
    return H.parse_blocks(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "html")).select("doc_id", "block_idx", "kind", "level", "text", "raw")


def _conversation_units(spark, sf_dir) -> DataFrame:
    return _turns(spark, sf_dir).select("doc_id", F.expr("block_idx div 2").alias("unit_id"), "block_idx", "text")


class Marked(translate.IdentityBackend):
    """Answers with each e as a 3; deterministic, and few answers are what was asked."""

    def translate(self, texts, glossary, cell=False):
        return super().translate([t.replace("e", "3") for t in texts], glossary, cell)


@query("""select cast(conv_id as varchar) as doc_id, cast(turn as int) as block_idx, replace(text, 'e', '3') as translation from conversations where trim(text) <> ''""")
def translate_units(spark, sf_dir):
    return translate.translate_units(_conversation_units(spark, sf_dir), None, Marked).select("doc_id", "block_idx", "translation")


@query("""select cast(p_partkey as varchar) as doc_id, 0 as block_idx,
  '| M3thod nam3 | Score |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace('the ' || p_type || ' rate', 'e', '3') || ' | ' || p_size || ' |' as table_zh from part""")
def translate_tables(spark, sf_dir):
    """A table of each part: cells that hold English are translated, others stay."""
    made = F.expr("concat('| Method name | Score |\\n| --- | --- |\\n| the ', p_type, ' rate | ', p_size, ' |')")
    tables_ = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), made.alias("table_md"))
    return translate.translate_tables(tables_, Marked).select("doc_id", "block_idx", "table_zh")


@query("""select cast(p_partkey as varchar) as doc_id, 0 as block_idx, '<table class="a"><tr><th>M3thod &amp; nam3</th><td>th3 ' || replace(p_type, 'e', '3') || ' rat3</td><td><b>' || p_size || '</b></td></tr></table>' as table_zh from part""")
def translate_html_tables(spark, sf_dir):
    """An HTML table of each part: cells that hold English lose their inner markup, others stay."""
    made = F.expr("concat('<table class=\"a\"><tr><th>Method &amp; name</th><td><b>the</b> ', p_type, ' <i>rate</i></td><td><b>', p_size, '</b></td></tr></table>')")
    tables_ = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), made.alias("table_md"))
    return html_tables.translate_all_tables(tables_, Marked).select("doc_id", "block_idx", "table_zh")


class Summarises(translate.IdentityBackend):
    """Answers for titles of an even number of characters, and fails for the others."""

    def summarise(self, title, abstract):
        if len(title) % 2:
            raise ValueError(title)
        return json.dumps({"summary": f" S: {title} "}, ensure_ascii=False)


_STRIPPED = r"regexp_replace({}, '^[\s\p{{Z}}\x1c-\x1f\x85]+|[\s\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')"


@query(f"""with t as (select conv_id, turn, text, row_number() over (partition by conv_id, turn = 0 order by turn) as n from conversations where text <> ''),
p as (select conv_id, {_STRIPPED.format("coalesce(max(text) filter (where turn = 0), '')")} as title,
  {_STRIPPED.format("coalesce(string_agg(text, chr(10) order by turn) filter (where turn > 0 and n <= 3), '')")} as abstract from t group by 1)
select conv_id as doc_id, case when length(title) % 2 = 0 and (title <> '' or abstract <> '') then trim('S: ' || title)
  when title <> '' and abstract <> '' then '本文标题：《' || title || '》。摘要要点：' || case when length(abstract) > 600 then substr(abstract, 1, 600) || '…' else abstract end || '。请据此判断本文的核心任务/方法/立场（如提出新方法、理论分析或实证研究），并始终与摘要立场保持一致。'
  when title <> '' then '本文标题：《' || title || '》。翻译时保持全文立场与标题一致。' else '翻译时保持全文立场一致，不得引入与上下文相悖的幻觉内容。' end as summary from p""")
def paper_summaries(spark, sf_dir):
    """Conversations as papers: the first turn is the title, the others are paragraphs."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), F.when(F.col("turn") == 0, "title").otherwise("paragraph").alias("kind"), F.lit(None).cast("string").alias("section"), "text")
    return paper.summaries(turns, Summarises)


class Teaches(translate.IdentityBackend):
    """Says how many terms it was told, and teaches the first word of what it gets."""

    def translate(self, texts, glossary, cell=False):
        return [json.dumps({"translation": f"{len(glossary)}: {t}", "terms": [{"en": t.split()[0], "zh": f"词{len(glossary)}"}]}, ensure_ascii=False) for t in texts]


_CAPTIONS = "select cast(s_suppkey as varchar) as doc_id, i as block_idx, case i when 0 then 'SNR = noise of ' || s_name when 1 then 'plain text' when 2 then 'see LLM: large model' else 'SNR again' end as text"


def _prewarmed(spark, sf_dir) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), "s_name", F.explode(F.array(*map(F.lit, range(4)))).alias("block_idx"))
    said = F.expr("case block_idx when 0 then concat('SNR = noise of ', s_name) when 1 then 'plain text' when 2 then 'see LLM: large model' else 'SNR again' end")
    figure = F.col("block_idx") % 3 == 0
    blocks = suppliers.select("doc_id", "block_idx", F.when(figure, "figure").otherwise("paragraph").alias("kind"), F.when(~figure, said).alias("text"), F.when(figure, said).alias("caption"))
    terms = suppliers.where("block_idx = 0 and cast(doc_id as int) % 2 = 0").select("doc_id", F.lit("probe").alias("en_key"), F.lit("探针").alias("zh"))
    return paper.prewarm(blocks, terms, Teaches)


@query(f"""with c as ({_CAPTIONS}, s_suppkey % 2 = 0 as told from supplier, (values (0), (2), (3)) as t(i))
select doc_id, block_idx, (case when block_idx = 3 then 2 when block_idx = 2 then 1 else 0 end + told::int) || ': ' || text as translation from c""")
def prewarm(spark, sf_dir):
    """Four blocks a supplier, of which three define abbreviations: each is told what those before have taught."""
    return _prewarmed(spark, sf_dir).select("doc_id", "block_idx", "translation")


@query("""select cast(s_suppkey as varchar) as doc_id, k as en_key, '词' || (d + case when s_suppkey % 2 = 0 then 1 else 0 end) as zh from supplier, (values ('snr', 2), ('see', 1)) as t(k, d)""")
def learned_terms(spark, sf_dir):
    return paper.learned_terms(_prewarmed(spark, sf_dir)).select("doc_id", "en_key", "zh")


@query("select cast(p_partkey as varchar) as doc_id, cast(p_partkey % 2 as bigint) as html_tables, cast(1 - p_partkey % 2 as bigint) as markdown_tables, cast(case when p_partkey % 2 = 0 then 1 else 0 end as bigint) as cells from part")
def table_counts(spark, sf_dir):
    made = F.expr("case p_partkey % 2 when 1 then '<table><tr></tr></table>' else concat('| the ', p_type, ' rate | ', p_size, ' |') end")
    return translate.table_counts(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("block_idx"), made.alias("table_md")))


@query("select p_partkey, 'ℒ' || p_size || ' <= ' || p_brand || ' ∞' as shown from part")
def tex_as_unicode(spark, sf_dir):
    tex = F.expr(r"concat('\\mathcal{L}_{', p_size, '} \\leq ', p_brand, ' \\infty')")
    return table(spark, sf_dir, "part").select("p_partkey", X.tex_to_unicode(tex).alias("shown"))


@query("select p_partkey as table_id, cast(r as int) as r, p_size % 3 as c from part, unnest(range(1, 1 + p_size % 4)) as t(r)")
def occupied_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "part").selectExpr("p_partkey as table_id", "0 as r", "p_size % 3 as c", "1 + p_size % 4 as rowspan")
    return tables.occupied(cells)


@query("select p_size as table_id, cast(c as int) as c, case when c = 1 then 1.2 else 3.0 end as weight, case when c = 1 then round(1.2 / 4.2, 9) else round(3.0 / 4.2, 9) end as share from (select distinct p_size from part), unnest([0, 1]) as t(c)")
def column_widths(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select(F.col("p_size").alias("table_id"), F.posexplode(F.array("p_type", F.concat(F.lit("$x_{"), "p_partkey", F.lit("}$")))).alias("c", "text"))
    return tables.column_weights(cells).select("table_id", "c", "weight", F.round("share", 9).alias("share"))


@query("""select doc_id, 'You translate scientific papers from English into Chinese.' || chr(10) || chr(10) || '1. Leave every placeholder in ⟦ ⟧ as it is.' || chr(10) || chr(10)
 || '2. Translate all of the text and nothing else.' || chr(10) || chr(10) || '3. Keep names of models, data sets and people in English.' || chr(10) || chr(10) || '' || chr(10) || chr(10)
 || case when source <> '' then '4. What the paper is about: ' || source || chr(10) || chr(10) else '' end || case when doc_id % 2 = 0 then case when source <> '' then '5' else '4' end || '. Terms:' || chr(10) || lang || chr(10) || chr(10) else '' end
 || 'Answer with JSON: {"translation": "...", "terms": [{"en": "...", "zh": "..."}]}' as prompt from documents""")
def system_prompts(spark, sf_dir):
    made = translate.system_prompt(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("prompt"))


@query("""select conv_id as doc_id, turn as ord, text as en, case when turn % 3 = 0 then '译' || turn end as zh from conversations""")
def known_terms(spark, sf_dir):
    """Every text looked up, as a term, in a glossary of each third."""
    said = table(spark, sf_dir, "conversations").selectExpr("conv_id as doc_id", "turn as ord", "concat(turn, text) as en", "text")
    glossary = said.where("ord % 3 = 0").select("doc_id", X.term_key(F.col("en")).alias("en_key"), F.concat(F.lit("译"), "ord").alias("zh"))
    return G.known_terms(said, glossary).select("doc_id", "ord", F.col("text").alias("en"), "zh")


_PAPER_HTML = "concat('<article><h1 class=\"ltx_title_document\">Part ', p_partkey, '</h1><section class=\"ltx_section\"><h2 class=\"ltx_title_section\">', p_type, '</h2><div class=\"ltx_para\"><p class=\"ltx_p\">Of <b>', p_brand, '</b>.</p><table class=\"ltx_equation\"><tr><td><math><annotation encoding=\"application/x-tex\">x_{', p_size, '}</annotation></math></td></tr></table></div><figure class=\"ltx_figure\"><img src=\"/img/', p_partkey, '.png\"></figure></section></article><ul><li class=\"ltx_bibitem\" id=\"bib.b', p_partkey, '\"><span class=\"ltx_bibblock\">A. 2020</span><span class=\"ltx_bibblock\">On ', p_brand, '.</span></li></ul>')"


def _papers(spark, sf_dir) -> DataFrame:
    """A paper of each part, with what pages of the tables lack."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.expr(_PAPER_HTML).alias("html"))


@query("""select cast(p_partkey as varchar) as doc_id, cast(i as int) as block_idx, kind, text, raw, html_id from part, unnest([
  {'i': 0, 'kind': 'title', 'text': 'Part ' || p_partkey, 'raw': 'Part ' || p_partkey, 'html_id': 'zh-1'}, {'i': 1, 'kind': 'heading', 'text': p_type, 'raw': p_type, 'html_id': 'zh-2'},
  {'i': 2, 'kind': 'paragraph', 'text': 'Of ' || p_brand || '.', 'raw': 'Of **' || p_brand || '**.', 'html_id': 'zh-3'},
  {'i': 3, 'kind': 'equation', 'text': 'x_{' || p_size || '}', 'raw': '$$' || chr(10) || 'x_{' || p_size || '}' || chr(10) || '$$' || chr(10), 'html_id': 'zh-4'},
  {'i': 4, 'kind': 'figure', 'text': '', 'raw': '![](https://arxiv.org/img/' || p_partkey || '.png)', 'html_id': 'zh-5'}]) as t(x), lateral (select x.*)""")
def paper_blocks(spark, sf_dir):
    return H.parse_blocks(_papers(spark, sf_dir)).select("doc_id", "block_idx", "kind", "text", "raw", "html_id")




@query("select conv_id as doc_id, turn as block_idx from conversations where length(text) % 3 = 0")
def resume_blocks(spark, sf_dir):
    blocks = _turns(spark, sf_dir).select("doc_id", "block_idx", "text")
    stored = blocks.where(F.length("text") % 3 != 0).withColumn("version", F.lit(1))
    return translate.resume(blocks, stored, 1).select("doc_id", "block_idx")


@query()
def page_markdown(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "html")
    blocks = written(H.parse_blocks(pages), "blocks")
    units_ = blocks.select("doc_id", F.col("block_idx").alias("unit_id"), "block_idx", "text")
    return translate.render_markdown(blocks, translate.translate_units(units_, None, translate.IdentityBackend))


@query("""select cast(p_partkey as varchar) as doc_id, 0 as ord, '/img/' || p_partkey || '.png' as src, 'https://arxiv.org/img/' || p_partkey || '.png' as url, p_partkey || '.png' as name from part""")
def paper_images(spark, sf_dir):
    return H.images(_papers(spark, sf_dir))


@query("select cast(p_partkey as varchar) as doc_id, '#bib.b' || p_partkey as anchor, 'On ' || p_brand as title from part")
def paper_bibliography(spark, sf_dir):
    return H.parse_bibliography(_papers(spark, sf_dir))


@query()
def page_images(spark, sf_dir):
    return H.images(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "html"))


@query()
def page_bibliography(spark, sf_dir):
    return H.parse_bibliography(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "html"))


def _part(spark, sf_dir, sql: str, **columns) -> DataFrame:
    """Columns made from x, which is that expression over part."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(sql).alias("x")).select("p_partkey", *(c.alias(n) for n, c in columns.items()))


@query("select p_partkey, case when p_size % 2 = 0 then 'x_' || p_size else 'y ' || chr(92) || 'displaystyle' end as tex from part")
def tex_without_displaystyle(spark, sf_dir):
    made = "case when p_size % 2 = 0 then '  ' || chr(92) || 'displaystyle x_' || p_size else 'y ' || chr(92) || 'displaystyle' end"
    return _part(spark, sf_dir, made, tex=X.strip_displaystyle(F.col("x")))


@query("select p_partkey, chr(92) || 'mathbf{x_' || p_size || '}  ' || chr(92) || '&  y ;   z' as tex from part")
def tex_for_rendering(spark, sf_dir):
    made = "'  $' || chr(92) || 'label{e}' || chr(92) || 'bm{x_' || p_size || '} & y ' || chr(92) || chr(92) || chr(10) || ' ' || chr(92) || 'nonumber z$'"
    return _part(spark, sf_dir, made, tex=X.clean_tex(F.col("x")))


@query("select s_suppkey, s_name || case when s_suppkey % 2 = 0 then '（共同一作）' else '（通讯作者）' end as author from supplier")
def author_marks(spark, sf_dir):
    made = F.expr("s_name || case when s_suppkey % 2 = 0 then '^{*}' else '^{🖂}' end")
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.author_marks(made).alias("author"))


@query("select doc_id, rtrim(text || '。.', '.。') as text from documents")
def without_stops(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_stops(F.concat("text", F.lit("。."))).alias("text"))


@query("select p_partkey, p_partkey % 3 = 0 as han, p_partkey % 3 <> 1 as wide from part")
def chinese_text(spark, sf_dir):
    made = "p_name || case p_partkey % 3 when 0 then '模型' when 2 then '㐀' else '' end"
    return _part(spark, sf_dir, made, han=X.has_cjk(F.col("x")), wide=X.has_cjk(F.col("x"), wide=True))


@query("select p_partkey, p_brand || ' and ' || p_size || ' x' || p_type as text from part")
def markdown_to_plain(spark, sf_dir):
    return _part(spark, sf_dir, "'**' || p_brand || '** and `' || p_size || '` [x](http://y)*' || p_type || '*'", text=X.strip_markdown(F.col("x")))


@query("""select p_partkey, (case p_size % 4 when 0 then 255 when 1 then 10 when 2 then 1 end)::double as red,
(case p_size % 4 when 0 then 165 when 1 then 11 when 2 then 2 end)::double as green, (case p_size % 4 when 0 then 0 when 1 then 12 when 2 then 3 end)::double as blue from part""")
def css_colours(spark, sf_dir):
    made = "case p_size % 4 when 0 then ' Orange' when 1 then '#0a0B0c' when 2 then 'rgb(1, 2,3)' else 'none' end"
    return _part(spark, sf_dir, made, **{n: X.colour(F.col("x"))[k].cast("double") for k, n in enumerate(("red", "green", "blue"))})


@query("""select p_partkey, round(case p_size % 6 when 0 then p_size * 25.4 / 96 when 1 then p_size * 25.4 / 72 when 2 then p_size * 10.0 when 3 then p_size / 100.0 when 4 then p_size * 4.0 end, 6)::double as width from part""")
def css_widths(spark, sf_dir):
    made = "case p_size % 6 when 0 then 'width: ' || p_size || 'px' when 1 then p_size || 'pt' when 2 then p_size || ' CM' when 3 then 'a:b;width:' || p_size || '%' when 4 then p_size || 'em' else 'auto' end"
    return _part(spark, sf_dir, made, width=F.round(X.css_width(F.col("x")), 6))


@query("select p_partkey, p_size % 3 = 0 as bold, p_size % 2 = 0 as italic from part")
def css_emphasis(spark, sf_dir):
    made = "case when p_size % 3 = 0 then 'font-weight: 700;' else 'font-weight:400;' end || case when p_size % 2 = 0 then 'FONT-STYLE:italic' else '' end"
    return _part(spark, sf_dir, made, bold=X.bold_style(F.col("x")), italic=X.italic_style(F.col("x")))


@query("select p_partkey, 'deepseek-v' || p_size || case when p_size % 2 = 0 then '' else '-chat' end as model from part")
def model_keys(spark, sf_dir):
    return _part(spark, sf_dir, "' DeepSeek-V' || p_size || case when p_size % 2 = 0 then '-0731 ' else '-Chat20250731' end", model=X.model_key(F.col("x")))


@query("select p_partkey, case p_size % 3 when 0 then p_size::double when 1 then 0.02::double end as price from part")
def price_cells(spark, sf_dir):
    return _part(spark, sf_dir, "case p_size % 3 when 0 then p_size || ' 元' when 1 then '0.02元' else '0.5 USD' end", price=X.price(F.col("x")))


@query("select p_partkey, p_size % 3 = 0 as separator from part")
def separator_rows(spark, sf_dir):
    return _part(spark, sf_dir, "array(':---', case p_size % 3 when 0 then ' ---: ' when 1 then '--' else p_name end)", separator=X.is_separator_row(F.col("x")))


@query("select p_partkey, p_size % 4 = 0 or p_size % 4 = 1 as hint from part")
def abbreviation_hints(spark, sf_dir):
    kind = F.expr("case when p_size % 4 = 0 then 'figure' when p_size % 4 = 3 then 'heading' else 'paragraph' end")
    text = F.expr("case when p_size % 4 = 2 then lower(p_name) else 'with LLM : large model' end")
    return table(spark, sf_dir, "part").select("p_partkey", X.defines_abbreviation(kind, text).alias("hint"))


@query("""select p_partkey, case when p_size % 2 = 0 then '[A. 2020](https://www.bing.com/search?q=On%20' || p_size || '%20parts "On ' || p_size || ' parts")'
else '[A. 2020](https://www.bing.com/search?q=A.%202020)' end as link from part""")
def citation_links(spark, sf_dir):
    return _part(spark, sf_dir, "case when p_size % 2 = 0 then 'On ' || p_size || ' parts, 2020a' end", link=X.cite_link(F.lit("A. 2020"), F.col("x")))


@query("""select p_partkey, case p_size % 3 when 0 then 'http://e/a/' when 1 then 'https://arxiv.org/i/' else 'https://arxiv.org/html/1/' end || p_size || '.png' as url, p_size || '.png' as name from part""")
def image_urls(spark, sf_dir):
    made = "case p_size % 3 when 0 then 'http://e/a/' when 1 then '/i/' else '' end || p_size || '.png'"
    url = X.absolute_url(F.col("x"), F.lit("https://arxiv.org/html/1/"))
    return _part(spark, sf_dir, made, url=url, name=X.last_segment(url))


@query("select doc_id, case when length(text) > 600 then substr(text, 1, 600) || '…' else text end as text from documents")
def shortened_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.shortened(F.col("text"), 600).alias("text"))


@query("select doc_id, count(*) as units, count(*) filter (n > 1) as merged, cast(sum(n) as bigint) as blocks from (select conv_id as doc_id, turn // 2 as unit_id, count(*) as n from conversations group by 1, 2) group by 1")
def unit_counts(spark, sf_dir):
    return units.unit_counts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.expr("turn div 2").alias("unit_id")))


@query("select s_suppkey, s_suppkey * 3600 as fetched_at from supplier where 10 - s_suppkey <= 5")
def price_cache_fresh(spark, sf_dir):
    cache = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("s_suppkey * 3600").alias("fetched_at"))
    return pricing.fresh_prices(cache, 36_000, 18_000).select("s_suppkey", "fetched_at")


@query("""select cast(s_suppkey as varchar) as doc_id, o as ord, 'm' || o || '-v' || s_suppkey as model, 0.5::double as cache_hit_price,
(s_suppkey + o)::double as cache_miss_price, 8.0::double as output_price from supplier, (values (0), (1)) as t(o) where o = 0 or s_suppkey % 2 = 0""")
def price_pages(spark, sf_dir):
    html = F.expr("""concat('<p>x</p><table><tr><th>模型版本</th><td> M0-V', s_suppkey, '-0731</td>', if(s_suppkey % 2 = 0, concat('<td>m1-v', s_suppkey, '</td>'), ''), '</tr>',
      '<tr><td rowspan="3">价格</td><td>百万tokens输入（缓存命中）</td><td>0.5元</td>', if(s_suppkey % 2 = 0, '<td><b>0.5 元</b></td>', ''), '</tr>',
      '<tr><td>百万tokens输入（缓存未命中）</td><td>', s_suppkey, '元</td>', if(s_suppkey % 2 = 0, concat('<td>', s_suppkey + 1, '元</td>'), ''), '</tr>',
      '<tr><td>百万tokens输出</td><td>8元</td>', if(s_suppkey % 2 = 0, '<td>8元</td>', ''), '</tr></table>')""")
    return pricing.price_table(H.table_rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), html.alias("html"))), versions=True)


class RuleTransport:
    """Answers by the length of a URL: some are not there, some fail at first, some never answer, some are always too busy."""

    def __init__(self) -> None:
        self.tried: dict[str, int] = {}

    def get(self, url, timeout):
        n = len(url)
        self.tried[url] = self.tried.get(url, 0) + 1
        if n % 7 == 0:
            return 404, ()
        if n % 7 == 1 and self.tried[url] <= n % 3:
            return 503, ()
        if n % 7 == 2:
            raise OSError(url)
        if n % 7 == 3:
            return 429, ()
        return 200, (part.encode() for part in ("body of ", url))


_FETCHED = """with u as (select distinct url from pages where url is not null),
t as (select url, length(url) % 7 as k, case length(url) % 7 when 0 then 1 when 1 then length(url) % 3 + 1 when 2 then 3 when 3 then 3 else 1 end as attempts from u)
select url, k not in (0, 2, 3) as ok, case k when 0 then 404 when 2 then 0 when 3 then 429 else 200 end as status, cast(attempts as int) as attempts,
cast(pow(2, attempts - 1) - 1 as double) as waited, case when k not in (0, 2, 3) then 'body of ' || url end as text from t"""


def _fetched_text(rows: DataFrame) -> DataFrame:
    return rows.select("url", "ok", F.coalesce("status", F.lit(0)).alias("status"), "attempts", "waited", F.decode("content", "UTF-8").alias("text"))


@query(_FETCHED)
def fetch_urls(spark, sf_dir):
    """The URLs of all pages through a transport that fails by rule, with two attempts more."""
    return _fetched_text(fetch.fetch(table(spark, sf_dir, "pages").select("url"), RuleTransport, Settings(retries=2), sleep=lambda seconds: None))


@query(_FETCHED)
def fetch_data_source(spark, sf_dir):
    """The same as a data source: the list of URLs is written first, and each of its files is read by one task."""
    urls = new_path(spark, "urls")
    fetch.write_url_list(table(spark, sf_dir, "pages").select("url"), urls, files=8)
    fetch.register(spark)
    told = {"urls": urls, "transport": f"{__name__}:RuleTransport", "retries": "2", "waits": "no"}
    return _fetched_text(spark.read.format("fetched").options(**told).load())


_TITLE = "case page_id % 4 when 0 then concat('Part: ', page_id % 10) when 1 then '' when 2 then concat('a/b ', page_id) end"


@query(f"""with t as (select page_id, html, replace(replace(coalesce(nullif(trim({_TITLE}), ''), cast(page_id as varchar)), ':', '：'), '/', '、') as stem from pages),
c as (select *, count(*) over (partition by stem) as n from t)
select stem || case when n > 1 then '  ' || substr(sha1(cast(page_id as varchar)), 1, 16) else '' end || '.html' as name, html from c""")
def files_by_title(spark, sf_dir):
    """Every page as a file named by a title, written with a two-phase commit and read again; equal titles are told apart."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html", F.expr(_TITLE).alias("title"))
    path = new_path(spark, "files")
    files.write_files(files.file_names(pages, "title").select(F.concat("stem", F.lit(".html")).alias("name"), F.col("html").alias("content")), path)
    return files.read_files(spark, path).select("name", F.decode("content", "UTF-8").alias("html"))


@query("""select doc_id, cast(n as int) as block_idx, case when n % 3 = 0 then 'third of ' || n when n % 2 = 0 then 'second of ' || n else 'first of ' || n end as translation
from (select doc_id, (length(text) + doc_id) % 12 as n from documents) where n % 3 <> 1""")
def stored_results(spark, sf_dir):
    """Results in three runs, each over a part of the documents, the first two compacted before the third: the latest of each counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("cast((length(text) + doc_id) % 12 as int)").alias("block_idx")).where("block_idx % 3 <> 1")
    store = ResultStore(spark, new_path(spark, "store"), 1, "doc_id long, block_idx int, translation string")
    said = lambda word: F.concat(F.lit(f"{word} of "), F.col("block_idx").cast("string"))
    store.add(docs.withColumn("translation", said("first")))
    store.add(docs.where("block_idx % 2 = 0").withColumn("translation", said("second")))
    store.compact(files=2)
    store.add(docs.where("block_idx % 3 = 0").withColumn("translation", said("third")))
    return store.latest()


class Chat:
    """Answers by rule: of a group it leaves out each block whose length five divides, in an order of its own and with an id that is none,
    or says what is no JSON; alone it leaves every second of those blank. The length of the prompt it was given goes before each answer."""

    def open(self, settings):
        pass

    def answer(self, system, user, timeout):
        asked = json.loads(user)
        texts = [b["text"] for b in asked["blocks"]] if "blocks" in asked else [asked["text"]]
        size = sum(map(len, texts))
        if "blocks" not in asked:
            said = json.dumps({"translation": "" if size % 10 == 0 else f"{len(system)}! {texts[0]}", "terms": []}, ensure_ascii=False)
        elif size % 7 == 0:
            said = "no JSON"
        else:
            blocks = [{"id": i, "translation": f"{len(system)}: {t}"} for i, t in enumerate(texts) if len(t) % 5]
            said = json.dumps({"blocks": [*blocks[::-1], {"id": 9, "translation": "none"}], "terms": []}, ensure_ascii=False)
        return requests.Reply(said, len(system), size, 1)

    def close(self):
        pass


_WORDS = [translate.PROMPT["intro"], *translate.PROMPT["rules"], ""]
_PROMPT_SIZE = "case when n = 1 or alone then {} else {} end + case when conv_id % 2 = 0 then length('4. What the paper is about: paper ' || conv_id) + 2 else 0 end + case when conv_id % 3 = 0 then length('4. Terms:') + 1 + length('- term ' || conv_id) + 2 else 0 end".format(*(sum(map(len, _WORDS)) + 2 * len(_WORDS) + len(translate.PROMPT[k]) for k in ("single", "group")))
_CHAT = f"""with t as (select conv_id, turn, turn // 2 as unit, text, length(text) as len from conversations where {_BARE.format("text")} <> ''),
u as (select conv_id, unit, count(*) as n, sum(len) as size, false as alone from t group by 1, 2),
b as (select t.*, n, size, n = 1 or (len % 5 <> 0 and size % 7 <> 0) as at_once from t join u using (conv_id, unit)),
asked as (select conv_id, n, size, alone from u union all select conv_id, n, len as size, true as alone from b where not at_once or (n = 1 and len % 10 = 0)),
said as (select *, not at_once as alone from b)
"""


def _chatted(spark, sf_dir) -> requests.Translated:
    said = table(spark, sf_dir, "conversations")
    units_ = said.select(F.col("conv_id").alias("doc_id"), F.expr("turn div 2").alias("unit_id"), F.col("turn").alias("block_idx"), "text")
    prompts = said.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.expr("case when doc_id % 2 = 0 then concat('paper ', doc_id) end as summary"), F.expr("case when doc_id % 3 = 0 then concat('- term ', doc_id) end as glossary"))
    return requests.translate_blocks(units_, prompts, Chat)


@query(_CHAT + f"""select cast(conv_id as varchar) as doc_id, cast(turn as int) as block_idx, case when n > 1 and not alone then ({_PROMPT_SIZE})::varchar || ': ' || text when len % 10 = 0 then '' else ({_PROMPT_SIZE})::varchar || '! ' || text end as translation,
case when n > 1 and not alone then 'group' when len % 10 = 0 then 'given up' else 'single' end as status from said""")
def chat_translation(spark, sf_dir):
    """Turns by two as units: groups are asked at once by id, gaps alone, and what stays open is given up."""
    return _chatted(spark, sf_dir).results.select("doc_id", "block_idx", "translation", "status")


@query(_CHAT + f"""select cast(conv_id as varchar) as doc_id, count(*) as requests, cast(sum({_PROMPT_SIZE}) as bigint) as prompt, cast(sum(size) as bigint) as completion, count(*) as cache_hit from asked group by 1""")
def chat_usage(spark, sf_dir):
    """What those requests cost, as the backend says: every group and every block that is asked for alone."""
    return requests.usage_of(_chatted(spark, sf_dir).usage, "doc_id")


class CellChat(Chat):
    """Knows that a cell is asked for, in which paper, and cannot translate every fifth."""

    def answer(self, system, user, timeout):
        text = json.loads(user)["text"]
        assert "The text is a table cell" in system
        size = len(text)
        paper_ = system.split("about: ")[1].split("\n")[0]
        return requests.Reply(json.dumps({"translation": translate.SKIP if size % 5 == 0 else f"{paper_} {text}"}, ensure_ascii=False), 1, 1, 0)


@query("""with t as (select p_partkey, 'the ' || p_type || ' rate' as c, 'paper ' || p_size as p from part)
select cast(p_partkey as varchar) as doc_id, 0 as block_idx, '| ' || p || ' Method name of it | Score |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || case when length(c) % 5 = 0 then c else p || ' ' || c end || ' | 1 |' as table_zh from t""")
def chat_tables(spark, sf_dir):
    """Cells of a table of each part, each asked for with the paper's summary; those that the model cannot translate stay."""
    part = table(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey").cast("string"))
    made = F.expr("concat('| Method name of it | Score |\n| --- | --- |\n| the ', p_type, ' rate | 1 |')")
    prompts = part.select("doc_id", F.concat(F.lit("paper "), "p_size").alias("summary"), F.lit(None).cast("string").alias("glossary"))
    tables_ = part.select("doc_id", F.lit(0).alias("block_idx"), made.alias("table_md"))
    return translate.translate_tables(tables_, None, lambda cells: requests.ask_cells(cells, prompts, CellChat)).select("doc_id", "block_idx", "table_zh")


def _kinds_column():
    """Blocks of all kinds, with what they are translated into."""
    said = [
        ("title", 1, F.lit("On parts"), F.concat(F.lit("论"), "p_partkey", F.lit("⟦NEWPAR⟧"))),
        ("heading", 2, F.lit("Introduction"), F.lit("")),
        ("paragraph", 0, F.concat(F.lit("Of "), "p_type"), F.concat(F.lit("甲"), "p_size", F.lit("乙[NEWPAR] 丙"))),
        ("figure", 0, F.lit(""), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("图"), "p_size"))),
        ("table", 0, F.lit(""), F.lit("表说明")),
        ("listing", 0, F.lit(""), F.lit("")),
        ("equation", 0, F.lit("x"), F.lit("")),
        ("table", 0, F.lit(""), F.lit("")),
    ]
    return F.array(*(F.struct(F.lit(i).alias("block_idx"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), text.alias("text"), tr.alias("tr")) for i, (kind, level, text, tr) in enumerate(said)))


@query("""select cast(p_partkey as varchar) as doc_id, '论' || p_partkey as title_zh, '# 论' || p_partkey || chr(10) || chr(10) || '> 原文: https://arxiv.org/abs/' || p_partkey || chr(10) || chr(10) || '---' || chr(10) || chr(10)
|| '## 引言' || chr(10) || chr(10) || '甲 ' || p_size || case when p_size < 10 then '' else ' ' end || '乙' || chr(10) || chr(10) || ' 丙' || chr(10) || chr(10)
|| '![figure](' || case when p_partkey % 3 = 0 then 'images/' || p_partkey || '.png' else '/img/' || p_partkey || '.png' end || ')' || chr(10) || chr(10) || '> ' || case when p_partkey % 2 = 0 then '图 ' || p_size else 'Shows ' || p_size end || chr(10) || chr(10)
|| '| ' || case when p_partkey % 5 = 0 then '译 a' else 'a' end || ' |' || chr(10) || chr(10) || '> 表说明' || chr(10) || chr(10) || '1 x' || chr(10) || chr(10) || '> Code' || chr(10) || chr(10) || '$$x$$' || chr(10) || chr(10) || '(表格)' || chr(10) || chr(10) as markdown from part""")
def translated_papers(spark, sf_dir):
    """A paper of each part with all kinds of blocks: translated captions and tables are shown, others as they were."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").cast("string").alias("doc_id"), "p_partkey", "p_size", F.explode(_kinds_column()).alias("x")).select("*", "x.*")
    key = F.col("p_partkey").cast("string")
    only = lambda kind, value: F.when(F.col("kind") == kind, value)
    image = F.concat(F.lit("/img/"), key, F.lit(".png"))
    caption = F.when(F.col("block_idx") == 3, F.concat(F.lit("Shows "), F.col("p_size").cast("string"))).when(F.col("block_idx") == 4, F.lit("About")).when(F.col("block_idx") == 5, F.lit("Code"))
    blocks = rows.select("doc_id", "block_idx", "kind", "level", "text", only("equation", F.lit("$$x$$")).alias("raw"), only("figure", image).alias("src"), only("figure", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("images/"), key, F.lit(".png")))).alias("local_src"), caption.alias("caption"), F.when(F.col("block_idx") == 4, "| a |").alias("table_md"), only("listing", F.lit("1 x")).alias("listing_md"))
    results = rows.where("tr is not null").select("doc_id", "block_idx", F.col("tr").alias("translation"))
    told = rows.where("block_idx = 4 and p_partkey % 5 = 0").select("doc_id", "block_idx", F.lit("| 译a |").alias("table_zh"))
    return translate.render_markdown(blocks, results, told).select("doc_id", "title_zh", "markdown")


_NAV_HTML = f"concat('<nav>menu ', p_partkey, '</nav>', {_PAPER_HTML}, '<figure class=\"ltx_table\"><table><tr><td>cell <i>', p_type, '</i></td></tr></table><figcaption>About ', p_size, '</figcaption></figure>')"


@query(f"""with h as (select *, {_NAV_HTML.replace('\\"', '"')} as html from part)
select cast(p_partkey as varchar) as doc_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '<nav>menu ' || p_partkey || '</nav>', ''), '>Part ' || p_partkey || '<', '>[Part ' || p_partkey || ']<'),
'ltx_title_section">' || p_type, 'ltx_title_section">[' || p_type || ']'), 'Of <b>' || p_brand || '</b>.<', '[Of .] <b>[' || p_brand || ']</b><'), 'A. 2020', '[A. 2020]'), 'On ' || p_brand || '.', '[On ' || p_brand || '.]'), 'cell <i>' || p_type || '<', '[cell ] <i>[' || p_type || ']<'),
'About ' || p_size, case when p_partkey % 2 = 0 then '&lt;关于&gt;' else 'About ' || p_size end) as html from h""")
def papers_written_back(spark, sf_dir):
    """A page of each part with every text in brackets where it stood, half of the captions translated and the menu cut out."""
    part = table(spark, sf_dir, "part")
    pages = part.select(F.col("p_partkey").cast("string").alias("doc_id"), F.expr(_NAV_HTML).alias("html"))
    leaves = W.text_leaves(pages)
    told = W.leaf_groups(leaves).select("doc_id", "parent", F.concat(F.lit("["), "text", F.lit("]")).alias("translation"))
    captions = leaves.where("role = 'caption' and cast(doc_id as int) % 2 = 0").select("doc_id", "html_id", F.lit("<关于>").alias("translation"))
    return W.write_back(pages, leaves, told, captions)


@query("""with recursive cells as (select l_orderkey as t, cast((l_linenumber - 1) // 2 as int) as r, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as k, l_returnflag || l_linenumber as text,
  1 + l_partkey % 3 as cs, 1 + l_suppkey % 3 as rs, max(cast((l_linenumber - 1) // 2 as int)) over (partition by l_orderkey) as last from lineitem),
sweep as (select t, cast(0 as bigint) as k, cast([] as bigint[]) as taken, cast([] as struct(p bigint, x varchar)[]) as told, cast(0 as bigint) as width from (select distinct t from cells)
  union all
  select t, k, list_concat(taken, places), list_concat(told, list_transform(list_filter(places, lambda p: not list_contains(taken, p)), lambda p: {'p': p, 'x': text})), greatest(width, c + cs) from (
    select *, list_transform(range(0, cs * (least(last, r + rs - 1) - r + 1)), lambda i: (r + i // cs) * 100 + c + i % cs) as places from (
      select s.t, c.k, s.taken, s.told, s.width, c.text, c.r, c.cs, c.rs, c.last, list_min(list_filter(range(0, 60), lambda x: not list_contains(s.taken, c.r * 100 + x))) as c
      from sweep s join cells c on c.t = s.t and c.k = s.k + 1))),
done as (select * from sweep qualify row_number() over (partition by t order by k desc) = 1),
lines as (select t, width, unnest(list_distinct(list_transform(told, lambda y: y.p // 100))) as r, told from done)
select t as table_id, cast(r as int) as r, array_to_string(list_transform(range(0, width), lambda c: coalesce(list_filter(told, lambda y: y.p = r * 100 + c)[1].x, '')), '|') as texts from lines""")
def span_grids(spark, sf_dir):
    """The lines of an order as cells of a table, two a row, with column and row spans."""
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as table_id", "cast((l_linenumber - 1) div 2 as int) as r", "struct(l_linenumber, l_partkey, l_suppkey, l_returnflag) as ord", "concat(l_returnflag, l_linenumber) as text", "cast(1 + l_partkey % 3 as int) as colspan", "cast(1 + l_suppkey % 3 as int) as rowspan")
    return tables.span_grid(cells).withColumn("texts", F.array_join("texts", "|"))


@query(ORACLES["paper_blocks"])
def blocks_by_sql(spark, sf_dir):
    """The blocks of a paper of each part, by a table function in SQL."""
    udtf.register(spark)
    papers = spread(_papers(spark, sf_dir), "doc_id")
    return spark.sql("select doc_id, b.block_idx, b.kind, b.text, b.raw, b.html_id from {papers}, lateral parse_blocks(html) b", papers=papers)


_SHAPES = """concat('<article><section class="ltx_section"><h2 class="ltx_title ltx_title_section">Data</h2><ul class="ltx_itemize"><li class="ltx_item"><p class="ltx_p">item ', p_partkey, '</p></li><li class="ltx_item"><div class="ltx_para"><p class="ltx_p">second</p></div></li></ul>',
'<div class="ltx_para"><p class="ltx_p">See <em>', p_brand, '</em></p></div><section class="ltx_subsection"><h3 class="ltx_title_subsection">Sub</h3><div class="ltx_para"><p class="ltx_p">deep</p></div></section>',
'<figure class="ltx_table"><table class="ltx_tabular"><tr><th>Method</th><th>Size</th></tr><tr><td>', p_type, '</td><td>', p_size, '</td></tr></table><figcaption class="ltx_caption">Table of ', p_size, '</figcaption></figure>',
'<figure class="ltx_figure"><img src="/i/', p_partkey, '.png"><figcaption class="ltx_caption">Figure</figcaption></figure></section></article>')"""


@query("""select cast(p_partkey as varchar) as doc_id, cast(i as int) as block_idx, kind, cast(level as int) as level, text, raw, caption, table_md from (select *, '| Method | Size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_type || ' | ' || p_size || ' |' as t from part), unnest([
  {'i': 0, 'kind': 'heading', 'level': 2, 'text': 'Data', 'raw': 'Data', 'caption': null, 'table_md': null}, {'i': 1, 'kind': 'list_item', 'level': 0, 'text': 'item ' || p_partkey, 'raw': '- item ' || p_partkey, 'caption': null, 'table_md': null},
  {'i': 2, 'kind': 'list_item', 'level': 0, 'text': 'second', 'raw': '- second', 'caption': null, 'table_md': null}, {'i': 3, 'kind': 'paragraph', 'level': 0, 'text': 'See ' || p_brand, 'raw': 'See *' || p_brand || '*', 'caption': null, 'table_md': null},
  {'i': 4, 'kind': 'heading', 'level': 3, 'text': 'Sub', 'raw': 'Sub', 'caption': null, 'table_md': null}, {'i': 5, 'kind': 'paragraph', 'level': 0, 'text': 'deep', 'raw': 'deep', 'caption': null, 'table_md': null},
  {'i': 6, 'kind': 'table', 'level': 0, 'text': 'Table of ' || p_size || chr(10) || t, 'raw': t || chr(10) || '> Table of ' || p_size, 'caption': 'Table of ' || p_size, 'table_md': t},
  {'i': 7, 'kind': 'figure', 'level': 0, 'text': 'Figure', 'raw': '![](https://arxiv.org/i/' || p_partkey || '.png)' || chr(10) || '> Figure', 'caption': 'Figure', 'table_md': null}]) as u(x), lateral (select x.*)""")
def blocks_of_all_shapes(spark, sf_dir):
    """Lists, subsections, tables and figures with captions, by the table function."""
    udtf.register(spark)
    papers = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.expr(_SHAPES).alias("html")), "doc_id")
    return spark.sql("select doc_id, b.block_idx, b.kind, b.level, b.text, b.raw, b.caption, b.table_md from {papers}, lateral parse_blocks(html) b", papers=papers)


@query(ORACLES["glossary_ingest_last_wins"])
def glossary_stream(spark, sf_dir):
    """The terms of all events as a stream in two batches, of which the second holds half of the first again."""
    events = table(spark, sf_dir, "events").selectExpr(*_split(_TERMS))
    source, path = new_path(spark, "events"), new_path(spark, "terms")
    for part in ("ord % 3 <> 0", "ord % 2 = 0 or ord % 3 = 0"):
        events.where(part).coalesce(1).write.mode("append").parquet(source)
    store = ResultStore(spark, path, 1, SG.TERMS, ("doc_id", "en_key"))
    SG.store_terms(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source), store, f"{path}/checkpoint").awaitTermination()
    return store.latest().select(F.col("doc_id").cast(events.schema["doc_id"].dataType).alias("doc_id"), "en_key", "ord", "zh", "en_full", "note")


_MORE_SHAPES = """concat('<article><section class="ltx_section"><h2 class="ltx_title_section">More</h2><div class="ltx_para"><p class="ltx_p">H<math class="ltx_Math"><annotation encoding="application/x-tex">_{', p_size, '}</annotation></math>↓ of <cite class="ltx_cite"><a class="ltx_ref" href="#bib.b1" title="On part ', p_size, ', 2020a">1</a></cite></p>',
'<table class="ltx_equationgroup"><tr class="ltx_equation"><td class="ltx_eqn_cell"><math><annotation encoding="application/x-tex">a_', p_size, '</annotation></math></td><td class="ltx_eqn_cell"><math><annotation encoding="application/x-tex">=b</annotation></math></td></tr><tr class="ltx_equation"><td class="ltx_eqn_cell"><math><annotation encoding="application/x-tex">c</annotation></math></td></tr></table></div>',
'<figure class="ltx_algorithm"><div class="ltx_listing"><div class="ltx_listingline"><span class="ltx_tag_listingline">1</span>x|', p_size, '</div><div class="ltx_listingline">Input: ', p_type, '</div></div><figcaption class="ltx_caption">Alg</figcaption></figure>',
'<div class="ltx_para"><span class="ltx_inline-block"><span class="ltx_p">box one</span><span class="ltx_p">', p_brand, '</span></span></div><section class="ltx_paragraph"><h4 class="ltx_title_paragraph">Lead</h4><div class="ltx_para"><p class="ltx_p">tail ', p_size, '</p></div></section>',
'<figure class="ltx_table"><table><tr><td rowspan="2">', p_type, '</td><td>1|2</td></tr><tr><td>3</td></tr></table></figure>',
'<figure class="ltx_table"><table><tr><td>Task</td><td>a</td><td>b</td><td></td></tr><tr><td>', lower(p_type), '</td><td>left</td><td>up</td><td></td></tr><tr><td>x</td><td>', p_size, '</td><td>2</td><td></td></tr></table></figure></section></article>')"""


@query("""select cast(p_partkey as varchar) as doc_id, cast(i as int) as block_idx, kind, cast(level as int) as level, text, raw from (select *, chr(10) as n, chr(92) as b, chr(8203) as z from part), unnest([
  {'i': 0, 'kind': 'heading', 'level': 2, 'text': 'More', 'raw': 'More'},
  {'i': 1, 'kind': 'paragraph', 'level': 0, 'text': '$H_{' || p_size || '}' || b || 'downarrow$ of 1', 'raw': 'H$_{' || p_size || '}$↓ of [1](https://www.bing.com/search?q=On%20part%20' || p_size || ' "On part ' || p_size || '")'},
  {'i': 2, 'kind': 'equation', 'level': 0, 'text': b || 'begin{aligned}' || n || 'a_' || p_size || ' & =b ' || b || b || n || 'c' || n || b || 'end{aligned}', 'raw': '$$' || n || b || 'begin{aligned}' || n || 'a_' || p_size || ' & =b ' || b || b || n || 'c' || n || b || 'end{aligned}' || n || '$$' || n},
  {'i': 3, 'kind': 'listing', 'level': 0, 'text': 'Alg', 'raw': '| ' || z || ' | ' || z || ' |' || n || '| --- | --- |' || n || '| 1 | x' || b || '|' || p_size || ' |' || n || '| Input | ' || p_type || ' |' || n || '> Alg'},
  {'i': 4, 'kind': 'text_box', 'level': 0, 'text': 'box one' || n || p_brand, 'raw': '> box one' || n || '> ' || p_brand}, {'i': 5, 'kind': 'heading', 'level': 4, 'text': 'Lead', 'raw': 'Lead'}, {'i': 6, 'kind': 'paragraph', 'level': 0, 'text': 'tail ' || p_size, 'raw': 'tail ' || p_size},
  {'i': 7, 'kind': 'table', 'level': 0, 'text': n || '<table><tr><td rowspan="2">' || p_type || '</td><td>1|2</td></tr><tr><td>3</td></tr></table>' || n, 'raw': '<table><tr><td rowspan="2">' || p_type || '</td><td>1|2</td></tr><tr><td>3</td></tr></table>' || n},
  {'i': 8, 'kind': 'table', 'level': 0, 'text': n || '| Task<br>' || lower(p_type) || ' | a<br>left | b<br>up |' || n || '| --- | --- | --- |' || n || '| x | ' || p_size || ' | 2 |', 'raw': '| Task<br>' || lower(p_type) || ' | a<br>left | b<br>up |' || n || '| --- | --- | --- |' || n || '| x | ' || p_size || ' | 2 |'}]) as u(x), lateral (select x.*)""")
def blocks_of_more_shapes(spark, sf_dir):
    """Formulas in text and in groups, listings, text boxes, titled paragraphs, tables with spans and with two header rows."""
    papers = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.expr(_MORE_SHAPES).alias("html"))
    return H.parse_blocks(papers).select("doc_id", "block_idx", "kind", "level", "text", "raw")


@query("select doc_id, (length(text) - length(replace(text, 'a', ''))) % 2 = 1 as dangling from documents where not contains(text, chr(92)) and not contains(text, '$')")
def dangling_dollars(spark, sf_dir):
    """Every text with its a as dollars: whether their number is odd."""
    docs = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\\")) & ~F.contains("text", F.lit("$")))
    return docs.select("doc_id", X.dangling_dollar(F.translate("text", "a", "$")).alias("dangling"))


@query("""select p_partkey, 'a ' || chr(92) || 'sim ' || p_size || ' $' || chr(92) || 'downarrow$ b $x' || chr(92) || 'uparrow$ ' || p_type || ' $_{' || p_size || '}$ ' || chr(92) || 'text{' || p_brand || '}' as said from part""")
def sanitized_tex(spark, sf_dir):
    return _part(spark, sf_dir, "concat('a \\\\thicksim ', p_size, ' \\\\downarrow b $x\\\\uparrow$ ', p_type, ' {}_{', p_size, '} \\\\textsc{', p_brand, '}')", said=P.sanitize("x"))


@query("select doc_id, unnest(string_split(replace(replace(text, ' the ', chr(10)), ' of ', chr(10)), chr(10))) as line from (select doc_id, replace(text, chr(13), '') as text from documents)")
def text_box_lines(spark, sf_dir):
    """Every text broken at two words, at one of them with a carriage return."""
    broken = F.replace(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit(" the "), F.lit("\r\n")), F.lit(" of "), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.text_box_lines(broken)).alias("line"))


@query("""with f as (select 'x_{' || l_linenumber || '}' || l_returnflag as tex, l_quantity > 25 as display, l_orderkey from lineitem)
select substr(sha1(case when display then 'D:' else 'I:' end || tex), 1, 16) as key, tex, display, count(*) as uses from f group by tex, display""")
def distinct_formulas(spark, sf_dir):
    """The formulas of all lines, each once by the hash of what it shows."""
    lines = table(spark, sf_dir, "lineitem").select(F.expr("concat('x_{', l_linenumber, '}', l_returnflag)").alias("tex"), (F.col("l_quantity") > 25).alias("display"))
    return paper.distinct_formulas(lines)


@query("select cast(p_partkey as varchar) as doc_id, cast(0 as int) as block_idx, '/img/' || p_partkey || '.png' as src, case when p_partkey % 3 = 0 then 'images/' || p_partkey || '.png' else '/img/' || p_partkey || '.png' end as local_src from part")
def local_images(spark, sf_dir):
    """Figures of parts, of which every third image has been stored."""
    key = F.col("p_partkey").cast("string")
    part = table(spark, sf_dir, "part").select(key.alias("doc_id"), F.lit(0).alias("block_idx"), F.concat(F.lit("/img/"), key, F.lit(".png")).alias("src"), F.lit(None).cast("string").alias("local_src"))
    stored = part.where("cast(doc_id as int) % 3 = 0").select("doc_id", "src", F.concat(F.lit("images/"), "doc_id", F.lit(".png")).alias("local"))
    return H.with_local_images(part, stored)


@query("""select s_suppkey as doc_id, '{"alpha":{"zh":"甲' || s_suppkey || '","en_full":null,"note":"n","seen":true}' || case when s_suppkey % 2 = 0 then ',"beta":{"zh":"<KEEP>","en_full":"' || s_name || '","note":null,"seen":false}' else '' end || '}' as glossary_json from supplier""")
def glossary_files(spark, sf_dir):
    """A glossary of each supplier as JSON, terms in their order."""
    made = F.expr("""inline(array_compact(array(named_struct('ord', 1, 'en_key', 'alpha', 'zh', concat('甲', s_suppkey), 'en_full', cast(null as string), 'note', 'n', 'seen', true),
      if(s_suppkey % 2 = 0, named_struct('ord', 2, 'en_key', 'beta', 'zh', '<KEEP>', 'en_full', s_name, 'note', cast(null as string), 'seen', false), null))))""")
    return G.glossary_json(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), made))


@query("select p_partkey, case p_partkey % 5 when 0 then 'docx' when 1 then 'docx,pdf' when 2 then 'docx,pdf' when 3 then 'pdf,docx' else '' end as formats from part")
def export_formats(spark, sf_dir):
    return _part(spark, sf_dir, "case p_partkey % 5 when 0 then ' DOCX, html' when 1 then 'all' when 2 then 'pdf，docx_pdf' when 3 then 'pdf，docx' else '' end", formats=F.array_join(translate.export_formats(F.col("x")), ","))


@query("select l_orderkey as table_id, bool_or(l_linenumber % 4 = 3) as complex, cast(max(case when l_linenumber > 1 then greatest(1, l_linenumber % 4) end) as int) as wide from lineitem group by 1 having count(*) filter (where l_linenumber > 1) > 0")
def complex_tables(spark, sf_dir):
    """Orders as tables, one cell a line: whether any spans more than two, and how many columns their rows below the first take."""
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as table_id", "l_linenumber as r", "cast(greatest(1, l_linenumber % 4) as int) as colspan", "l_linenumber = 1 as is_header").where("r > 1 or is_header").distinct()
    below = cells.where("not is_header")
    spans = F.transform(F.collect_list(F.greatest(F.lit(1), F.col("colspan") - 1)), lambda c: F.struct(c.alias("colspan"), F.lit(1).alias("rowspan")))
    wide = tables.table_width(cells).join(below.select("table_id").distinct(), "table_id", "left_semi")
    return below.groupBy("table_id").agg(X.is_complex_table(spans).alias("complex")).join(wide, "table_id").select("table_id", "complex", F.col("width").alias("wide"))


@query("select s_suppkey, cast(o as int) as ord, 'AB' || o || '-' || s_suppkey as en, 'Alpha ' || s_name as en_full, '甲' || o as zh from supplier, (values (0), (1)) as t(o)")
def first_uses(spark, sf_dir):
    said = F.expr("concat('见 AB0-', s_suppkey, '（Alpha ', s_name, ', 甲0）和 AB1-', s_suppkey, '（Alpha ', s_name, '，甲1）。')")
    return G.first_uses(table(spark, sf_dir, "supplier").select("s_suppkey", said.alias("translation"))).select("s_suppkey", F.col("ord").cast("int").alias("ord"), "en", "en_full", "zh")


class SeedChat(Chat):
    """Teaches the first word of the first texts, and another sense of a fixed term."""

    def answer(self, system, user, timeout):
        text = json.loads(user)["text"]
        assert "- probe → 【探针】" in system
        return json.dumps({"translation": text, "terms": [{"en": text.split(" ")[0], "zh": "词"}, {"en": "Probe", "zh": "探头"}]}, ensure_ascii=False)


@query("""with t as (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'user' and trim(text) <> ''),
w as (select conv_id, lower(string_split(replace(text, chr(10), ' '), ' ')[1]) as w from t where n = 1),
k as (select conv_id, k, zh from (select distinct conv_id from conversations), (values ('alignment', '对齐'), ('artifacts', '伪影'), ('probe', '探针'), ('probes', '探针'), ('split', '数据集划分')) as s(k, zh))
select cast(k.conv_id as varchar) as doc_id, k as en_key, case when k = 'probe' and w.w is not null then '探头' else zh end as zh from k left join w on w.conv_id = k.conv_id
union all select cast(conv_id as varchar), w, '词' from w where w not in ('alignment', 'artifacts', 'probe', 'probes', 'split')""")
def seed_glossaries(spark, sf_dir):
    """Conversations as papers: the fixed terms, and what a model teaches when it is shown their first texts."""
    turns = _turns(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    return requests.seed_glossary(turns, SeedChat).select("doc_id", "en_key", "zh")
