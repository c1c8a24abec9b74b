"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chatformat, convtrie, decontam, divergence, langid, linededup, mixing, ngramjoin, quality, rangejoin, substring, toxicity, vptree
from strandline.llm.learning import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), folds=5, held=0)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("hits").alias("n_hits"), F.size(F.filter("hits", lambda h: h["quoted"])).alias("n_quoted"))


def op2_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.collapse_and_render(_table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict_languages(docs.select("doc_id", "text"), langid.fit_languages(docs, folds=4, held=2))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels"), folds=5, held=0))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents"), width=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, shared = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6
    return convtrie.conversation_trie(_table(spark, sf_dir, "conversations"), base, shared, most=5)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op13_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)


OP2_SQL = """
with rows_ as (
  select distinct conv_id, coalesce(turn, 9223372036854775807) as turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
placed as (select *, row_number() over (partition by conv_id order by turn, role, text) as i, count(*) over (partition by conv_id) as n from rows_),
chained as (select conv_id, i, n, string_agg(role || chr(31) || text, chr(30)) over (partition by conv_id order by i rows unbounded preceding) as prefix from placed),
whole as (select prefix, n, min(conv_id) as conv_id, count(*) as n_copies from chained where i = n group by prefix, n),
kept as (select conv_id, n_copies from whole where not exists (select 1 from chained c where c.i < c.n and c.i = whole.n and c.prefix = whole.prefix)),
said as (select conv_id, max(n) as n_turns, string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' order by i) as rendered from placed group by conv_id)
select conv_id, n_turns, n_copies, rendered from kept join said using (conv_id)
"""

OP6_SQL = """
with lines_ as (select doc_id, string_split(text, chr(10)) as ls from documents where doc_id is not null and text is not null),
windows_ as (select doc_id, unnest(range(0, len(ls) - 2)) as pos, ls from lines_ where len(ls) >= 3),
keyed as (select doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] as key from windows_),
ranked as (select doc_id, pos, rank() over (partition by key order by doc_id, pos) as r from keyed),
gone as (select distinct doc_id, pos + k as pos from ranked, range(0, 3) t(k) where r > 1),
each_ as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from lines_),
kept as (select e.doc_id, count(*) as n_lines, count(g.pos) as n_removed, coalesce(string_agg(e.line, chr(10) order by e.pos) filter (g.pos is null), '') as text
  from each_ e left join gone g on e.doc_id = g.doc_id and e.pos = g.pos group by e.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, d.text) end as text, coalesce(k.n_lines, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end) as n_lines, coalesce(k.n_removed, 0) as n_removed
from documents d left join kept k on d.doc_id = k.doc_id
"""

OP9_SQL = """
with recursive words_ as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents where text is not null),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words_ where len(w) >= 5)
  union select doc_id, array_to_string(w, ' ') from words_ where len(w) between 1 and 4),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
both_ as (select x, y from links union select y, x from links),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.y from reach r join both_ l on l.x = r.b)
select d.doc_id, coalesce(max(s.n), 0) as n_shingles, min(r.b) as component_id from documents d left join sizes s on s.doc_id = d.doc_id left join reach r on r.a = d.doc_id group by d.doc_id
"""

OP10_SQL = """
with words_ as (select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') end as w from documents),
windows_ as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from words_ where len(w) >= 20)),
ranked as (select doc_id, i, rank() over (partition by s order by doc_id, i) as r from windows_),
gone as (select distinct doc_id, i + k as i from ranked, range(0, 20) t(k) where r > 1),
each_ as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words_),
kept as (select e.doc_id, count(*) as n_words, count(g.i) as n_removed, coalesce(string_agg(e.word, ' ' order by e.i) filter (g.i is null), '') as t
  from each_ e left join gone g on g.doc_id = e.doc_id and g.i = e.i group by e.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from documents d left join kept k on k.doc_id = d.doc_id
"""


OP11_SQL = """
with own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
crcs as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) as t),
cs as (select conv_id as c, count(*) as n, conv_id - conv_id % 100 as base,
  xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint), lambda a, b: xor(a >> 8, any_value(t)[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 6 as h from own, crcs group by conv_id),
rebuilt as (
  select c, pos as depth, role, text from cs join own on conv_id = base and pos <= h
  union all select x.c, least(h, coalesce(b.n, 0)) + pos - h, role, text from cs x join own on conv_id = x.c and pos > h left join (select c, n from cs) b on b.c = x.base),
chained as (select c, depth, length(text) as chars, string_agg(role || chr(31) || text, chr(30)) over (partition by c order by depth rows unbounded preceding) as key from rebuilt union all select c, 0, 0, '' from cs),
linked as (select *, lag(key) over (partition by c order by depth) as up, depth = max(depth) over (partition by c) as last from chained),
nodes as (select depth, key, any_value(up) as up, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved, coalesce(string_agg(c::varchar, ',' order by c) filter (last), '') as ends from linked group by depth, key),
children as (select depth - 1 as depth, up as key, count(*) as n from nodes where depth > 0 group by all),
whole as (select a.depth, a.key, sum(n.saved) as saved, count(*) filter (k.n is null) as leaves from nodes n join chained a on a.c = n.conv_id and a.depth <= n.depth left join children k on k.depth = n.depth and k.key = n.key group by 1, 2)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, w.leaves as n_leaves, w.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join whole w on w.depth = n.depth and w.key = n.key left join children k on k.depth = n.depth and k.key = n.key left join nodes p on p.depth = n.depth - 1 and p.key = n.up
"""

OP12_SQL = """
with words_ as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
said as (select r, lang, source, unnest(w) as term from words_),
kept as (select lang, term, count(*) as lang_n from said group by lang, term having count(distinct r) >= 30),
langs as (select lang, count(k.term) as terms, coalesce(sum(lang_n), 0) as lang_total from (select distinct lang from words_) left join kept k using (lang) group by lang),
grps as (select distinct lang, source from words_),
counts as (select s.lang, s.source, s.term, count(*) as n from said s join kept k on k.lang = s.lang and k.term = s.term group by 1, 2, 3),
full_ as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total, k.lang_n, l.lang_total, l.terms
  from grps g join kept k on k.lang = g.lang join langs l on l.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + (1000000000 * (n + 5)::hugeint) // (total + 5 * terms) as p, 1 + (1000000000 * (lang_n + 5)::hugeint) // (lang_total + 5 * terms) as q from full_),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all select a.lang, a.source, 'pair', b.source, 0 from grps a join grps b on a.lang = b.lang and a.source <> b.source join langs l on l.lang = a.lang where l.terms = 0),
terms_ as (select lang, source, 'term' as part, term as item, p - q as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms_))
select lang, source, part, item, value::bigint as value, rank::integer as rank from ranked where part = 'pair' or rank <= 50
"""

OP13_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.y from reach r join links l on l.x = r.b),
n as (select x, count(*) as n from links group by x)
select e.vec_id, coalesce(any_value(n.n), 0) as n_links, min(r.b) as component_id, e.vec_id = min(r.b) as kept from embeddings e join reach r on r.a = e.vec_id left join n on n.x = e.vec_id group by e.vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_chat_collapse, op3_language_id, op4_decontamination, op5_quality, op6_line_dedup, op7_source_mixing, op8_vantage_search, op9_ngram_join, op10_substring_dedup, op11_conversation_trie, op12_source_divergence, op13_range_join)}


def oracle_sql() -> dict[str, str]:
    """The others learn, draw or search approximately; tests hold them against brute force and held-out rows."""
    return {"op2_chat_collapse": OP2_SQL, "op6_line_dedup": OP6_SQL, "op9_ngram_join": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_range_join": OP13_SQL}
