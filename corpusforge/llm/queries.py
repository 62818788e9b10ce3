"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.llm import (bpe, brown, collocations, html_tree, hyperplanes, lexical, mixing, quality,
                             repeats, simhash, urls, vafile, wordpiece)
from corpusforge.llm.common import table


def op1_quality_mil(spark, sf):
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


#: The list of the query: host, path prefix, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow"))


def op2_url_rules(spark, sf):
    return urls.judge(table(spark, sf, "pages"), "page_id", "url", URL_RULES)


def op3_va_top_k(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.where(vafile.usable(F.col("embedding"))).select("vec_id", F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return vafile.top_k(e, "vec_id", "v", F.col("vec_id") % 50 == 0, k=5)


def op4_mix_sources(spark, sf):
    m = mixing.mix(table(spark, sf, "documents"), "doc_id", "source", "text")
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_near_embeddings(spark, sf):
    return hyperplanes.near_groups(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", threshold=0.98)


def op6_simhash_groups(spark, sf):
    return simhash.simhash_groups(table(spark, sf, "documents"), "doc_id", "text", shingle=3, max_distance=3)


def op7_main_text(spark, sf):
    return html_tree.extract(table(spark, sf, "pages"), "page_id", "url", "html")


def op8_byte_bpe(spark, sf):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf, "documents"), "doc_id", "text", path, public_tokenizers.PATTERN, decoded="bytes")
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_token_counts(spark, sf):
    import public_tokenizers
    return wordpiece.token_counts(table(spark, sf, "documents"), "doc_id", "text",
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_repeated_windows(spark, sf):
    out = repeats.remove_repeats(table(spark, sf, "documents"), "doc_id", "text", threshold=400)
    return out.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"))


def op11_lexical_search(spark, sf):
    return lexical.search(table(spark, sf, "documents"), "doc_id", "text",
                          table(spark, sf, "benchmark"), "item_id", "text", k=50)


def op12_class_lm(spark, sf):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return brown.score(table(spark, sf, "documents"), "doc_id", "text", held)


def op13_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"), "lang", "text", longest=3, least=10, share=50, k=2000)


QUERIES = {f.__name__: f for f in (
    op1_quality_mil, op2_url_rules, op3_va_top_k, op4_mix_sources, op5_near_embeddings, op6_simhash_groups,
    op7_main_text, op8_byte_bpe, op9_token_counts, op10_repeated_windows, op11_lexical_search,
    op12_class_lm, op13_collocations)}

#: Sampling rank, offset and size classes are those of ``mixing``.
MIX_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') src, source is null nul,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint h
  from documents),
n as (select greatest(1, ceil(sqrt(count(*))))::bigint nb from d),
e as (
  select d.*, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 4, 0)) cls, h % nb blk
  from d, n),
s as (select src, nul, sum(size)::bigint source_size from e group by all),
w as (select *, [1, 2, 3][((row_number() over (order by nul, src) - 1) % 3 + 1)::int]::bigint w from s),
l as (
  select *, 3.0::double * source_size cap, 3.0::double * source_size / w lim from w),
o as (
  select *, row_number() over r pos,
         coalesce(sum(source_size) over (order by lim, nul, src rows between unbounded preceding and 1 preceding), 0)::double before,
         sum(w) over (order by lim, nul, src rows between current row and unbounded following) rest,
         sum(source_size) over () total
  from l window r as (order by lim, nul, src)),
v as (select *, (total::double - 3.0::double * before) / rest lev from o),
f as (select arg_min(lev, pos) filter (where lev <= lim) level from v),
t as (select src, nul, source_size, least(cap, level * w) target from v, f),
r as (
  select e.*, source_size, target,
         case when source_size > 0 then target / source_size else 0.0::double end rate,
         row_number() over (partition by src, nul order by cls, blk, size, doc_id)::double k,
         ('0x' || substr(md5('mix' || case when nul then '0' else '1' end || src), 1, 5))::bigint / 1048576.0::double u
  from e join t using (src, nul))
select doc_id, size, source_size, target,
       ((floor(rate * k + u) - floor(rate * (k - 1) + u))::bigint * size)::bigint taken
from r
"""

TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id,
         list_inner_product(q.v::double[], c.v::double[])::bigint score
  from v q join v c on q.vec_id <> c.vec_id and q.vec_id % 50 = 0),
r as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

SEARCH_SQL = r"""
with t as (
  select doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
  from documents),
f as (select doc_id, term, count(*)::bigint tf from t group by all),
d as (select doc_id, sum(tf)::bigint n from f group by all),
a as (select count(*)::bigint docs, sum(n)::bigint terms from d),
m as (select doc_id, 50 + (50 * n * docs) // terms m from d, a),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint w from f, a group by term),
i as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
  from benchmark),
s as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score
  from i join w using (term) join f using (term) join m using (doc_id) group by all),
r as (
  select *, (row_number() over (partition by item_id order by score desc, doc_id))::int rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
"""

PHRASE_SQL = r"""
with p as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
s as (
  select lang, ws, unnest(range(1, len(ws) + 1)) i from w),
o as (
  select lang, m size, array_to_string(ws[i:i + m - 1], ' ') phrase
  from s, (select unnest([1, 2, 3]) m) where i + m - 1 <= len(ws)),
f as (select lang, size, phrase, count(*)::bigint f from o group by all),
t as (select lang, sum(f)::bigint n from f where size = 1 group by lang),
c as (select lang, size, phrase, f a from f where size > 1 and f >= 10),
k as (
  select lang, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') fst,
         array_to_string(string_split(phrase, ' ')[cut + 1:size], ' ') rst
  from c, (select unnest([1, 2]) cut) where cut < size),
x as (
  select k.*, l.f l, r.f r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint score
  from k join f l on l.lang = k.lang and l.phrase = fst join f r on r.lang = k.lang and r.phrase = rst),
b as (select * from x qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
g as (
  select lang, max(a) longer, sub phrase
  from (select lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
                                array_to_string(string_split(phrase, ' ')[2:3], ' ')]) sub from c where size = 3)
  group by lang, sub),
q as (select b.* from b left join g using (lang, phrase) where longer is null or 100 * longer < 50 * a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint rank from q)
select lang, rank, phrase, a, l, r, n, score from z join t using (lang) where rank <= 2000
"""

ORACLE = {"op13_collocations": PHRASE_SQL, "op11_lexical_search": SEARCH_SQL, "op3_va_top_k": TOP_K_SQL, "op4_mix_sources": MIX_SQL}
