"""The queries op1 to op13 with production parameters, and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import alignment, fingerprint, jaccard_join, langid, lm_score, mixing, packing, search, sharding, suffix_dedup, token_files, topk, toxicity
from granary.llm.common import documents, word_count
from granary.llm.registry import query
from granary.sources.tables import materialise

OP1 = r"""
with sized as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         -ln((('0x' || substr(md5('mix|' || coalesce(d.doc_id::varchar, '')), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double)
           / case l.q when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end as k
  from documents d left join (select doc_id, max(quality) as q from labels group by doc_id) l on d.doc_id = l.doc_id),
per_source as (
  select source, sum(size)::bigint as total, 3.0::double * sum(size) as cap,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end as w
  from sized group by source),
running as (
  select *, sum(total) over () as t, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as held,
         sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as free
  from per_source),
level as (select arg_min((t - held) / free, cap / w) as lv from running where cap / w >= (t - held) / free),
goal as (select source, total, case when total = 0 or cap < w * lv then cap else w * lv end as target from per_source, level),
placed as (
  select s.*, g.total, g.target, case when g.total > 0 then floor(g.target / g.total) else 0 end as epochs,
         coalesce(sum(s.size) over (partition by s.source order by s.k rows between unbounded preceding and 1 preceding), 0) as before
  from sized s join goal g on s.source is not distinct from g.source)
select doc_id, size, total as source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * total - before)))::bigint as taken
from placed
"""


@query("op1_mix_sources", OP1)
def op1(spark: SparkSession, root: str) -> DataFrame:
    """Labelled quality doubles or halves a document's chance per word; unlabelled documents stand between."""
    labels = spark.read.parquet(f"{root}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q"))
    narrow = materialise(documents(spark, root).select("doc_id", "source", word_count("text").alias("words")), "op1-sizes")
    graded = narrow.join(labels, "doc_id", "left")
    quality = F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0)
    return mixing.mix(graded, F.col("words"), quality).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_shard_minimax")
def op3(spark: SparkSession, root: str) -> DataFrame:
    """Near-equal bytes in 40 shards, equal texts together."""
    raw = F.encode("text", "UTF-8")
    narrow = materialise(documents(spark, root).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("digest")), "op3-sizes")
    placed = sharding.shard(narrow, "size", F.col("digest"), "doc_id", shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_fingerprints")
def op10(spark: SparkSession, root: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, root))


@query("op5_pack_harmonic")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(documents(spark, root), public_tokenizers.path("word_bpe_49k.json"), end=1, capacity=2048, keep_ids=False)


@query("op9_token_files")
def op9(spark: SparkSession, root: str) -> DataFrame:
    manifest, folder = token_files.write(documents(spark, root), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return token_files.read(spark, manifest, folder, keep_ids=False)


@query("op2_language_id")
def op2(spark: SparkSession, root: str) -> DataFrame:
    """Learns from the documents that are not held out; the prediction sees the text alone."""
    docs = documents(spark, root).select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"))
    identifier = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), identifier).select("doc_id", "held_out", "lang_pred", "score", "rejected")


OP8 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select s, doc_id from shingles where s in (select s from shingles group by s having count(*) > 1)),
links as (
  select a.doc_id as a, b.doc_id as b from shared a join shared b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * ((select n from sizes where doc_id = a.doc_id) + (select n from sizes where doc_id = b.doc_id) - count(*))),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, (select min(b) from reach where a = d.doc_id)) as component_id
from documents d left join sizes on sizes.doc_id = d.doc_id
"""


@query("op8_jaccard_join", OP8)
def op8(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, root), words=4, num=85, den=100)


@query("op4_suffix_dedup")
def op4(spark: SparkSession, root: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, root), length=200)


OP6 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
           from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 10
"""


@query("op6_top_k", OP6)
def op6(spark: SparkSession, root: str) -> DataFrame:
    rows = topk.scaled(spark.read.parquet(f"{root}/embeddings.parquet"), "vec_id", "embedding")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


OP7 = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
pairs as (select doc_id, unnest(w) as a, unnest(list_append(w[2:], ' ')) as b from words where len(w) > 0),
own as (select doc_id, a, b, count(*)::bigint as own2 from pairs group by all),
c2 as (select a, b, sum(own2)::bigint as c2 from own group by all),
c1 as (select a as word, sum(c2)::bigint as c1 from c2 group by a union all select ' ', (select sum(c2) from c2 where b = ' ')::bigint),
own1 as (select doc_id, a, sum(own2)::bigint as own1 from own group by all),
n as (select sum(c1) as n from c1),
terms as (
  select o.doc_id, own2, c2 > own2 as hit,
         case when c2 > own2 then own2 * (round(1e6 * ln((c2 - own2)::double)) - round(1e6 * ln((x.c1 - own1)::double)))
              else own2 * (round(1e6 * ln(y.c1::double)) + round(1e6 * ln(0.4::double / n::double))) end as term
  from own o join c2 using (a, b) join own1 using (doc_id, a) join c1 x on x.word = o.a join c1 y on y.word = o.b, n),
sums as (select doc_id, sum(own2)::bigint as n, sum(case when hit then own2 else 0 end)::bigint as hits, sum(term) as s from terms group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(hits, 0)::bigint as n_known, floor(s / n)::bigint as log_score
from documents d left join sums using (doc_id)
"""


@query("op7_lm_score", OP7)
def op7(spark: SparkSession, root: str) -> DataFrame:
    return lm_score.score(documents(spark, root))


@query("op11_align_tokenizers")
def op11(spark: SparkSession, root: str) -> DataFrame:
    return alignment.align(documents(spark, root), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


OP12 = r"""
with terms as (
  select rowid as row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from (select row_number() over () as rowid, doc_id, text from documents)),
tfs as (select row, doc_id, t, count(*)::bigint as tf from terms group by all),
sizes as (select row, sum(tf)::bigint as n from tfs group by row),
corpus as (select count(*)::bigint as nn, sum(n)::bigint as ll from sizes),
weights as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tfs, corpus group by t, nn),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from benchmark),
scored as (
  select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))))::bigint as score
  from asked join weights using (t) join tfs using (t) join sizes using (row), corpus group by item_id, row, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""


@query("op12_ranked_search", OP12)
def op12(spark: SparkSession, root: str) -> DataFrame:
    index = search.build(documents(spark, root))
    return search.search(index, spark.read.parquet(f"{root}/benchmark.parquet"), k=10)


@query("op13_toxicity")
def op13(spark: SparkSession, root: str) -> DataFrame:
    """Learns labels of the documents that are not held out; a prediction sees the text alone."""
    docs = documents(spark, root).select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"))
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "toxic")
    keys = docs.where("not held_out").select("doc_id", toxicity.text_key().alias("key"))
    model = toxicity.train(docs, keys.join(labels, "doc_id").select("key", "toxic"))
    return toxicity.predict(docs, model).select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score", "predicted")
