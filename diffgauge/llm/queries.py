"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffgauge.llm import (dac, decontaminate, importance, katz, licenses, ngram_join, packing, prefix_trie, quality,
                            resharding, secret_scan, topk, toxicity)
from diffgauge.llm.common import remainder, table
from diffgauge.llm.units import dropped_spaces, leading_spaces
from diffgauge.session import scratch_dir, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plan(ship(spark), folder)
    QUERIES[plan.__name__] = run
    return plan


@query
def op1_direct_codes(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark)
    dac.write_store(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"),
                    dropped_spaces, end_id=2)
    return dac.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), leading_spaces, end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "boundary")


@query
def op4_concatenate_and_cut(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


@query
def op6_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query
def op7_windowed_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


@query
def op2_flow_resharding(spark: SparkSession, folder: str) -> DataFrame:
    old = resharding.lay_out(table(spark, folder, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    new, _ = resharding.reshard(old, 24)
    return resharding.slots(new).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_segment_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op9_segment_bounds"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
           from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
           from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def quality_model(docs: DataFrame, spark: SparkSession, folder: str) -> quality.Model:
    """Learned only from labels whose remainder is not 2."""
    return quality.train(docs, table(spark, folder, "labels"), remainder(F.col("doc_id"), 4) != 2)


@query
def op10_attention_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = quality.score(docs, quality_model(docs, spark, folder))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                       (F.col("score") >= quality.KEEP).cast("int").alias("predicted"), "n_passages", "top_passage")


@query
def op5_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = ngram_join.join(table(spark, folder, "documents"))
    return rows.select("doc_id", "class_id", "text_class", "n_links", "n_grams")


@query
def op8_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = katz.score(table(spark, folder, "documents"), remainder(F.col("doc_id"), 5) == 1)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_bit_sliced_resampling(spark: SparkSession, folder: str) -> DataFrame:
    rows = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


# CRC-32 of a blob's hex digits: two steps a byte, the low half first. The 16 steps are fixed values.
CRC_STEPS = """[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes."""
    digits = f"hex(encode({text}))"
    halves = (f"list_transform(range(1, 1 + length({digits})), lambda i: "
              f"strpos('0123456789ABCDEF', substr({digits}, (CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END)::bigint, 1)) - 1)")
    return (f"xor(4294967295, list_reduce({halves}, lambda c, x: "
            f"xor(c >> 4, {CRC_STEPS}[1 + (xor(c, x) & 15)]), 4294967295::bigint))")


ORACLES["op11_bit_sliced_resampling"] = f"""
with texts as (select 'd' as side, row_number() over () as row, doc_id, text from documents
               union all select 'b', row_number() over (), null, text from benchmark),
     parts as (select side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
     runs as (select side, row, unnest(list_concat(w,
                 list_transform(range(1, len(w)::bigint), lambda i: w[i] || ' ' || w[i + 1]),
                 list_transform(range(1, len(w)::bigint - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f
              from parts),
     counted as (select side, row, f, count(*) as n from runs group by all),
     hashed as (select f, {crc_sql("f")} % 10000 as b from (select distinct f from counted)),
     placed as (select side, row, b, n from counted join hashed using (f)),
     s as (select b, sum(n)::double as n from placed where side = 'd' group by b),
     t as (select b, sum(n)::double as n from placed where side = 'b' group by b),
     g as (select r.b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0) from s) + 10000))
                    / ((coalesce(s.n, 0) + 1) * ((select coalesce(sum(n), 0) from t) + 10000))))::bigint as gain
           from range(10000) r(b) left join s using (b) left join t using (b)),
     weights as (select row, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight
                 from placed join g using (b) where side = 'd' group by row),
     scored as (select doc_id, len(w)::bigint as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                       coalesce(weight, 0) + floor(-1000 * ln(-ln((
                         ('0x' || left(sha256('42:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5::double)
                         / 4294967296)))::bigint as score
                from parts left join weights using (row) where side = 'd'),
     ordered as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as r,
                        count(*) filter (where n_words >= 20) over () as able from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= able * 5 // 100 then r end as rank, n_words
from ordered
"""


@query
def op12_halving_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


ORACLES["op12_halving_prefix_trie"] = f"""
with t as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                               order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as l
           from conversations where conv_id is not null group by conv_id),
     c as (select conv_id, conv_id - conv_id % 100 as base, l, {crc_sql("conv_id::varchar")} % 6 as h from t),
     r as (select c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) as l
           from c left join t b on b.conv_id = c.base),
     m as (select conv_id, len(l) as n, unnest(range(0, 1 + len(l)::bigint)) as d, l from r),
     p as (select d, l[1:d] as p, conv_id, n = d as ends from m),
     g as (select d, p, min(conv_id) as conv_id, count(*) as n_convs,
                  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
           from p group by d, p),
     k as (select p[1:d - 1] as p, count(*) as n_children from g where d > 0 group by all),
     v as (select g.*, coalesce(n_children, 0) as n_children, case when n_children is null then 1 else 0 end as leaf,
                  case when d = 0 then 0 else (n_convs - 1) * length(p[d].t) end as saved from g left join k using (p)),
     a as (select unnest(range(0, 1 + d)) as up, p, leaf, saved from v),
     s as (select up as d, p[1:up] as p, sum(leaf) as n_leaves, sum(saved) as saved_tokens from a group by all)
select v.conv_id, v.d as depth, u.conv_id as parent_conv_id, v.n_convs, v.n_children, s.n_leaves::bigint as n_leaves,
       s.saved_tokens::bigint as saved_tokens, v.ends_sha256
from v join s on v.d = s.d and v.p = s.p left join g u on u.d = v.d - 1 and u.p = v.p[1:v.d - 1]
"""


@query
def op13_unlabelled_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"), remainder(F.col("doc_id"), 4) != 2)
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                       (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"), "n_marks")
