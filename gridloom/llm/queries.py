"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, minhash, mixing, pii, ppm, repeats, simhash, tokenfile, topk, urls
from .common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; it's a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.choose(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_suffix_array_dedup, op3_minhash, op4_language_id, op5_simhash_dedup, op6_token_binary, op7_byte_bpe, op8_pii, op9_topk_threshold, op10_mix_budget)}


#: Exact below 2**53, which inner products of embeddings (components near 1) are.
TOP_K = """with v as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.row as row, q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 100 = 0 and q.row <> c.row),
r as (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10"""


#: Texts as hexadecimal digits, in segments of 1000 bytes; a string of 50 bytes is late if a smaller doc_id has it too.
REPEATS = """with d as (select row_number() over () as row, doc_id, coalesce(doc_id, -9223372036854775808) as o, hex(encode(coalesce(text, ''))) as h from documents),
seg as (select row, o, b, substr(h, 2000 * b + 1, 2098) as t from (select *, unnest(range(cast(ceil(length(h) / 2000.0) as bigint))) as b from d)),
strings as (select row, o, 1000 * b + k as i, substr(t, 2 * k + 1, 100) as s from (select *, unnest(range(least(1000, greatest(0, length(t) // 2 - 49)))) as k from seg)),
firsts as (select s, min(o) as m from strings group by s),
late as (select row, i from strings join firsts using (s) where m < o),
fresh as (select row, i, case when i <= lag(i) over (partition by row order by i) + 50 then 0 else 1 end as f from late),
runs as (select row, i, sum(f) over (partition by row order by i) as g from fresh),
spans as (select row, min(i) as a, max(i) + 50 as z from runs group by row, g),
pieces as (select row, a, z, substr(h, 2 * coalesce(lag(z) over w, 0) + 1, 2 * (a - coalesce(lag(z) over w, 0))) as p from spans join d using (row) window w as (partition by row order by a)),
kept as (select row, sum(z - a) as removed, count(*) as n, max(z) as z, string_agg(p, '' order by a) as p from pieces group by row)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
 sha256(unhex(coalesce(p, '') || substr(h, 2 * coalesce(z, 0) + 1))) as kept_sha256 from d left join kept using (row)"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the tests hold the others against brute force."""
    return {"op2_suffix_array_dedup": REPEATS, "op9_topk_threshold": TOP_K}
