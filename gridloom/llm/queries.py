"""The operators as queries over the whole tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.gam_quality import quality_scores
from gridloom.llm.host_quality import MEASURES, host_quality
from gridloom.llm.max_score import max_score_search
from gridloom.llm.mixing import mix_sources
from gridloom.llm.prob_minhash import near_duplicates
from gridloom.llm.rank_bpe import bpe_digest, tokenizer_spec
from gridloom.llm.secret_scan import digest, secret_scan
from gridloom.llm.sentence_spans import cut_repeats
from gridloom.llm.tool_links import REPLY_SCHEMA, calls_of_turns, link_tool_calls
from gridloom.llm.url_filter import url_verdicts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """Path of the public word-level vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def op2_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_texts", "kept")


def op3_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_tool_calls(*calls_of_turns(table(spark, sf_dir, "conversations")), REPLY_SCHEMA)
    return linked.select(F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), "turn", "name", "level", "linked", "valid", "json")


def op4_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score_search(table(spark, sf_dir, "embeddings"), F.pmod("_id", F.lit(20)) == 0)


def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("_key")


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(table(spark, sf_dir, "documents")))


def op7_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), tokenizer_spec(word_vocabulary()))


def op8_url_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op9_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_host_quality, op2_prob_minhash, op3_tool_links, op4_max_score, op5_sainte_lague_mix, op6_secret_ownership, op7_rank_bpe, op8_url_regression, op9_gam_quality, op10_sentence_spans)
}

# The host rates of the tables lie far from the limits, so the order in which a database sums doesn't show in the verdicts.
_OP1 = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as p from (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d)),
x as (select rid, p, w, lead(w) over o as w2, lead(w, 2) over o as w3 from w window o as (partition by rid order by p)),
often as (select rid, p from (select rid, p, count(*) over (partition by rid, w, w2, w3) as n from x where w3 is not null) where n > 1),
rep as (select rid, count(distinct p + k) as n from often, (values (0), (1), (2)) t(k) group by rid),
m as (select d.rid, doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines,
  coalesce(rep.n, 0)::bigint as n_repeat_words from d left join rep on rep.rid = d.rid),
f as (select *, (n_words < 50)::int as f1, (100 * n_repeat_words > 50 * n_words)::int as f2, (n_symbols > 0.1 * greatest(n_words, 1))::int as f3,
  (word_chars < 2 * greatest(n_words, 1) or word_chars > 20 * greatest(n_words, 1))::int as f4, (10 * n_dup_lines > greatest(n_words, 1))::int as f5 from m),
h as (select source, r, count(*) as n, sum(v) as v from (select source, unnest([1, 2, 3, 4, 5]) as r, unnest([f1, f2, f3, f4, f5]) as v from f) group by source, r),
p as (select r, (sum(v) + 0.5) / (sum(n) + 1) as mu, var_pop(v / n) as va, avg(1.0 / n) as inv from h group by r),
s as (select r, mu, case when va - mu * (1 - mu) * inv > 0 then least(greatest(mu * (1 - mu) / (va - mu * (1 - mu) * inv) - 1, 2), 10000) else 10000 end as str from p),
q as (select source, n + str as m, (v + mu * str) / (n + str) as rate, greatest(3 * mu / (1 + 2 * mu), 0.25) as top from h join s using (r)),
ok as (select source, bool_and(rate - 2 * sqrt(rate * (1 - rate) / (m + 1)) <= top) as ok from q group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 = 1 or f2 = 1) as base_failed, (f1 = 0 and f2 = 0 and ok) as kept
from f join ok on f.source is not distinct from ok.source
"""

_OP3 = """
with u as (select conv_id, turn, text from conversations where role = 'user'),
d as (select *, lag(turn) over (partition by conv_id, turn % 2 order by turn) as before from (select distinct conv_id, turn from u)),
i as (select *, sum((before is null or turn - before > 4)::int) over (partition by conv_id, turn % 2 order by turn) as run from d),
l as (select conv_id, turn, (row_number() over (partition by conv_id, turn % 2, run order by turn) - 1)::int as level from i)
select u.conv_id, u.conv_id || ':' || u.turn as call_id, u.turn, 'reply' as name, l.level, a.turn is not null as linked, coalesce(length(u.text) between 1 and 300, false) and u.turn >= 0 as valid,
  '{"arguments":{"text":' || coalesce(to_json(u.text)::varchar, 'null') || ',"turn":' || u.turn || '},"id":"' || u.conv_id || ':' || u.turn || '","name":"reply","result":' || coalesce(to_json(a.text)::varchar, 'null') || '}' as json
from u join l using (conv_id, turn) left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
"""

_OP4 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

ORACLE_SQL = {"op1_host_quality": _OP1, "op3_tool_links": _OP3, "op4_max_score": _OP4}
