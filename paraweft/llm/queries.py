"""One query for each operator of this subpackage, over its whole table, and the SQL for those that SQL expresses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paraweft.llm import decontamination as op2
from paraweft.llm import language as op1
from paraweft.llm import licenses as op3
from paraweft.llm import mixing as op4
from paraweft.llm import near_duplicates as op10
from paraweft.llm import pii as op7
from paraweft.llm import quality as op8
from paraweft.llm import token_counts as op9
from paraweft.llm import topk as op5
from paraweft.llm.token_store import TokenStore
from paraweft.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text of ``documents``, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    out = op1.identify(docs, op1.train(docs, third != 1))
    return out.withColumn("held_out", F.coalesce(third == 1, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that stand in ``documents``."""
    return op2.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in ``documents``."""
    return op3.scan(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of 150 percent takes, sources weighing 3, 1, 2 in turn."""
    return op4.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of each 50th of the ``embeddings``."""
    return op5.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def stored_ids(docs: DataFrame) -> DataFrame:
    """Each document's place and checksum in a new token store, as read back from its files."""
    store = TokenStore(docs.sparkSession, Scratch(docs.sparkSession, "token-store").root)
    out = store.write(docs, public_tokenizers.path("byte_bpe_50k.json")).verified()
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "verified")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents``, id 0 after each, written to a content-addressed store and read back."""
    return stored_ids(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents`` and the terms that disclose it."""
    return op7.report(op7.detect(_table(spark, sf_dir, "documents")))


def judged(docs: DataFrame, sf_dir: str, columns: list[str]) -> DataFrame:
    """Documents judged under their source as host and, within it, their language as path."""
    labels = _table(docs.sparkSession, sf_dir, "labels")
    return op8.classify(docs, labels, sites=[F.col("source"), F.col("lang")], columns=columns)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of all ``documents``."""
    return judged(_table(spark, sf_dir, "documents"), sf_dir, ["doc_id"])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``."""
    return op9.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-copies of ``documents`` by 4-word shingles at 80 percent."""
    out = op10.near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_token_store": op6_token_store,
    "op7_pii": op7_pii,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_counts": op9_token_counts,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

#: Words per document, hash order, prefix sums and cuts as in mixing.py, with one row a document throughout.
OP4_SQL = r"""
with rows as (
  select doc_id, coalesce('s' || source, 'n') as grp, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('0:' || coalesce(doc_id::varchar, '')) as key
  from documents
), totals as (
  select grp, source, sum(size)::bigint as total,
    [3, 1, 2][((row_number() over (order by source is null, source)) - 1) % 3 + 1]::bigint as weight
  from rows group by grp, source
), levels as (
  select *, (1.5::double * sum(total) over ()
      - 2 * coalesce(sum(total) over (order by total / weight, grp rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by total / weight, grp rows between current row and unbounded following) as level
  from totals
), plan as (
  select grp, total, target, case when total > 0 then floor(target / total)::bigint else 0 end as whole,
    floor(target)::bigint as whole_words
  from (select grp, total, least(2.0::double * total, weight * max(level) over ()) as target from levels)
), keyed as (
  select r.grp, r.key, sum(r.size)::bigint as g, any_value(p.whole_words - p.whole * p.total) as rest
  from rows r join plan p using (grp) group by r.grp, r.key
), placed as (
  select *, sum(g) over (partition by grp order by key rows between unbounded preceding and current row) as upto from keyed
)
select r.doc_id, r.size, p.total as source_size, p.target,
  (p.whole * r.size + case when k.upto <= k.rest then r.size when k.upto - k.g <= k.rest
    then floor(r.size * (k.rest - k.upto + k.g)::double / k.g) else 0 end)::bigint as taken
from rows r join plan p using (grp) join placed k using (grp, key)
"""

_QUOTE = "'"
_ANCHORS = ", ".join(f"({t}, '{w}', {n}, {len(op3.words_of(op3.TEMPLATES[t][1]))})" for w, ts in sorted(op3.anchors(op3.TEMPLATES, op3.LEAST).items()) for t, n in ts)
#: The passages and templates of licenses.py, every line, paragraph and text tried on every template.
OP3_SQL = rf"""
with templates as (
  select t.n, t.license, list_distinct([t.w[i] || ' ' || t.w[i + 1] for i in range(1, len(t.w))]) as grams from (
    select n, license, list_filter(string_split(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') as w
    from (values {", ".join(f"({n}, '{name}', '{body.replace(_QUOTE, _QUOTE * 2)}')" for n, (name, body) in enumerate(op3.TEMPLATES))}) as v(n, license, body)) t
), units as (
  select doc_id, i - 1 as line, lines[i] as unit from (select doc_id, string_split(text, chr(10)) as lines from documents), unnest(range(1, len(lines) + 1)) as u(i)
  union all
  select distinct doc_id, -1 as line, unit from (
    select doc_id, unnest(list_append(string_split_regex(text, '
\s*
'), text)) as unit from documents) where contains(unit, chr(10))
), words as (
  select doc_id, line, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') as w from units
), grams as (
  select doc_id, line, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as grams from words where len(w) > 1
), texts as (
  select doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') as w from documents
), anchors as (
  select * from (values {_ANCHORS}) as v(n, word, before, size)
), windows as (
  select distinct doc_id, n, size, greatest(i - 1 - before, 0) as start from (select doc_id, w[i] as word, i from texts, unnest(range(1, len(w) + 1)) as u(i)) join anchors using (word)
), cut as (
  select doc_id, n, w[start + 1:start + size] as v from windows join texts using (doc_id)
), scored as (
  select g.doc_id, g.line, t.license, 2.0::double * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) as dice
  from grams g, templates t where len(g.grams) between len(t.grams) * 0.6 and len(t.grams) / 0.6
  union all
  select c.doc_id, -1, t.license, 2.0::double * len(list_intersect(c.g, t.grams)) / (len(c.g) + len(t.grams))
  from (select doc_id, n, list_distinct([v[i] || ' ' || v[i + 1] for i in range(1, len(v))]) as g from cut) c join templates t using (n)
)
select doc_id, license, max(dice) as dice, count(distinct line)::bigint as passages,
  coalesce(min(line) filter (line >= 0), -1)::integer as first_line
from scored where dice >= 0.8 group by doc_id, license
"""

OP5_SQL = """
with whole as (
  select vec_id, [floor(256::double * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), queries as (
  select vec_id, min(v) as v from whole where vec_id % 50 = 0 group by vec_id
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from queries q join whole c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
)
select query_id, rank::integer as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 5
"""

#: Every pair of documents that shares a shingle, and all that can be reached from each.
OP10_SQL = r"""
with recursive words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as u(i) where len(w) > 0
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * s.n >= 80 * (x.n + y.n - s.n)
), ways as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id, doc_id as other from documents union select r.doc_id, b.b from reach r join ways b on b.a = r.other
), least as (
  select doc_id, min(other) as component_id from reach group by doc_id
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join least using (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": OP3_SQL,
    "op4_mix_sources": OP4_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
}
