"""The ``opN_<name>`` queries with production parameters, and the SQL that expresses them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.llm.clusters import cluster_vectors
from corvia.llm.codes import compress_vectors
from corvia.llm.common import read
from corvia.llm.cosine import cosine_near_dup
from corvia.llm.debruijn import drop_repeated_spans
from corvia.llm.exact import exact_dedup
from corvia.llm.html import extract_pages
from corvia.llm.lines import drop_recurring_lines
from corvia.llm.mixing import mix_sources
from corvia.llm.packing import best_fit_pack
from corvia.llm.quality import classify_quality
from corvia.llm.simhash import simhash_near_dup
from corvia.llm.suffixes import drop_earlier_strings
from corvia.llm.topk import top_k


def op1_topk_pivot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), max_rows=40_000)
    return found.select("doc_id", "held_out", "score", "predicted")


def op3_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op4_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_near_dup(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring_lines(read(spark, sf_dir, "documents"), min_docs=3, depth=3, min_tokens=5, min_constant=0.6, short_lines=True)
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op6_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"), window=35).drop("kept")


def op7_subspace_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_near_dup(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


def op8_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), alpha=0.5, size=1.0, seed=42).select("doc_id", "source", "copy", "shuffle_key", "text")


def op10_suffix_grouping_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_earlier_strings(read(spark, sf_dir, "documents").select("doc_id", "text"), length=50).drop("kept")


def op11_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op12_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"), dims=64, scale=64, k=16, rounds=3, seed=1)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read(spark, sf_dir, "embeddings"), scale=1024, parts=4, entries=256, rounds=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_pivot_distance": op1_topk_pivot_distance,
    "op2_quality_gam": op2_quality_gam,
    "op3_html_tree_scoring": op3_html_tree_scoring,
    "op4_simhash_near_dup": op4_simhash_near_dup,
    "op5_line_dedup": op5_line_dedup,
    "op6_debruijn_substring_dedup": op6_debruijn_substring_dedup,
    "op7_subspace_near_dup": op7_subspace_near_dup,
    "op8_best_fit_pack": op8_best_fit_pack,
    "op9_mix_sources": op9_mix_sources,
    "op10_suffix_grouping_dedup": op10_suffix_grouping_dedup,
    "op11_cuckoo_exact_dedup": op11_cuckoo_exact_dedup,
    "op12_block_norm_clusters": op12_block_norm_clusters,
    "op13_vector_codes": op13_vector_codes,
}

OP1_SQL = """
with ints as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from ints q join ints c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
"""

#: The leaves, templates and recurring lines of op5, with lists in place of hashes.
OP5_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents
), split_lines as (
  select doc_id, no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as t from lines
), parsed as (
  select doc_id, no, line, case when len(t) < 5 then t else list_transform(t, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) end as t from split_lines
), long_lines as (
  select distinct doc_id, t, [len(t)::varchar] || t[1:3] as leaf from parsed where len(t) >= 1
), held as (
  select * from long_lines where leaf in (select leaf from long_lines group by leaf having count(distinct doc_id) >= 3)
), distinct_lines as (
  select leaf, t, count(*) as n from held group by leaf, t
), cells as (
  select leaf, t, n, unnest(t) as token, generate_subscripts(t, 1) as place from distinct_lines
), stays as (
  select leaf, place, token from cells group by leaf, place, token having sum(n) >= 3
), shapes as (
  select c.leaf, c.t, list(case when s.token is not null then c.token else '<*>' end order by c.place) as shape,
         avg(case when s.token is not null and c.token <> '<*>' then 1.0 else 0.0 end) as constant
  from cells c left join stays s on c.leaf = s.leaf and c.place = s.place and c.token = s.token group by c.leaf, c.t
), used as (
  select h.doc_id, h.t, case when s.constant >= 0.6 and len(h.t) >= 5 then ['general'] || s.shape else ['own'] || s.t end as template, h.leaf
  from held h join shapes s on h.leaf = s.leaf and h.t = s.t
), recurring as (
  select leaf, template, min(doc_id) as first from used group by leaf, template having count(distinct doc_id) >= 3
), drops as (
  select distinct u.doc_id, u.t from used u join recurring r on u.leaf = r.leaf and u.template = r.template where u.doc_id <> r.first
), marked as (
  select p.doc_id, p.no, p.line, d.t is not null as gone from parsed p left join drops d on p.doc_id = d.doc_id and p.t = d.t
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by no) filter (not gone), '') as text
from marked group by doc_id
"""

OP9_SQL = """
with own as (
  select source, sum(greatest(length(text), 1))::double as have from documents group by source
), means as (
  select source, sqrt(have) * sum(have) over () / (sum(sqrt(have)) over () * have) as mean from own
), shares as (
  select source, greatest(ceil(mean / 16), 1)::int as parts, mean / greatest(ceil(mean / 16), 1) as share from means
), drawn as (
  select doc_id, d.source, text, ('0x' || substr(md5(case when part = 1 then '42:' || doc_id else '42/part:' || doc_id || ':' || part end), 1, 13))::bigint / 4503599627370496.0 as u
  from documents d join shares s on d.source is not distinct from s.source, unnest(range(1, s.parts + 1)) as p(part)
), terms as (
  select source, k, sum(p) over (partition by source order by k) as below
  from (select source, k, exp(-share + k * ln(share) - lgamma(k + 1)) as p from shares, range(0, 65) r(k))
), counted as (
  select d.doc_id, d.source, d.text, sum((select count(*) from terms t where t.source = d.source and t.below <= d.u))::bigint as n from drawn d group by all
), copies as (
  select doc_id, source, unnest(range(0, n))::int as copy, text from counted where n > 0
)
select doc_id, source, copy, ('0x' || substr(md5('42/shuffle:' || doc_id || ':' || copy), 1, 13))::bigint / 4503599627370496.0 as shuffle_key, text from copies
"""

OP11_SQL = r"""
with own as (
  select doc_id, coalesce(text, '') as t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents
), ranked as (
  select *, row_number() over (partition by text_sha256 order by length(t) desc, doc_id) as n, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over (partition by text_sha256 order by length(t) desc, doc_id) as keep_id from own
)
select doc_id, keep_id, group_size, n = 1 as kept, text_sha256 from ranked
"""


def _floor_mean(total: str, n: str) -> str:
    return f"(({total}) - ((({total}) % {n} + {n}) % {n})) // {n}"


def _op12_sql(dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """One round after another over long tables of components; a squared distance is a sum over components."""
    parts = [f"""ints as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), places as (
  select unnest(range(1, {dims} + 1)) as place
), c0 as materialized (
  select n - 1 as cluster, v as c from (select v, row_number() over (order by sha256('{seed}:' || vec_id), v) as n from ints) where n <= {k}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""near{r} as materialized (
  select vec_id, v, cluster, distance from (
    select i.*, c.cluster, list_sum(list_transform(list_zip(i.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from ints i, c{r} c
  ) qualify row_number() over (partition by vec_id order by distance, cluster) = 1
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} as materialized (
  select cluster, coalesce(m, c) as c from c{r} left join (
    select cluster, list(m order by place) as m from (select cluster, place, {_floor_mean("sum(v[place])::bigint", "count(*)")} as m from near{r}, places group by cluster, place) group by cluster
  ) using (cluster)
)""")
    return f"""
with {", ".join(parts)}
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from near{rounds} join c{rounds} using (cluster)
"""


def _op13_sql(scale: int = 1024, parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Squared distances through inner products of doubles, which are exact at this size."""
    each = [f"""ints as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cut as materialized (
  select vec_id, part, v[part * {width} + 1 : (part + 1) * {width}] as x from ints, range(0, {parts}) p(part)
), places as (
  select unnest(range(1, {width} + 1)) as place
), b0 as materialized (
  select part, n - 1 as entry, x as b from (select part, x, row_number() over (partition by part order by vec_id) as n from cut) where n <= {entries}
)"""]
    for r in range(rounds + 1):
        each.append(f"""near{r} as materialized (
  select vec_id, part, x, entry, distance from (
    select c.*, b.entry, list_dot_product(c.x, c.x) - 2 * list_dot_product(c.x, b.b) + list_dot_product(b.b, b.b) as distance from cut c join b{r} b using (part)
  ) qualify row_number() over (partition by vec_id, part order by distance, entry) = 1
)""")
        if r < rounds:
            each.append(f"""b{r + 1} as materialized (
  select part, entry, coalesce(m, b) as b from b{r} left join (
    select part, entry, list(m order by place) as m from (select part, entry, place, floor(sum(x[place]) / count(*)) as m from near{r}, places group by part, entry, place) group by part, entry
  ) using (part, entry)
)""")
    return f"""
with {", ".join(each)}, coded as (
  select vec_id, string_agg(lpad(to_hex(entry::int)::varchar, 2, '0'), '' order by part) as code, sum(distance)::bigint as error from near{rounds} group by vec_id
), book as (
  select sha256(string_agg(array_to_string(list_transform(b, lambda x: x::bigint), ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds}
)
select vec_id, lower(code) as code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join ints using (vec_id), book
"""


OP12_SQL, OP13_SQL = _op12_sql(), _op13_sql()

ORACLE_SQL: dict[str, str] = {
    "op1_topk_pivot_distance": OP1_SQL,
    "op5_line_dedup": OP5_SQL,
    "op9_mix_sources": OP9_SQL,
    "op11_cuckoo_exact_dedup": OP11_SQL,
    "op12_block_norm_clusters": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
