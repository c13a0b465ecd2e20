"""Queries on order: line changes, ordered digests, tracked masks, nested blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.functions.edits import MASKS, masked_with_span
from corvia.operators.blocks import block_lines
from corvia.operators.lines import line_differences
from corvia.operators.order import BASE, PRIME, ordered_digest
from corvia.operators.rules import first_survivors, rule_matches
from corvia.plans.catalog import DEFAULT
from corvia.plans.matching import FIRED, MATCHES, q, sql_spans
from corvia.plans.registry import Tables, query

_LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from documents"
_TRIMMED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"


@query(f"""with l as ({_LINES}), o as (select *, regexp_matches(line, '[0-9]') as gone, not regexp_matches(line, '[0-9]') and contains(line, ',') as changed from l),
n as (select *, row_number() over (partition by doc_id order by no) - 1 as place from o where not gone)
select doc_id, 'removed' as side, no::int as line_no, {_TRIMMED} as line from o where gone or changed union all
select doc_id, 'added', place::int, {_TRIMMED} || ' <*changed*>' from n where changed""")
def line_changes(t: Tables) -> DataFrame:
    """The lines that a new version removes and adds, with their places; it drops lines with digits and marks those with a comma."""
    old = F.split("text", "\n", -1)
    new = F.transform(F.filter(old, lambda x: ~x.rlike("[0-9]")), lambda x: F.when(x.contains(","), F.concat(x, F.lit(" <*changed*>"))).otherwise(x))
    return t.documents.select("doc_id", F.explode(line_differences(old, new)).alias("d")).select("doc_id", "d.*")


_HASH = "('0x' || substr(sha256('=' || {}), 1, 15))::bigint::hugeint"


@query(f"select count(*) as n, list_reduce(list_prepend(0::hugeint, list({_HASH.format('text')} order by doc_id)), lambda a, b: (a * {BASE} + b) % {PRIME})::bigint as digest from documents")
def ordered_digest_of_documents(t: Tables) -> DataFrame:
    """A digest of all texts in the order of their ids."""
    return ordered_digest(t.documents, ["doc_id"], F.col("text"))


def sql_tracked() -> str:
    """Masks one after the other; a span moves by the edits before it and takes the bounds of one that it begins or ends in."""
    parts = [f'{MATCHES}, {FIRED}, t0 as (select doc_id, text from documents), s0 as (select doc_id, rule_id, start, "end" from fired)']
    for k, (pattern, new) in enumerate(MASKS):
        new = q(new.replace("$1", "\\1"))
        parts.append(f"""{sql_spans([pattern], f"m{k}", f"t{k}")}, e{k} as (select doc_id, start, "end", length(regexp_replace(txt, {q(pattern)}, {new})) as size from m{k}),
s{k + 1} as materialized (
  select s.doc_id, s.rule_id, (s.start + coalesce(sum(e.size - e."end" + e.start) filter (e."end" <= s.start), 0) + coalesce(max(e.start - s.start) filter (e.start < s.start and s.start < e."end"), 0))::int as start,
    (s."end" + coalesce(sum(e.size - e."end" + e.start) filter (e."end" <= s."end"), 0) + coalesce(max(e.start + e.size - s."end") filter (e.start < s."end" and s."end" < e."end"), 0))::int as "end"
  from s{k} s left join e{k} e using (doc_id) group by s.doc_id, s.rule_id, s.start, s."end"
), t{k + 1} as materialized (select doc_id, regexp_replace(text, {q(pattern)}, {new}, 'g') as text from t{k})""")
    n = len(MASKS)
    return f"""with {", ".join(parts)} select doc_id, rule_id, start, "end", substr(text, start + 1, "end" - start) as txt from s{n} join t{n} using (doc_id)"""


@query(sql_tracked())
def tracked_masks(t: Tables) -> DataFrame:
    """Where each finding stands in the masked text, and what stands there: the mask, if it was masked."""
    found = first_survivors(rule_matches(t.documents, DEFAULT)).select("doc_id", "rule_id", "start", "end").join(t.documents.select("doc_id", "text"), "doc_id")
    return masked_with_span(found, "text", "start", "end").select("doc_id", "rule_id", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("txt"))


@query("""with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag, case when l_linestatus = 'O' then '' else l_linestatus end, l_quantity::int::varchar) as nth from lineitem), parts as (
  select o_orderkey, [0] as place, 'order ' || o_orderkey as line from orders
  union all select o_orderkey, [2], o_orderpriority from orders where o_orderkey % 2 = 0
  union all select o_orderkey, [1, 0], o_orderpriority from orders where o_orderkey % 2 <> 0
  union all select l_orderkey, [1, 1, nth], case when l_linestatus = 'O' then l_returnflag || ': ' || l_quantity::int else l_returnflag || ' | ' || l_linestatus || ' | ' || l_quantity::int end from l join orders on l_orderkey = o_orderkey
  union all select l_orderkey, [3, nth, 0], 'line ' || l_linenumber from l join orders on l_orderkey = o_orderkey
  union all select l_orderkey, [3, nth, 1], '(note: part ' || l_partkey || ')' from l join orders on l_orderkey = o_orderkey
) select o_orderkey, (row_number() over (partition by o_orderkey order by place) - 1)::int as line_no, line from parts""")
def nested_blocks(t: Tables) -> DataFrame:
    """Orders as documents: a heading, a table of the items with its caption above or below, and the items once more, each nested in the one before; as lines in reading order."""
    cells = F.when(F.col("l_linestatus") == "O", F.array("l_returnflag", F.lit(""), F.col("l_quantity").cast("int").cast("string"))).otherwise(F.array("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")))
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", cells.alias("cells")))).alias("items"))
    head = '{"type": "paragraph", "text": "line %d", "note": "part %d", "children": ['
    chain = F.concat(F.array_join(F.transform("items", lambda x: F.format_string(head, x["l_linenumber"], x["l_partkey"])), ""), F.lit('{"type": "separator"}'), F.repeat(F.lit("]}"), F.size("items")))
    table = F.to_json(F.struct(F.col("o_orderpriority").alias("caption"), (F.col("o_orderkey") % 2 == 0).alias("captionBelow"), F.col("items.cells").alias("cells")))
    plain = F.concat(F.lit('[{"type": "heading", "text": "order '), F.col("o_orderkey").cast("string"), F.lit('"}, {"type": "image", "children": [{"type": "table", "table": '), table, F.lit("}]}, "), chain, F.lit("]"))
    docs = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    return block_lines(docs.select("o_orderkey", F.parse_json(plain).alias("blocks")), "o_orderkey", "blocks")
