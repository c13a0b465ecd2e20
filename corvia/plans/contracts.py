"""Contracts in full: review events, queues, reports against what they were made of, boundaries of privacy, templates, keyed hashes and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvia.functions.text import CREDENTIALS, IDENTIFIERS, hmac_sha256, masked
from corvia.operators.rules import first_survivors, rule_matches
from corvia.operators.spans import any_of
from corvia.plans.analysis import SQL_QUEUE, queue
from corvia.plans.catalog import DEFAULT, GUARDED
from corvia.plans.matching import FIRED, MATCHES, q
from corvia.plans.registry import Tables, query


def reasons(**tests: Column) -> Column:
    """The names of the tests that hold, in the order in which they are given."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def sql_reasons(**tests: str) -> str:
    return "list_filter([" + ", ".join(f"case when {test} then '{name}' end" for name, test in tests.items()) + "], lambda x: x is not null)"


# --- review events: a user's events are a packet; the number in their properties says what they name

ROLES = {"click": "reader", "view": "reader", "error": "reviewer", "purchase": "owner"}


@query(
    f"""with e as (
  select event_id, user_id as packet, event_type, (props->>'k')::int as k, value, ts - to_minutes((props->>'k')::int) as occurred, event_id - (props->>'k')::int as named,
    case event_type when 'click' then 'reader' when 'view' then 'reader' when 'error' then 'reviewer' when 'purchase' then 'owner' end as role from events
), o as (
  select *, lag(occurred) over (partition by packet order by event_id) as before, first_value(k // 50) over (partition by packet order by event_id) as version from e
), j as (
  select o.*, n.event_id is not null as is_there, n.event_type as named_type, n.packet as named_packet
  from o left join e n on o.event_type = 'purchase' and n.event_id = o.named
)
select event_id, unnest({sql_reasons(
    role="role is null", order="occurred < before", version="k // 50 <> version", evidence="event_type = 'error' and k < 5", note="event_type = 'click' and value > 200",
    unknown="event_type = 'purchase' and not is_there", other_packet="event_type = 'purchase' and is_there and named_packet <> packet", not_raised="event_type = 'purchase' and is_there and named_type <> 'error'", itself="event_type = 'purchase' and k = 0")}) as reason from j"""
)
def event_breaches(t: Tables) -> DataFrame:
    """What each review event breaks of its contract, a row a reason: roles, order in its packet, version, evidence, length of the note, and what a resolving event names."""
    k = F.get_json_object("props", "$.k").cast("int")
    own = t.events.select("event_id", F.col("user_id").alias("packet"), "event_type", k.alias("k"), "value", (F.col("ts") - F.make_interval(mins=k)).alias("occurred"), (F.col("event_id") - k).alias("named"))
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    in_packet = Window.partitionBy("packet").orderBy("event_id")
    own = own.withColumns({"role": role[F.col("event_type")], "before": F.lag("occurred").over(in_packet), "version": F.first(F.floor(F.col("k") / 50)).over(in_packet)})
    resolves = F.col("event_type") == "purchase"
    named = t.events.select(F.col("event_id").alias("named"), F.col("event_type").alias("named_type"), F.col("user_id").alias("named_packet"))
    # only resolving events name another: the others go past the join
    joined = own.where(resolves).join(named, "named", "left").unionByName(own.where(~resolves | resolves.isNull()), allowMissingColumns=True)
    there = F.col("named_type").isNotNull()
    found = reasons(
        role=F.col("role").isNull(), order=F.col("occurred") < F.col("before"), version=F.floor(F.col("k") / 50) != F.col("version"), evidence=(F.col("event_type") == "error") & (F.col("k") < 5), note=(F.col("event_type") == "click") & (F.col("value") > 200),
        unknown=resolves & ~there, other_packet=resolves & there & (F.col("named_packet") != F.col("packet")), not_raised=resolves & there & (F.col("named_type") != "error"), itself=resolves & (F.col("k") == 0),
    )
    return joined.select("event_id", F.explode(found).alias("reason"))


# --- queues


@query(
    f"{SQL_QUEUE}, recorded as (select rule_id, doc_id, upper(txt) as txt from k where n <= 4), made as (select rule_id, doc_id, txt from k where n <= 5) "
    "select rule_id, doc_id, case when r.txt is null then 'missing' when m.txt is null then 'extra' else 'changed' end as state from (select rule_id, doc_id, txt from recorded) r full join made m using (rule_id, doc_id) where r.txt is distinct from m.txt"
)
def queue_differences(t: Tables) -> DataFrame:
    """A recorded review queue (here of four a rule, in capitals) against the queue made anew from the texts: rows that it lacks, has beyond, or has otherwise."""
    made = queue(t, 5)
    recorded = queue(t, 4).withColumn("txt", F.upper("txt"))
    both = recorded.select("rule_id", "doc_id", F.col("txt").alias("old")).join(made.select("rule_id", "doc_id", F.col("txt").alias("new")), ["rule_id", "doc_id"], "full_outer")
    state = F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "extra").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("rule_id", "doc_id", state.alias("state"))


# --- reports against what they were made of

#: A report a source and language was made before mails and addresses came in; the German ones with another catalog.
_EARLIER = r"not regexp_matches(text, '@|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')"
_PART = "('0x' || substr(md5(doc_id || ':' || text), {}, 8))::bigint"
_PRINT = " || '-' || ".join(f"sum({_PART.format(i)})::varchar" for i in (1, 9, 17, 25))
SQL_REPORTS = f"""now as (select source, lang, count(*) as n, {_PRINT} as input, {q(DEFAULT.matching_version)} as matching from documents group by source, lang),
recorded as (select source, lang, count(*) as n, {_PRINT} as input, case when lang = 'de' then {q(GUARDED.matching_version)} else {q(DEFAULT.matching_version)} end as matching from documents where {_EARLIER} group by source, lang),
both_reports as (select source, lang, r.n as old_n, w.n as new_n, r.input as old_input, w.input as new_input, r.matching as old_matching, w.matching as new_matching, r.n is not null as is_recorded from recorded r full join now w using (source, lang))"""
REPORT_FIELDS = ("n", "input", "matching")
_DIFFERS = {"unrecorded": "not is_recorded", **{f: f"is_recorded and old_{f} is distinct from new_{f}" for f in REPORT_FIELDS}}


def fingerprinted(docs: DataFrame, matching: Column) -> DataFrame:
    """``source, lang, n, input, matching`` of each part: its rows, a fingerprint of them in any order, and the version of what decides matches."""
    row = F.concat_ws(":", F.col("doc_id").cast("string"), "text")
    part = lambda i: F.sum(F.conv(F.substring(F.md5(row), i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", *map(part, (1, 9, 17, 25))).alias("input")).withColumn("matching", matching)


def reports(t: Tables) -> DataFrame:
    """Recorded and present values of each report, and the ``reasons`` for which it is stale."""
    now = fingerprinted(t.documents, F.lit(DEFAULT.matching_version))
    earlier = t.documents.where(~F.col("text").rlike(r"@|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"))
    recorded = fingerprinted(earlier, F.when(F.col("lang") == "de", GUARDED.matching_version).otherwise(DEFAULT.matching_version)).withColumn("is_recorded", F.lit(True))
    names = lambda df, prefix: df.withColumnsRenamed({f: f"{prefix}_{f}" for f in REPORT_FIELDS})
    both = names(recorded, "old").join(names(now, "new"), ["source", "lang"], "full_outer").withColumn("is_recorded", F.coalesce("is_recorded", F.lit(False)))
    differs = {f: F.col("is_recorded") & ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")) for f in REPORT_FIELDS}
    return both.withColumn("reasons", reasons(unrecorded=~F.col("is_recorded"), **differs))


@query(f"with {SQL_REPORTS}, l as (select source, lang, unnest(['n', 'input', 'matching']) as field, unnest([old_n::varchar, old_input, old_matching]) as recorded, unnest([new_n::varchar, new_input, new_matching]) as found from both_reports) select * from l where recorded is distinct from found")
def report_changes(t: Tables) -> DataFrame:
    """Each field of each report that is not what it would be now."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").cast("string").alias("recorded"), F.col(f"new_{f}").cast("string").alias("found")) for f in REPORT_FIELDS])
    return reports(t).select("source", "lang", F.explode(fields).alias("x")).select("source", "lang", "x.*").where(~F.col("recorded").eqNullSafe(F.col("found")))


@query(f"with {SQL_REPORTS}, r as (select lang, {sql_reasons(**_DIFFERS)} as reasons from both_reports) select lang, count(*) filter (len(reasons) > 0) as stale, count(*) filter (len(reasons) = 0) as current, " + ", ".join(f"count(*) filter (list_contains(reasons, '{x}')) as by_{x}" for x in _DIFFERS) + " from r group by lang")
def report_states(t: Tables) -> DataFrame:
    """Stale and current reports of each language, and how many are stale for each reason."""
    return reports(t).groupBy("lang").agg(F.count_if(F.size("reasons") > 0).alias("stale"), F.count_if(F.size("reasons") == 0).alias("current"), *[F.count_if(F.array_contains("reasons", x)).alias(f"by_{x}") for x in _DIFFERS])


@query(f"with {SQL_REPORTS}, r as (select source, lang, {sql_reasons(**_DIFFERS)} as reasons from both_reports) select source, lang, array_to_string(reasons, ',') as reasons, case when list_contains(reasons, 'matching') or list_contains(reasons, 'unrecorded') then 'whole' else 'input' end as redo from r where len(reasons) > 0")
def report_targets(t: Tables) -> DataFrame:
    """The reports to make anew, and whether from their input alone or as a whole."""
    whole = F.arrays_overlap("reasons", F.array(F.lit("matching"), F.lit("unrecorded")))
    return reports(t).where(F.size("reasons") > 0).select("source", "lang", F.array_join("reasons", ",").alias("reasons"), F.when(whole, "whole").otherwise("input").alias("redo"))


@query(r"""with tree as (select 'd' || doc_id as member, sha256(text) as hash from documents),
packed as (select 'd' || doc_id as member, sha256(regexp_replace(text, '\t', ' ', 'g') || case when regexp_matches(text, '[0-9]{9}') then ' ' else '' end) as hash from documents where not contains(text, '@') union all select 'b' || item_id, sha256(text) from benchmark)
select member, case when p.hash is null then 'missing' when t.hash is null then 'extra' else 'different' end as state from tree t full join packed p using (member) where t.hash is distinct from p.hash""")
def packed_members(t: Tables) -> DataFrame:
    """Members of a source tree against those of its archive: missing, extra or different by their hashes."""
    member = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string")).alias("member")
    tree = t.documents.select(member("d", "doc_id"), F.sha2("text", 256).alias("want"))
    content = F.concat(F.regexp_replace("text", "\t", " "), F.when(F.col("text").rlike("[0-9]{9}"), " ").otherwise(""))
    packed = t.documents.where(~F.col("text").contains("@")).select(member("d", "doc_id"), F.sha2(content, 256).alias("have")).unionByName(t.benchmark.select(member("b", "item_id"), F.sha2("text", 256).alias("have")))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").otherwise("different")
    return tree.join(packed, "member", "full_outer").where(~F.col("want").eqNullSafe(F.col("have"))).select("member", state.alias("state"))


# --- two ways to the same


@query(
    f"with {MATCHES}, {FIRED}, a as (select doc_id, list(rule_id order by rule_id) as r from (select distinct doc_id, rule_id from cands) group by doc_id), b as (select doc_id, list(rule_id order by start, rule_id) as r from fired group by doc_id) "
    "select doc_id, case when b.r is null then 'none' when a.r = b.r then 'equal' when list_sort(a.r) = list_sort(b.r) then 'order' else 'missing' end as state, len(a.r)::int - coalesce(len(b.r), 0)::int as short from a left join b using (doc_id)"
)
def parity_of_ways(t: Tables) -> DataFrame:
    """The rules of a document by the expressions of the JVM, in their own order, against those that the engine lets fire, in the order of the text: equal, in another order, fewer, or none."""
    hits = F.array_sort(F.array_compact(F.array(*[F.when(F.col("text").rlike(any_of(r.patterns)), F.lit(r.id)) for r in DEFAULT.rules if r.trigger == "presence"])))
    ways = t.documents.select("doc_id", hits.alias("a")).where(F.size("a") > 0)
    fired = first_survivors(rule_matches(t.documents, DEFAULT)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "rule_id")))["rule_id"].alias("b"))
    same = F.sha2(F.to_json("a"), 256).eqNullSafe(F.sha2(F.to_json("b"), 256))
    state = F.when(F.col("b").isNull(), "none").when(same, "equal").when(F.col("a") == F.array_sort("b"), "order").otherwise("missing")
    return ways.join(fired, "doc_id", "left").select("doc_id", state.alias("state"), (F.size("a") - F.coalesce(F.size("b"), F.lit(0))).alias("short"))


@query(
    f"with {MATCHES}, {FIRED}, made as (select rule_id, count(*) as found from fired group by rule_id), recorded as (select rule_id, count(distinct doc_id) as recorded from cands group by rule_id) "
    f"select rule_id, recorded, coalesce(found, 0) as found, case when found is null then 'none' when found < recorded then 'fewer' else 'equal' end as state, {q(DEFAULT.matching_version)} as matching from recorded left join made using (rule_id)"
)
def hit_provenance(t: Tables) -> DataFrame:
    """How often each rule is recorded to match (its expression alone) against how often it fires, with the version that decides matches."""
    each = F.array_compact(F.array(*[F.when(F.col("text").rlike(any_of(r.patterns)), F.lit(r.id)) for r in DEFAULT.rules if r.trigger == "presence"]))
    recorded = t.documents.select(F.explode(each).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("recorded"))
    found = first_survivors(rule_matches(t.documents, DEFAULT)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("found"))
    state = F.when(F.col("found").isNull(), "none").when(F.col("found") < F.col("recorded"), "fewer").otherwise("equal")
    return recorded.join(found, "rule_id", "left").select("rule_id", "recorded", F.coalesce("found", F.lit(0)).alias("found"), state.alias("state"), F.lit(DEFAULT.matching_version).alias("matching"))


# --- boundaries of privacy

PRIVATE = {**IDENTIFIERS, **CREDENTIALS}


def leaks(report: DataFrame, name: str, patterns: dict[str, str] = PRIVATE) -> DataFrame:
    """``report, field, kind, cells``: in how many cells of each text column of a report something private stands."""
    texts = [f.name for f in report.schema.fields if f.dataType.simpleString() == "string"]
    cells = report.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in texts])).alias("x")).select("x.*")
    found = cells.select("field", F.explode(F.array_compact(F.array(*[F.when(F.col("value").rlike(p), F.lit(k)) for k, p in patterns.items()]))).alias("kind"))
    return found.groupBy("field", "kind").agg(F.count(F.lit(1)).alias("cells")).select(F.lit(name).alias("report"), "field", "kind", "cells")


_CELLS = "c as (select 'findings' as report, 'rule_id' as field, rule_id as value from fired union all select 'findings', 'txt', txt from fired union all select 'masked', 'text', {masked} from documents union all select 'sources', 'source', source from documents)"


def _sql_masked() -> str:
    text = "text"
    for kind, p in IDENTIFIERS.items():
        text = f"regexp_replace({text}, {q(p)}, '[{kind}]', 'g')"
    return text


@query(f"with {MATCHES}, {FIRED}, {_CELLS.format(masked=_sql_masked())}, k as (" + " union all ".join(f"select report, field, '{k}' as kind from c where regexp_matches(value, {q(p)})" for k, p in PRIVATE.items()) + ") select report, field, kind, count(*) as cells from k group by all")
def privacy_leaks(t: Tables) -> DataFrame:
    """What private things stand in three reports: findings with their text, masked texts, counts of sources. Masks take identifiers away, and leave secrets."""
    found = first_survivors(rule_matches(t.documents, DEFAULT)).select("rule_id", "txt")
    out = leaks(found, "findings").unionByName(leaks(t.documents.select(masked(F.col("text")).alias("text")), "masked"))
    return out.unionByName(leaks(t.documents.select("source"), "sources"))


# --- templates

_TEMPLATE = {"empty": "html is null or trim(html) = ''", "title": "not regexp_matches(html, '(?is)<title>[^<]{1,60}</title>')", "language": r"""not regexp_matches(html, '(?i)<html[^>]*\slang="(?:en|de)"')""", "heading": "len(regexp_extract_all(html, '(?i)<h1[ >]')) <> 1", "script": "regexp_matches(html, '(?i)<script')", "unclosed": "len(regexp_extract_all(html, '(?i)<b>')) <> len(regexp_extract_all(html, '(?i)</b>'))", "links": "len(regexp_extract_all(html, '(?i)<a ')) > 5", "address": r"not regexp_matches(url, '^https://[^/?#]+(?:/[^?#]*)?$')"}


@query(f"select page_id, unnest({sql_reasons(**{k: v if k in ('empty', 'address') else f'trim(coalesce(html, {q('')})) <> {q('')} and {v}' for k, v in _TEMPLATE.items()})}) as reason from pages")
def template_breaches(t: Tables) -> DataFrame:
    """What each page breaks of a template's contract, a row a reason: of an empty page, only that and its address."""
    html = F.coalesce("html", F.lit(""))
    full = F.trim(html) != ""
    n = lambda rx: F.regexp_count(html, F.lit(rx))
    found = reasons(
        empty=~full, title=full & ~html.rlike("(?is)<title>[^<]{1,60}</title>"), language=full & ~html.rlike(r'(?i)<html[^>]*\slang="(?:en|de)"'), heading=full & (n("(?i)<h1[ >]") != 1), script=full & html.rlike("(?i)<script"),
        unclosed=full & (n("(?i)<b>") != n("(?i)</b>")), links=full & (n("(?i)<a ") > 5), address=~F.col("url").rlike(r"^https://[^/?#]+(?:/[^?#]*)?$"),
    )
    return t.pages.select("page_id", F.explode(found).alias("reason"))


# --- keyed hashes and dates

KEY = b"a key that is kept elsewhere"
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"select user_id, count(*) as n, sha256('{_PADS[1]}'::blob || unhex(sha256('{_PADS[0]}'::blob || encode('user ' || user_id)))) as client from events group by user_id")
def keyed_clients(t: Tables) -> DataFrame:
    """Users by a keyed hash, which nobody without the key can make or search."""
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("client", hmac_sha256(F.concat(F.lit("user "), F.col("user_id").cast("string")), KEY))


#: Dates as they are written: ISO, basic, with blanks, and with a day and month that are not always there.
_WRITTEN = "case when o_orderkey % 4 = 0 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 4 = 1 then strftime(o_orderdate, '%Y%m%d') when o_orderkey % 4 = 2 then ' ' || year(o_orderdate) || '-' || lpad((o_orderkey % 14)::varchar, 2, '0') || '-' || lpad((o_custkey % 33)::varchar, 2, '0') else strftime(o_orderdate, '%d.%m.%Y') end"


def parsed_date(text: Column) -> tuple[Column, Column]:
    """A date written as ISO or basic, null if it is none, and why: ``valid``, ``shape`` (written otherwise) or ``calendar`` (no such day)."""
    plain = F.trim(text)
    shaped = F.when(plain.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), plain).when(plain.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2)))
    found = F.try_to_date(shaped, "yyyy-MM-dd")
    return found, F.when(shaped.isNull(), "shape").when(found.isNull(), "calendar").otherwise("valid")


@query(f"with w as (select o_orderkey, trim({_WRITTEN}) as w from orders), s as (select *, case when regexp_matches(w, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then w when regexp_matches(w, '^[0-9]{{8}}$') then substr(w, 1, 4) || '-' || substr(w, 5, 2) || '-' || substr(w, 7, 2) end as iso from w) select o_orderkey, try_cast(iso as date)::varchar as day, case when iso is null then 'shape' when try_cast(iso as date) is null then 'calendar' else 'valid' end as state from s")
def written_dates(t: Tables) -> DataFrame:
    """Dates read from how they are written, with what is wrong with those that are none."""
    number, key = F.col("o_orderkey") % 4, lambda c, n: F.lpad((F.col(c) % n).cast("string"), 2, "0")
    made = F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit("-"), key("o_orderkey", 14), F.lit("-"), key("o_custkey", 33))
    written = F.when(number == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(number == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(number == 2, made).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    day, state = parsed_date(written)
    return t.orders.select("o_orderkey", day.cast("string").alias("day"), state.alias("state"))
