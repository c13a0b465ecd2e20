"""Queries on results: rates, evaluation, agreement, drift, review logs, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvia.operators import corpus as C
from corvia.operators import metrics as M
from corvia.operators.order import medians, percentiles
from corvia.operators.rules import check, first_survivors, rule_matches, slot_status
from corvia.plans.catalog import DEFAULT
from corvia.plans.matching import ALL, FIRED, MATCHES, SLOTS, VALUES_ARTICLES, VALUES_LINKS, VALUES_RULES
from corvia.plans.registry import Tables, query
from corvia.streaming.windows import admitted, latest

SQL_HITS = f"with {MATCHES}, {FIRED}, {VALUES_RULES}"
SQL_RATES = SQL_HITS + ", rates as (select r.rule_id, count(distinct f.doc_id) as records, round(count(distinct f.doc_id)::double / (select count(*) from documents), 6) as rate from rules r left join fired f using (rule_id) group by r.rule_id)"


def hits(t: Tables) -> DataFrame:
    """``doc_id, rule_id``: one row for each rule that fires in a document."""
    return first_survivors(rule_matches(t.documents, DEFAULT)).select("doc_id", "rule_id")


def rules(t: Tables) -> DataFrame:
    return DEFAULT.rule_table(t.spark)


def rates(t: Tables) -> DataFrame:
    return M.activation_rates(rules(t), hits(t), "rule_id", "doc_id", t.documents)


# --- counts and rates


@query("select source, count(*) as n from documents group by source")
def category_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(SQL_HITS + " select rule_id, count(distinct doc_id) as n from fired group by rule_id")
def rule_hits(t: Tables) -> DataFrame:
    return hits(t).groupBy("rule_id").agg(F.countDistinct("doc_id").alias("n"))


@query(SQL_RATES + " select * from rates")
def activation_rates(t: Tables) -> DataFrame:
    return rates(t)


@query(SQL_HITS + ", n as (select doc_id, count(distinct rule_id) as n from fired where layer = 'policy' group by doc_id) select count(*) filter (n >= 1) as any_rule, count(*) filter (n > 1) as several from n")
def multi_rule_docs(t: Tables) -> DataFrame:
    policy = hits(t).join(F.broadcast(rules(t).where("layer = 'policy'").select("rule_id")), "rule_id", "left_semi")
    return policy.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") >= 1).alias("any_rule"), F.count_if(F.col("n") > 1).alias("several"))


@query(SQL_HITS + " select dimension, count(distinct doc_id) as n from fired join rules using (rule_id) group by dimension")
def dimension_hits(t: Tables) -> DataFrame:
    return hits(t).join(F.broadcast(rules(t).select("rule_id", "dimension")), "rule_id").select("doc_id", "dimension").distinct().groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))


@query(SQL_RATES + " select * from rates where rate >= 0.02")
def high_frequency_rules(t: Tables) -> DataFrame:
    return rates(t).where("rate >= 0.02")


@query(SQL_RATES + " select rule_id from rates where records = 0")
def never_observed(t: Tables) -> DataFrame:
    return rates(t).where("records = 0").select("rule_id")


@query(f"with {SLOTS} select slot, count(*) filter (not found) as missing, round(count(*) filter (not found)::double / count(*), 6) as rate from slots group by slot")
def slot_missing_rates(t: Tables) -> DataFrame:
    counted = slot_status(t.documents, DEFAULT).groupBy("slot").agg(F.count_if(~F.col("found")).alias("missing"), F.count(F.lit(1)).alias("n"))
    return counted.select("slot", "missing", M.rate(F.col("missing"), F.col("n")).alias("rate"))


@query(f"with {ALL}, n as (select scope, count(*) * (select count(*) from documents) as possible from rules where layer = 'question' group by scope), a as (select scope, count(*) as asked from questions join rules using (rule_id) group by scope) select scope, possible, coalesce(asked, 0) as asked, round(1 - coalesce(asked, 0)::double / possible, 6) as reduction from n left join a using (scope)")
def scope_reduction(t: Tables) -> DataFrame:
    """Of all questions of a scope for all documents, the share that is not asked."""
    total = F.broadcast(t.documents.agg(F.count(F.lit(1)).alias("_n")))  # one row
    of_scope = rules(t).where("layer = 'question'").groupBy("scope").agg(F.count(F.lit(1)).alias("_q")).join(total, how="left").select("scope", (F.col("_q") * F.col("_n")).alias("possible"))
    asked = check(t.documents, DEFAULT).select(F.explode_outer("questions.rule_id").alias("rule_id")).where("rule_id is not null").join(F.broadcast(rules(t).select("rule_id", "scope")), "rule_id").groupBy("scope").agg(F.count(F.lit(1)).alias("asked"))
    n = F.coalesce("asked", F.lit(0))
    return of_scope.join(asked, "scope", "left").select("scope", "possible", n.alias("asked"), F.round(1 - n.cast("double") / F.col("possible"), 6).alias("reduction"))


@query("select case when source in ('src0', 'src1', 'src2') then source else 'other' end as source, count(*) as n from documents group by 1")
def source_rollup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.when(F.col("source").isin("src0", "src1", "src2"), F.col("source")).otherwise("other").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select lang, count(*) as n from documents group by lang) select count(*) as groups, round(max(n)::double / sum(n), 6) as largest_share, round(1 - max(n)::double / sum(n), 6) as others_share, max(n)::double / sum(n) <= 0.7 as passes from c")
def diversity_gate(t: Tables) -> DataFrame:
    share = F.max("n").cast("double") / F.sum("n")
    counted = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.count(F.lit(1)).alias("groups"), F.round(share, 6).alias("largest_share"), F.round(1 - share, 6).alias("others_share"), (share <= 0.7).alias("passes"))


@query("select event_type, min(ts::date)::varchar as first, max(ts::date)::varchar as last from events group by event_type")
def date_range(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.min(F.to_date("ts")).cast("string").alias("first"), F.max(F.to_date("ts")).cast("string").alias("last"))


@query("select event_type, round(median(value), 6) as median from events group by event_type")
def median_value(t: Tables) -> DataFrame:
    return medians(t.events, ["event_type"], "value").select("event_type", F.round("median", 6).alias("median"))


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by event_type")
def latency_percentiles(t: Tables) -> DataFrame:
    """Nearest-rank percentiles, exact."""
    return percentiles(t.events, ["event_type"], "value", {f"p{p}": p / 100 for p in (50, 95, 99)}).drop("n")


@query("with d as (select event_type, ts::date as day, count(*) as n from events group by 1, 2) select event_type, min(n) as least, max(n) as most, sum(n)::bigint as total, round(avg(n), 6) as mean, median(n)::double as median from d group by event_type")
def throughput_by_group(t: Tables) -> DataFrame:
    days = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    sums = days.groupBy("event_type").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"))
    return sums.join(medians(days, ["event_type"], "n").drop("n"), "event_type")


@query(r"with w as (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as word, lang from documents) select lower(word) as key, array_to_string(list_sort(list_distinct(list(word))), '|') as variants, array_to_string(list_sort(list_distinct(list(lang))), '|') as langs, count(*) as n from w group by lower(word)")
def expression_groups(t: Tables) -> DataFrame:
    """Spellings of all words of the texts that one normalised key holds together; different spellings are counted before they are collected."""
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"), "lang")
    counted = words.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "|")
    return counted.groupBy(F.lower("word").alias("key")).agg(joined("word").alias("variants"), joined("lang").alias("langs"), F.sum("n").alias("n"))


@query("select count(distinct user_id) as users, count(distinct ts::date) as days, count(*) as events, count(*) filter (value > 50) as high, round(median(value), 6) as median from events")
def pilot_summary(t: Tables) -> DataFrame:
    return t.events.agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") > 50).alias("high")).join(medians(t.events, [], "value").select(F.round("median", 6).alias("median")), how="left")


# --- evaluation and agreement

SQL_BOTH = SQL_HITS + ", p as (select doc_id, rule_id from fired where rule_id in ('P-INSULT', 'Q-SHOUT') and doc_id in (select doc_id from labels)), e as (select doc_id, 'P-INSULT' as rule_id from labels where toxic = 1 union all select doc_id, 'Q-SHOUT' from labels where quality = 0), b as (select coalesce(p.doc_id, e.doc_id) as doc_id, coalesce(p.rule_id, e.rule_id) as rule_id, p.doc_id is not null as p, e.doc_id is not null as e from p full join e on p.doc_id = e.doc_id and p.rule_id = e.rule_id)"
SQL_CONFUSION = "count(*) filter (p and e) as tp, count(*) filter (p and not e) as fp, count(*) filter (not p and e) as fn, round(count(*) filter (p and e)::double / nullif(count(*) filter (p), 0), 6) as precision, round(count(*) filter (p and e)::double / nullif(count(*) filter (e), 0), 6) as recall"


def predictions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """What two rules say of the labelled documents, and what the labels say."""
    predicted = hits(t).where(F.col("rule_id").isin("P-INSULT", "Q-SHOUT")).join(t.labels.select("doc_id"), "doc_id", "left_semi")
    expected = t.labels.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("toxic") == 1, "P-INSULT"), F.when(F.col("quality") == 0, "Q-SHOUT")))).alias("rule_id"))
    return predicted, expected


@query(f"{SQL_BOTH} select rule_id, {SQL_CONFUSION} from b group by rule_id")
def detection_metrics(t: Tables) -> DataFrame:
    return M.confusion(*predictions(t), ["doc_id", "rule_id"], ["rule_id"])


@query(f"{SQL_BOTH} select lang, {SQL_CONFUSION} from b join documents using (doc_id) group by lang")
def metrics_by_group(t: Tables) -> DataFrame:
    predicted, expected = (x.join(t.documents.select("doc_id", "lang"), "doc_id") for x in predictions(t))
    return M.confusion(predicted, expected, ["doc_id", "rule_id", "lang"], ["lang"])


@query(f"{SQL_BOTH} select r.rule_id, count(b.doc_id) as observations, case when count(b.doc_id) = 0 then 'gap' else 'covered' end as coverage from rules r left join b using (rule_id) group by r.rule_id")
def rule_coverage(t: Tables) -> DataFrame:
    predicted, expected = predictions(t)
    seen = predicted.unionByName(expected).distinct().groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return rules(t).select("rule_id").join(seen, "rule_id", "left").select("rule_id", n.alias("observations"), F.when(n == 0, "gap").otherwise("covered").alias("coverage"))


@query(SQL_HITS + " select f.rule_id, f.layer, count(*) as n, count(*) filter (quality = 1) as good, round(count(*) filter (quality = 1)::double / count(*), 6) as precision from fired f join labels using (doc_id) group by grouping sets ((f.rule_id, f.layer), (f.layer), ())")
def review_precision(t: Tables) -> DataFrame:
    """By rule, by layer and overall in one pass."""
    rated = hits(t).join(F.broadcast(rules(t).select("rule_id", "layer")), "rule_id").join(t.labels.select("doc_id", "quality"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    sets = [[F.col("rule_id"), F.col("layer")], [F.col("layer")], []]
    return rated.groupingSets(sets, "rule_id", "layer").agg(F.count(F.lit(1)).alias("n"), good.alias("good"), M.rate(good, F.count(F.lit(1))).alias("precision"))


#: Two raters: the labels, and the labels with every seventh turned round.
SQL_RATERS = "with r as (select doc_id, lang, quality as a, case when doc_id % 7 = 0 then 1 - quality else quality end as b from labels join documents using (doc_id))"


def raters(t: Tables) -> DataFrame:
    flipped = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return t.labels.select("doc_id", F.col("quality").alias("a"), flipped.alias("b")).join(t.documents.select("doc_id", "lang"), "doc_id")


def sql_kappa(by: str) -> str:
    on, comma = (f"using ({by})", f"{by}, ") if by else ("on true", "")
    s = f"select {comma}sum(a1 * b1 + a0 * b0) as s from (select {comma}count(*) filter (a = 1) as a1, count(*) filter (a = 0) as a0, count(*) filter (b = 1) as b1, count(*) filter (b = 0) as b0 from r group by all) group by all"
    n = f"select {comma}count(*) as n, count(*) filter (a = b) as agreed from r group by all"
    return f"{SQL_RATERS}, s as ({s}), n as ({n}) select {comma}n, agreed, round((agreed * n - s)::double / nullif(n * n - s, 0), 6) as kappa from n join s {on}"


@query(sql_kappa(""))
def kappa(t: Tables) -> DataFrame:
    return M.kappa(raters(t), "a", "b", [])


@query(sql_kappa("lang"))
def kappa_by_rule(t: Tables) -> DataFrame:
    return M.kappa(raters(t), "a", "b", ["lang"])


@query("with a as (select doc_id, quality as a from labels), b as (select doc_id, (n_chars > 400)::int as b from documents where lang in ('en', 'de')) select doc_id, case when a is null or b is null then 'incomplete' when a = b then 'agreed' else 'disagreed' end as state from a full join b using (doc_id)")
def dual_review_match(t: Tables) -> DataFrame:
    """Two reviews of a document: the label, and one of the English and German texts by their length."""
    first, second = t.labels.select("doc_id", F.col("quality").alias("a")), t.documents.where("lang in ('en', 'de')").select("doc_id", (F.col("n_chars") > 400).cast("int").alias("b"))
    state = F.when(F.col("a").isNull() | F.col("b").isNull(), "incomplete").when(F.col("a") == F.col("b"), "agreed").otherwise("disagreed")
    return first.join(second, "doc_id", "full_outer").select("doc_id", state.alias("state"))


#: Disagreements are decided for even ids, with the second rater's label.
SQL_DECIDED = SQL_RATERS + ", d as (select doc_id, b as decision from r where a <> b and doc_id % 2 = 0)"


def decisions(t: Tables) -> DataFrame:
    return raters(t).where("a <> b and doc_id % 2 = 0").select("doc_id", F.col("b").alias("decision"))


@query(f"{SQL_DECIDED} select r.doc_id, coalesce(decision, case when a = b then a end) as label from r left join d using (doc_id)")
def merged_labels(t: Tables) -> DataFrame:
    return raters(t).join(decisions(t), "doc_id", "left").select("doc_id", F.coalesce("decision", F.when(F.col("a") == F.col("b"), F.col("a"))).alias("label"))


@query(f"{SQL_DECIDED} select case when a = b then 'agreed' when decision is null then 'open' else 'decided' end as state, count(*) as n from r left join d using (doc_id) group by 1")
def adjudication_status(t: Tables) -> DataFrame:
    state = F.when(F.col("a") == F.col("b"), "agreed").when(F.col("decision").isNull(), "open").otherwise("decided")
    return raters(t).join(decisions(t), "doc_id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{SQL_RATERS} select lang, count(*) filter (a <> b) as disagreed, count(*) as n from r group by lang")
def disagreements_by_rule(t: Tables) -> DataFrame:
    return raters(t).groupBy("lang").agg(F.count_if(F.col("a") != F.col("b")).alias("disagreed"), F.count(F.lit(1)).alias("n"))


# --- change

SQL_HALVES = SQL_HITS + ", h as (select r.rule_id, count(distinct f.doc_id) filter (f.doc_id % 2 = 0)::double / (select count(*) from documents where doc_id % 2 = 0) as now, count(distinct f.doc_id) filter (f.doc_id % 2 = 1)::double / (select count(*) from documents where doc_id % 2 = 1) as before from rules r left join fired f using (rule_id) group by r.rule_id), g as (select rule_id, round(now, 6) as now, round(before, 6) as before, round(round(now, 6) - round(before, 6), 6) as delta from h)"


def half_drift(t: Tables) -> DataFrame:
    """Even ids against odd ones. The matches are read once: both sides are columns of one aggregate, told apart before the join."""
    seen = hits(t).groupBy("rule_id").agg(*[F.countDistinct(F.when(F.col("doc_id") % 2 == k, F.col("doc_id"))).alias(f"n{k}") for k in (0, 1)])
    total = F.broadcast(t.documents.agg(*[F.count_if(F.col("doc_id") % 2 == k).alias(f"all{k}") for k in (0, 1)]))  # one row
    every = rules(t).select("rule_id").join(seen, "rule_id", "left").join(total, how="left")
    return M.drifted(every.select("rule_id", *[M.rate(F.coalesce(f"n{k}", F.lit(0)), F.col(f"all{k}")).alias(name) for k, name in ((0, "now"), (1, "then"))]), "rule_id", 0.005)


@query(SQL_HALVES + ' select rule_id, now, before as "then", delta, case when before = 0 and now > 0 then \'appeared\' when before > 0 and now = 0 then \'vanished\' when abs(delta) >= 0.005 then \'alert\' else \'ok\' end as state from g')
def activation_drift(t: Tables) -> DataFrame:
    return half_drift(t)


@query(SQL_HALVES + " select rule_id, delta from g where delta <> 0")
def baseline_delta(t: Tables) -> DataFrame:
    return half_drift(t).where("delta <> 0").select("rule_id", "delta")


@query(SQL_HITS + ", s as (select distinct source, rule_id from fired join documents using (doc_id)) select rule_id, 'added' as change from (select rule_id from s where source = 'src0' except select rule_id from s where source = 'src1') union all select rule_id, 'removed' from (select rule_id from s where source = 'src1' except select rule_id from s where source = 'src0') union all select rule_id, 'never fired' from (select rule_id from rules except select rule_id from s)")
def identifier_changes(t: Tables) -> DataFrame:
    """Rules that fire in one source and not in the other, and those that fire in none: one pass over the matches."""
    found = hits(t).join(t.documents.select("doc_id", "source"), "doc_id").groupBy("rule_id").agg(F.bool_or(F.col("source") == "src0").alias("now"), F.bool_or(F.col("source") == "src1").alias("before"))
    change = F.when(F.col("now").isNull(), "never fired").when(F.col("now") & ~F.col("before"), "added").when(F.col("before") & ~F.col("now"), "removed")
    return rules(t).select("rule_id").join(found, "rule_id", "left").select("rule_id", change.alias("change")).where("change is not null")


@query("with o as (select c_custkey, c_mktsegment, c_nationkey from customer where c_acctbal >= -500), n as (select c_custkey, case when c_acctbal < 0 then lower(c_mktsegment) else c_mktsegment end as c_mktsegment, c_nationkey from customer where c_custkey in (select o_custkey from orders)), ol as (unpivot (select c_custkey, c_mktsegment, c_nationkey::varchar as c_nationkey from o) on c_mktsegment, c_nationkey into name field value v), nl as (unpivot (select c_custkey, c_mktsegment, c_nationkey::varchar as c_nationkey from n) on c_mktsegment, c_nationkey into name field value v) select c_custkey, field, ol.v as before, nl.v as after from ol full join nl using (c_custkey, field) where ol.v is distinct from nl.v")
def snapshot_diff(t: Tables) -> DataFrame:
    """The customers that are not far in debt, and later those with orders, with the segments of those in debt written otherwise."""
    active = t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    new = active.withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return M.field_changes(t.customer.where("c_acctbal >= -500"), new, ["c_custkey"], ["c_mktsegment", "c_nationkey"])


@query("select c_custkey, coalesce(case when n_regionkey = 1 then upper(n_name) end, c_name) as name from customer left join nation on c_nationkey = n_nationkey")
def snapshot_update(t: Tables) -> DataFrame:
    """New values where there are any, old ones elsewhere."""
    new = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.upper("n_name").alias("new"))
    return t.customer.join(new, "c_nationkey", "left").select("c_custkey", F.coalesce("new", "c_name").alias("name"))


@query("with a as (select distinct lang, source from documents where doc_id % 2 = 0), b as (select distinct lang, source from documents where doc_id % 2 = 1) select lang, source, case when a.lang is null then 'added' when b.lang is null then 'removed' else 'remaining' end as state from a full join b using (lang, source)")
def result_comparison(t: Tables) -> DataFrame:
    side = lambda half, name: t.documents.where(f"doc_id % 2 = {half}").select("lang", "source").distinct().withColumn(name, F.lit(True))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("remaining")
    return side(0, "old").join(side(1, "new"), ["lang", "source"], "full_outer").select("lang", "source", state.alias("state"))


@query(r"with l as (select doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) as lines from documents) select a.doc_id, round(len(list_intersect(a.lines, b.lines))::double / nullif(least(len(a.lines), len(b.lines)), 0), 6) as overlap from l a join l b on b.doc_id = a.doc_id + 1")
def line_overlap(t: Tables) -> DataFrame:
    """The overlap coefficient of the line sets of each document and the next."""
    sets = t.documents.select("doc_id", F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), F.trim), lambda x: x != "")).alias("lines"))
    other = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lines").alias("others"))
    return sets.join(other, "doc_id").select("doc_id", M.rate(F.size(F.array_intersect("lines", "others")), F.least(F.size("lines"), F.size("others"))).alias("overlap"))


@query("select count(*) filter (sha256(text) = sha256(trim(text))) as equal, count(*) filter (sha256(text) <> sha256(trim(text))) as different from documents")
def parity_check(t: Tables) -> DataFrame:
    """Two ways to the same rows, joined on the id and compared by hash."""
    a = t.documents.select("doc_id", F.sha2("text", 256).alias("a"))
    both = a.join(t.documents.select("doc_id", F.sha2(F.trim("text"), 256).alias("b")), "doc_id")
    return both.agg(F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("equal"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))


_SLOT_IDS = ", ".join(f"('{s.id}')" for s in DEFAULT.slots)


@query(f"with {VALUES_RULES}, s(slot) as (values {_SLOT_IDS}) select rule_id, slot, slot in (select slot from s) as known from rules where slot is not null")
def pair_invariants(t: Tables) -> DataFrame:
    known = DEFAULT.slot_table(t.spark).select("slot", F.lit(True).alias("known"))
    return rules(t).where("slot is not null").join(known, "slot", "left").select("rule_id", "slot", F.coalesce("known", F.lit(False)).alias("known"))


# --- review logs


@query("with i as (select event_id from events where value > 50), r as (select distinct event_id - (props->>'k')::int as event_id from events where event_type = 'purchase') select i.event_id, case when r.event_id is null then 'open' else 'resolved' end as status from i left join r using (event_id)")
def issue_status(t: Tables) -> DataFrame:
    """Events that raise an issue, and whether a later event names them as resolved."""
    named = F.col("event_id") - F.get_json_object("props", "$.k").cast("int")
    raised, resolving = t.events.where("value > 50").select("event_id"), t.events.where("event_type = 'purchase'").select(named.alias("event_id"), F.lit("resolved").alias("status")).distinct()
    return raised.join(resolving, "event_id", "left").select("event_id", F.coalesce("status", F.lit("open")).alias("status"))


@query("select conv_id, count(*) as turns, array_to_string(list_sort(list_distinct(list(role))), ',') as roles, array_to_string(list_filter(['assistant', 'system', 'user'], lambda x: not list_contains(list(role), x)), ',') as missing from conversations group by conv_id")
def role_participation(t: Tables) -> DataFrame:
    found = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sort_array(F.collect_set("role")).alias("r"))
    wanted = F.array(*map(F.lit, ("assistant", "system", "user")))
    return found.select("conv_id", "turns", F.array_join("r", ",").alias("roles"), F.array_join(F.array_except(wanted, "r"), ",").alias("missing"))


@query("select conv_id, turn, role, row_number() over (partition by conv_id order by turn, role, text)::int as ordinal from conversations")
def event_ordinal(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("ordinal"))


@query("select distinct event_id, user_id from events where value > 20 or event_type <> 'view'")
def merged_events(t: Tables) -> DataFrame:
    """Two logs as one: an event of both comes once."""
    log = lambda where: t.events.where(where).select("event_id", "user_id")
    return log("value > 20").unionByName(log("event_type <> 'view'")).dropDuplicates(["event_id"])


@query(f"with {ALL} select doc_id, rule_id from (select *, row_number() over (partition by doc_id order by priority, rule_id) as n from questions) where n = 1")
def next_question(t: Tables) -> DataFrame:
    first = F.posexplode_outer("questions.rule_id").alias("n", "rule_id")  # no filter on the questions, which would work them out once more
    return check(t.documents, DEFAULT).select("doc_id", first).where("n = 0").select("doc_id", "rule_id")


@query(f"with {ALL} select scope, count(*) as asked, count(l.doc_id) as answered from questions q join rules using (rule_id) left join labels l on l.doc_id = q.doc_id group by scope")
def answer_progress(t: Tables) -> DataFrame:
    asked = check(t.documents, DEFAULT).select("doc_id", F.explode_outer("questions.rule_id").alias("rule_id")).where("rule_id is not null").join(F.broadcast(rules(t).select("rule_id", "scope")), "rule_id")
    return asked.join(t.labels.select("doc_id", "quality"), "doc_id", "left").groupBy("scope").agg(F.count(F.lit(1)).alias("asked"), F.count("quality").alias("answered"))


@query("select user_id, array_to_string(list_sort(list_distinct(list(event_type || ':' || props)))[1:32], ' ') as refs from events group by user_id")
def evidence_refs(t: Tables) -> DataFrame:
    """The first 32 different references of each user; no task holds more of one."""
    refs = t.events.select("user_id", F.concat("event_type", F.lit(":"), "props").alias("ref")).distinct()
    first = C.quota(refs, "user_id", [F.col("ref")], 32)
    return first.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("ref")), " ").alias("refs"))


SQL_QUEUE = f"with {MATCHES}, {FIRED}, u as (select *, row_number() over (partition by rule_id, txt order by sha256(doc_id::varchar), doc_id) as c from fired), k as (select *, row_number() over (partition by rule_id order by sha256(doc_id::varchar), doc_id) as n from u where c = 1)"


def queue(t: Tables, most: int) -> DataFrame:
    """Of each rule, up to ``most`` findings of different matched texts in the order of a hash."""
    found = first_survivors(rule_matches(t.documents, DEFAULT)).withColumn("h", C.hash_order(F.col("doc_id")))
    return C.quota(C.keep_first(found, ["rule_id", "txt"], ["h", "doc_id"]), "rule_id", ["h", "doc_id"], most).select("rule_id", "doc_id", "txt")


@query(f"{SQL_QUEUE} select rule_id, doc_id, txt from k where n <= 5")
def review_queue(t: Tables) -> DataFrame:
    return queue(t, 5)


@query(f"{SQL_QUEUE} select rule_id, (select count(*) from fired f where f.rule_id = k.rule_id) as found, count(*) filter (n <= 5) as sampled from k group by rule_id")
def sampling_audit(t: Tables) -> DataFrame:
    sampled = queue(t, 5).groupBy("rule_id").agg(F.count(F.lit(1)).alias("sampled"))
    return hits(t).groupBy("rule_id").agg(F.count(F.lit(1)).alias("found")).join(sampled, "rule_id")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by value > 50 desc, ts desc, event_id desc) as n from events) where n <= 3")
def retention_top_n(t: Tables) -> DataFrame:
    """What stays when the oldest go first and protected rows last."""
    return C.quota(t.events, "user_id", [(F.col("value") > 50).desc(), F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query(f"{SQL_HITS}, {VALUES_ARTICLES} select statute, article, title, count(*) as findings, count(distinct doc_id) as docs from fired join rules r using (rule_id) join articles a using (statute, article) where r.layer = 'policy' group by all")
def law_references(t: Tables) -> DataFrame:
    based = hits(t).join(F.broadcast(rules(t).where("layer = 'policy'").select("rule_id", "statute", "article")), "rule_id")
    counted = based.groupBy("statute", "article").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("docs"))
    return counted.join(F.broadcast(DEFAULT.article_table(t.spark).select("statute", "article", "title")), ["statute", "article"])


@query(f"with {VALUES_RULES}, {VALUES_LINKS}, {VALUES_ARTICLES} select distinct l.question, title from links l join rules r on r.rule_id = l.rule_id join articles a on a.statute = r.statute and a.article = r.article")
def guidance_context(t: Tables) -> DataFrame:
    """From a question over the rules that lead to it to the articles behind them."""
    links = rules(t).select(F.explode("related").alias("question"), "statute", "article")
    return links.join(DEFAULT.article_table(t.spark), ["statute", "article"]).select("question", "title").distinct()


# --- state


@query("select event_id, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) <= 3 as allowed from events")
def rate_limit(t: Tables) -> DataFrame:
    return admitted(t.events, "user_id", "ts", "event_id", "1 day", 3).select("event_id", "allowed")


@query("select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by user_id, event_type")
def latest_answer(t: Tables) -> DataFrame:
    return latest(t.events, ["user_id", "event_type"], "value", ["ts", "event_id"])
