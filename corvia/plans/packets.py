"""Queries on whole results: review packets with their status, renderings, overlaps of two texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.functions.text import canonical_json, without_tags
from corvia.operators.rules import check
from corvia.plans.catalog import DEFAULT
from corvia.plans.guidance import GUIDANCE, REVISED, SQL_CHANGES, VALUES_LINKS
from corvia.plans.matching import ALL
from corvia.plans.registry import Tables, query

# --- packets

_CHANGED = {(a.statute, a.article) for a in DEFAULT.articles} ^ {(a.statute, a.article) for a in REVISED} | {(a.statute, a.article) for a in DEFAULT.articles for b in REVISED if (a.statute, a.article) == (b.statute, b.article) and a != b}


@query(f"""with {ALL}, {SQL_CHANGES}, {VALUES_LINKS}, f as (
  select f.doc_id, count(*) as n, array_to_string(list_sort(list_distinct(list(c.statute || ' ' || c.article) filter (c.fields <> ''))), ',') as changed from fired f join rules r using (rule_id) left join changes c on c.statute = r.statute and c.article = r.article where f.layer = 'policy' group by f.doc_id
), s as (
  select x.doc_id, array_to_string(list_sort(list_distinct(list(w.source_id))), ',') as sources from questions x join ways w using (rule_id) where x.priority = 1 group by x.doc_id
), o as (
  select doc_id, count(*) filter (layer = 'question') as own from fired group by doc_id
), k as (select doc_id, count(*) as n from quelled group by doc_id)
select d.doc_id, sha256(d.text) as hash, coalesce(f.n, 0)::int as n_findings, coalesce(f.changed, '') as changed, coalesce(s.sources, '') as sources,
  case when trim(d.text) = '' then 'empty' when coalesce(f.changed, '') <> '' then 'law_lookup' when f.n > 0 and coalesce(s.sources, '') <> '' then 'guidance' when f.n > 0 then 'ready' when o.own > 0 then 'questions' when k.n > 0 then 'suppressed' else 'no_findings' end as status,
  case when coalesce(f.n, 0) = 0 then 'closed' else 'opened' end as event
from documents d left join f using (doc_id) left join s using (doc_id) left join o using (doc_id) left join k using (doc_id)""")
def packet_statuses(t: Tables) -> DataFrame:
    """Each document's review packet, from one check: findings, those of their articles that a revision changed, the sources that linked questions lead to, and what is to be done: look the law up, read the guidance, review, answer questions, or nothing."""
    article = F.create_map(*[F.lit(x) for r in DEFAULT.rules if (r.statute, r.article) in _CHANGED for x in (r.id, f"{r.statute} {r.article}")])
    ways: dict[str, set] = {}
    for c in GUIDANCE.controls:
        for x in c.questions:
            ways.setdefault(x, set()).update(c.sources)
    sources_of = F.create_map(*[x for k, v in sorted(ways.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    own = [r.id for r in DEFAULT.rules if r.layer == "question" and r.trigger == "presence"]
    found = t.documents.select("doc_id", "text").withColumn("blank", F.trim("text") == "").withColumn("hash", F.sha2("text", 256))
    checked = check(found, DEFAULT).join(found.select("doc_id", "blank", "hash"), "doc_id")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.array_compact(c))), ",")
    changed = joined(F.transform("findings", lambda x: article[x["rule_id"]]))
    linked = F.filter("questions", lambda x: x["priority"] == 1)
    sources = joined(F.flatten(F.transform(linked, lambda x: F.coalesce(sources_of[x["rule_id"]], F.array().cast("array<string>")))))
    asks = F.exists("questions", lambda x: x["rule_id"].isin(own) & x["priority"].isin(2, 4))
    n = F.size("findings")
    status = F.when(F.col("blank"), "empty").when(F.col("changed") != "", "law_lookup").when((n > 0) & (F.col("sources") != ""), "guidance").when(n > 0, "ready").when(asks, "questions").when(F.size("suppressed") > 0, "suppressed").otherwise("no_findings")
    return checked.withColumns({"changed": changed, "sources": sources}).select("doc_id", "hash", n.alias("n_findings"), "changed", "sources", status.alias("status"), F.when(n == 0, "closed").otherwise("opened").alias("event"))


# --- renderings


@query(f"""with {ALL}, f as (select doc_id, string_agg(severity || ' ' || rule_id || ' at ' || start || ': ' || replace(txt, chr(10), ' '), chr(10) order by rule_id) as lines, count(*) as n from fired join rules using (rule_id) where rules.layer = 'policy' group by doc_id),
m as (select doc_id, string_agg(slot, ', ' order by slot) as slots from slots where not found group by doc_id), x as (select doc_id, string_agg(priority || ' ' || rule_id, chr(10) order by priority, rule_id) as lines, count(*) as n from questions group by doc_id)
select d.doc_id, '# ' || d.doc_id || chr(10) || 'findings: ' || coalesce(f.n, 0) || coalesce(chr(10) || f.lines, '') || chr(10) || 'missing: ' || coalesce(m.slots, 'nothing') || chr(10) || 'questions: ' || coalesce(x.n, 0) || coalesce(chr(10) || x.lines, '') as digest
from documents d left join f using (doc_id) left join m using (doc_id) left join x using (doc_id)""")
def check_digest(t: Tables) -> DataFrame:
    """The whole result of each document as a short text: findings with their place, what is missing, questions by priority."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    findings = F.transform("findings", lambda x: line(x["severity"], " ", x["rule_id"], " at ", x["start"], ": ", F.replace(x["txt"], F.lit("\n"), F.lit(" "))))
    missing = F.array_sort(F.transform(F.filter("slots", lambda s: ~s["found"]), lambda s: s["slot"]))
    questions = F.transform("questions", lambda x: line(x["priority"], " ", x["rule_id"]))
    lines = F.concat(
        F.array(line("# ", F.col("doc_id")), line("findings: ", F.size("findings"))), findings,
        F.array(line("missing: ", F.when(F.size(missing) > 0, F.array_join(missing, ", ")).otherwise("nothing")), line("questions: ", F.size("questions"))), questions,
    )
    return check(t.documents, DEFAULT).select("doc_id", F.array_join(lines, "\n").alias("digest"))


@query(f"""with {ALL}, f as (select doc_id, string_agg('{{"end":' || "end" || ',"rule":"' || rule_id || '","severity":"' || severity || '","start":' || start || '}}', ',' order by rule_id) as j from fired join rules using (rule_id) where rules.layer = 'policy' group by doc_id),
x as (select doc_id, string_agg('{{"priority":' || priority || ',"rule":"' || rule_id || '"}}', ',' order by priority, rule_id) as j from questions group by doc_id), s as (select doc_id, string_agg('"' || rule_id || '"', ',' order by rule_id) as j from quelled group by doc_id)
select d.doc_id, '{{"document":' || d.doc_id || ',"findings":[' || coalesce(f.j, '') || '],"questions":[' || coalesce(x.j, '') || '],"suppressed":[' || coalesce(s.j, '') || '],"version":"{DEFAULT.version}"}}' as json
from documents d left join f using (doc_id) left join x using (doc_id) left join s using (doc_id)""")
def check_json(t: Tables) -> DataFrame:
    """The whole result of each document as canonical JSON: members in the order of their names at every level."""
    findings = F.transform("findings", lambda x: F.struct(x["end"].alias("end"), x["rule_id"].alias("rule"), x["severity"].alias("severity"), x["start"].alias("start")))
    questions = F.transform("questions", lambda x: F.struct(x["priority"].alias("priority"), x["rule_id"].alias("rule")))
    found = check(t.documents, DEFAULT)
    return found.select("doc_id", canonical_json({"document": F.col("doc_id"), "findings": findings, "questions": questions, "suppressed": F.col("suppressed"), "version": F.col("catalog_version")}).alias("json"))


# --- two texts

#: Texts of fewer lines that share less than this of them are compared by pairs of characters.
FEW_LINES, RELATED = 4, 0.3


def overlaps(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, overlap, by`` of two texts each: the share of the smaller one's lines (or pairs of characters) that the other has too; 1 if one has none.

    Lines are compared without blanks at their ends and with single ones inside. Texts of under
    ``FEW_LINES`` lines that share less than ``RELATED`` of them fall back to pairs of neighbouring
    characters, repeats included, white space left out: counted by pair, side and characters, not in one array.
    """
    lines = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))

    def measured(p: Column) -> Column:
        smaller = F.least(F.size(p["a"]), F.size(p["b"]))
        share = F.when(smaller == 0, 1.0).otherwise(F.size(F.array_intersect(p["a"], p["b"])) / smaller)
        return F.struct(share.alias("lines"), ((smaller > 0) & (smaller < FEW_LINES) & (share < RELATED)).alias("falls"))

    # the line sets are bound by a lambda: each is made once a text
    both = pairs.select(key, F.col(a).alias("_a"), F.col(b).alias("_b"), F.transform(F.array(F.struct(lines(F.col(a)).alias("a"), lines(F.col(b)).alias("b"))), measured)[0].alias("_m"))

    def grams(c: str, side: str) -> Column:
        """Pairs of neighbouring characters from the list of characters: a substring would search its place from the start each time."""
        pair = lambda cs: F.transform(cs, lambda x, i: F.struct(F.lit(side).alias("_s"), F.concat(x, F.get(cs, i + 1)).alias("_g")))
        return F.transform(F.array(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S"), F.lit(0))), pair)[0]

    each = both.where("_m.falls").select(key, F.explode_outer(F.concat(grams("_a", "a"), grams("_b", "b"))).alias("_x")).select(key, "_x.*").where("_g is not null")
    counted = each.groupBy(key, "_g").agg(F.count_if(F.col("_s") == "a").alias("na"), F.count_if(F.col("_s") == "b").alias("nb"))
    shared = counted.groupBy(key).agg(F.sum(F.least("na", "nb")).alias("common"), F.least(F.sum("na"), F.sum("nb")).alias("least"))
    joined = both.select(key, "_m.lines", "_m.falls").join(shared, key, "left")
    by_grams = F.when(F.coalesce("least", F.lit(0)) == 0, 1.0).otherwise(F.greatest("lines", F.col("common") / F.col("least")))
    return joined.select(key, F.when(F.col("falls"), by_grams).otherwise(F.col("lines")).alias("overlap"), F.when(F.col("falls"), "pairs").otherwise("lines").alias("by"))


@query()
def text_overlap(t: Tables) -> DataFrame:
    """How much of the smaller of each document and the next the other has too, by lines or, where there are few, by pairs of characters."""
    following = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("following"))
    return overlaps(t.documents.select("doc_id", "text").join(following, "doc_id"), "doc_id", "text", "following").withColumn("overlap", F.round("overlap", 6))


# --- small ones


@query("select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as text from pages")
def untagged_pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", without_tags(F.col("html")).alias("text"))


@query("select doc_id, sha256(text) as hash from documents order by doc_id limit 100")
def first_records(t: Tables) -> DataFrame:
    """The first records by their id, no more than asked for."""
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash")).orderBy("doc_id").limit(100)
