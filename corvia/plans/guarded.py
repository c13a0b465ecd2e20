"""Queries on views of texts and on protective clauses."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.functions.text import IDENTIFIERS
from corvia.functions.views import ENDINGS, masked_in_view, match_view
from corvia.operators.rules import check, first_survivors, rule_matches, slot_status, viewed
from corvia.operators.spans import any_of, to_regex
from corvia.plans.catalog import CONTEXTED, GUARDED, VIEWED, Catalog
from corvia.plans.corpus import sql_mask
from corvia.plans.matching import FIRED, QUESTIONS, SLOTS, SQL_HEAD, SQL_LINES, VALUES_LINKS, patterns_of, q, sql_matches, sql_rules, sql_spans
from corvia.plans.registry import Tables, query

# --- views: texts are written with wide digits, a ligature and zero-width spaces before at signs; matching takes that back

DIGITS, WIDE, LIGATURE, ZERO = "0123456789", "０１２３４５６７８９", "ﬁ", "\u200b"


def spread(text: Column) -> Column:
    """The text in characters that normalisation takes back: some one for one, some that vanish, some that become two."""
    return F.replace(F.replace(F.translate(text, DIGITS, WIDE), F.lit("fi"), F.lit(LIGATURE)), F.lit("@"), F.lit(f"{ZERO}@"))


def sql_spread(text: str) -> str:
    return f"replace(replace(translate({text}, {q(DIGITS)}, {q(WIDE)}), 'fi', {q(LIGATURE)}), '@', chr(8203) || '@')"


_OLD = "|".join(old for old, _ in ENDINGS)
_EDGE = "[^a-zA-ZÀ-ÿ]"
_NEW = " ".join(f"when {q(old)} then {q(new)}" for old, new in ENDINGS)
#: The text with its endings rewritten, the places of each rewriting in both, and spans found there taken back to the plain text.
SQL_ENDINGS = f"""hits as materialized (
  select doc_id, i, gap, regexp_replace(m, '{_EDGE}$', '') as old, regexp_extract(m, '{_EDGE}$') as edge from (
    select doc_id, unnest(regexp_extract_all(text, '(?:{_OLD})(?:{_EDGE}|$)')) as m, unnest(string_split_regex(text, '(?:{_OLD})(?:{_EDGE}|$)')[:-2]) as gap, generate_subscripts(regexp_extract_all(text, '(?:{_OLD})(?:{_EDGE}|$)'), 1) as i from documents)
), edits as materialized (
  select doc_id, i, gap, edge, new, plain_end - length(edge) - length(old) as plain_start, plain_end - length(edge) as plain_end, view_end - length(edge) - length(new) as view_start, view_end - length(edge) as view_end from (
    select *, (sum(length(gap) + length(old) + length(edge)) over (partition by doc_id order by i))::bigint as plain_end, (sum(length(gap) + length(new) + length(edge)) over (partition by doc_id order by i))::bigint as view_end
    from (select *, case old {_NEW} end as new from hits))
), rewritten as materialized (
  select d.doc_id, coalesce(e.head, '') || substr(d.text, coalesce(e.at, 0) + 1) as text from documents d
  left join (select doc_id, string_agg(gap || new || edge, '' order by i) as head, max(plain_end + length(edge)) as at from edits group by doc_id) e using (doc_id)
)"""


def sql_view_spans(catalog: Catalog) -> str:
    """``sp``: spans of the source found in the source itself, expressions in the plain text, and literals in the rewritten one."""
    found = {p for r in catalog.rules for p in (*r.patterns, *(e.term for e in r.exclude), *(p for g in r.context for p in g.patterns))}
    literals = {to_regex(viewed(p)): to_regex(p) for p in found if not p.startswith("re:")}
    names = "case k " + " ".join(f"when {q(a)} then {q(b)}" for a, b in literals.items()) + " end"
    return f"""source as materialized (select doc_id, {sql_spread("text")} as text from documents), {SQL_ENDINGS},
{sql_spans(patterns_of(catalog), "sp_source", "source")},
{sql_spans(sorted(to_regex(p) for p in found if p.startswith("re:")), "sp_plain")},
{sql_spans(sorted(literals), "sp_view", "rewritten")},
back as (
  select {names} as k, s.doc_id, case when a.doc_id is null then s.start when s.start < a.view_end then a.plain_start else s.start - a.view_end + a.plain_end end as start,
    case when b.doc_id is null then s."end" when s."end" - 1 < b.view_end then b.plain_end else s."end" - b.view_end + b.plain_end end as "end"
  from (select *, "end" - 1 as last from sp_view) s asof left join edits a on s.doc_id = a.doc_id and s.start >= a.view_start asof left join edits b on s.doc_id = b.doc_id and s.last >= b.view_start
), sp as materialized (
  select k, doc_id, start, "end", substr(t.text, start + 1, "end" - start) as txt from (
    select k, doc_id, start, "end" from sp_source union
    select k, x.doc_id, (length({sql_spread('substr(d.text, 1, x.start::int + 1)')}) - 1)::int, length({sql_spread('substr(d.text, 1, x."end"::int)')})::int
    from (select k, doc_id, start, "end" from sp_plain union select * from back) x join documents d using (doc_id)
  ) join source t using (doc_id)
)"""


SQL_VIEWED = f"with {sql_matches(VIEWED, sql_view_spans(VIEWED))}"


@query(f'{SQL_VIEWED}, r as (select *, row_number() over (partition by doc_id, rule_id order by start, "end") as rn from left_over) select doc_id, rule_id, start, "end", txt from r where rn = 1')
def view_first_findings(t: Tables) -> DataFrame:
    """The first surviving match of each rule in texts of look-alikes, vanishing and expanding characters and rewritten endings: where it stands in the source."""
    return first_survivors(rule_matches(t.documents.select("doc_id", spread(F.col("text")).alias("text")), VIEWED, views=True))


@query(f'{SQL_VIEWED} select doc_id, rule_id, start, "end", txt from cands')
def view_candidates(t: Tables) -> DataFrame:
    found = rule_matches(t.documents.select("doc_id", spread(F.col("text")).alias("text")), VIEWED, views=True)
    return found.select("doc_id", "rule_id", F.explode("candidates").alias("c")).select("doc_id", "rule_id", "c.*")


@query(f"with {SQL_ENDINGS} select r.doc_id, r.text, coalesce(n, 0) as n_edits from rewritten r left join (select doc_id, count(*) as n from edits group by doc_id) using (doc_id)")
def match_views(t: Tables) -> DataFrame:
    """The view that literals are matched on, and how many endings are rewritten in it: a rewritten stretch is one source span that several characters share."""
    view = t.documents.select("doc_id", match_view(F.col("text")).alias("v"))
    stretches = F.array_distinct(F.filter(F.arrays_zip("v.starts", "v.ends"), lambda x: x["ends"] - x["starts"] > 1))
    return view.select("doc_id", F.col("v.text").alias("text"), F.size(stretches).cast("long").alias("n_edits"))


# --- protective clauses

SQL_GUARDED = f"with {sql_matches(GUARDED)}, {FIRED}, {sql_rules(GUARDED)}, {VALUES_LINKS}, {SLOTS}, {QUESTIONS}"


@query(f'{SQL_GUARDED} select rule_id, doc_id, start, "end", governed from gov')
def governed_candidates(t: Tables) -> DataFrame:
    """Each candidate of a protected rule, and whether a protective word governs its clause."""
    alone = replace(GUARDED, rules=tuple(replace(r, exclude=(), context=()) for r in GUARDED.rules))
    found = rule_matches(t.documents, alone).where(F.col("rule_id").isin([r.id for r in GUARDED.rules if r.protect]))
    each = found.select("doc_id", "rule_id", "survivors", F.explode("candidates").alias("c"))
    return each.select("doc_id", "rule_id", "c.start", "c.end", (~F.array_contains("survivors", F.col("c"))).alias("governed"))


@query(f"{SQL_GUARDED} select d.doc_id, (select count(*) from fired f where f.doc_id = d.doc_id and layer = 'policy')::int as n_findings, (select count(*) from questions x where x.doc_id = d.doc_id)::int as n_questions, (select count(*) from quelled x where x.doc_id = d.doc_id)::int as n_suppressed, coalesce((select string_agg(rule_id, ',' order by priority, rule_id) from questions x where x.doc_id = d.doc_id), '') as questions from documents d")
def guarded_check(t: Tables) -> DataFrame:
    """The whole check with protective clauses: a governed candidate is no finding, and a rule with no other is suppressed."""
    found = check(t.documents, GUARDED)
    return found.select("doc_id", F.col("counts.findings").alias("n_findings"), F.col("counts.questions").alias("n_questions"), F.col("counts.suppressed").alias("n_suppressed"), F.array_join(F.transform("questions", lambda x: x["rule_id"]), ",").alias("questions"))


# --- slots whose lines count in context

def sql_contexted() -> str:
    """Lines with the last heading before each; those of a block, and denied ones, do not count."""
    parts = []
    for s in (s for s in CONTEXTED.slots if s.context):
        c, vetoes = s.context, dict(s.context.vetoes)
        has = {k: f"(regexp_matches(line, {q(any_of(p))})" + (f" and not regexp_matches(line, {q(vetoes[k])})" if k in vetoes else "") + ")" for k, p in s.components}
        parts.append(
            f"select d.doc_id, {q(s.id)} as slot, b.doc_id is not null as found, coalesce(b.components, []) as components, b.no::int as line_no, b.line as unit from documents d left join ("
            f"select doc_id, list_filter([{', '.join(f'case when bool_or({x}) then {q(k)} end' for k, x in has.items())}], lambda x: x is not null) as components, arg_min(no, (-n, no)) as no, arg_min(line, (-n, no)) as line from ("
            f"select *, {' + '.join(f'{x}::int' for x in has.values())} as n from marked where regexp_matches(line, {q(any_of(s.accept))}) and not (regexp_matches(line, {q(c.deny)}) and not regexp_matches(line, {q(c.unless)})) "
            f"and not (not head and last_head is not null and regexp_matches(last_line, {q(c.block)}))) group by doc_id) b using (doc_id)"
        )
    return f"""{SQL_LINES}, headed as (select *, {SQL_HEAD} as head from lines),
marked as materialized (select *, max(case when head then line_no end) over w as last_head, arg_max(case when head then line end, case when head then line_no end) over w as last_line, line_no as no from headed window w as (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding)),
slots as materialized ({" union all ".join(parts)})"""


@query(f"with {sql_contexted()} select doc_id, slot, found, array_to_string(components, ',') as components, line_no, unit from slots")
def contexted_slots(t: Tables) -> DataFrame:
    """Slots found in lines that count: not in noise, unless marked, nor in a block below a heading of one word; a component that its veto forbids is not there."""
    status = slot_status(t.documents, replace(CONTEXTED, rules=(), slots=tuple(s for s in CONTEXTED.slots if s.context)))
    return status.select("doc_id", "slot", "found", F.array_join("components", ",").alias("components"), "line_no", "unit")


# --- masks on views


@query("select doc_id, replace(" + sql_spread(sql_mask("text", IDENTIFIERS)) + f", '[ipv{WIDE[4]}]', '[ipv4]') as masked from documents")
def view_masking(t: Tables) -> DataFrame:
    """Identifiers found in the normalised view and masked where they stand in the source, of which all else stays as it is written."""
    return t.documents.select("doc_id", masked_in_view(spread(F.col("text"))).alias("masked"))
