"""Queries on rules, spans, slots and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.functions.text import evidence, heading_key, snippet
from corvia.operators.clauses import REACH, SENTENCE_END
from corvia.operators.rules import check, first_survivors, matches, presence_rules, rule_matches, slot_status, suppressed
from corvia.operators.sections import label_units, lines, sections
from corvia.operators.spans import any_of, to_regex
from corvia.plans.catalog import DEFAULT, Catalog, ContextGroup, Rule
from corvia.plans.registry import Tables, query

# --- the same in DuckDB SQL, built from the catalog


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def patterns_of(catalog: Catalog) -> list[str]:
    return sorted({to_regex(p) for r in presence_rules(catalog) for p in (*r.patterns, *(e.term for e in r.exclude), *(p for g in r.context for p in g.patterns))})


def sql_spans(patterns: list[str], table: str = "sp", source: str = "documents") -> str:
    """``k, doc_id, start, end, txt`` of all matches, with offsets from the lengths of the pieces and matches before each."""
    each = " union all ".join(f"select {q(rx)} as k, doc_id, unnest(regexp_extract_all(text, {q(rx)})) as txt, unnest(string_split_regex(text, {q(rx)})[:-2]) as gap, generate_subscripts(regexp_extract_all(text, {q(rx)}), 1) as i from {source} where regexp_matches(text, {q(rx)})" for rx in patterns)
    return f"""{table} as materialized (select k, doc_id, (e - length(txt))::int as start, e::int as "end", txt from (select *, sum(length(gap) + length(txt)) over (partition by k, doc_id order by i) as e from ({each})))"""


def sql_within(window: int, overlap: bool = False, other: bool = False) -> str:
    return f"o.doc_id = c.doc_id and o.start >= c.start - {window} and o.\"end\" <= c.\"end\" + {window}" + (' and o.start < c."end" and o."end" > c.start' if overlap else "") + (' and (o.start <> c.start or o."end" <> c."end")' if other else "")


def among(patterns) -> str:
    return "(" + ", ".join(q(to_regex(p)) for p in patterns) + ")"


def sql_governed(catalog: Catalog) -> str:
    """``rule_id, doc_id, start, end, governed`` of the candidates of protected rules: sentence, clause, list items and nearest governor by pieces of the text on either side."""
    protected = [r for r in presence_rules(catalog) if r.protect]
    (p,) = {r.protect for r in protected}
    words, near = (lambda x: f"len(regexp_extract_all({x}, '\\S+'))"), lambda rx: f"least(case when len(string_split_regex(l, {q(rx)})) > 1 then length(string_split_regex(l, {q(rx)})[-1]) end, case when len(string_split_regex(r, {q(rx)})) > 1 then length(string_split_regex(r, {q(rx)})[1]) end)"
    return f"""g0 as (
  select c.*, right(string_split_regex(substr(d.text, 1, c.start), {q(SENTENCE_END)})[-1], {REACH}) as sl, string_split_regex(left(substr(d.text, c."end" + 1), {REACH}), {q(SENTENCE_END)})[1] as sr
  from cands c join documents d using (doc_id) where c.rule_id in ({", ".join(q(r.id) for r in protected)})
), g1 as (
  select *, string_split(string_split_regex(sl, {q(p.breaks)})[-1], ',') as ll, string_split(string_split_regex(sr, {q(p.breaks)})[1], ',') as rr from g0
), g2 as (
  select *, case when {words("ll[-1] || txt || rr[1]")} <= {p.item_words} then coalesce(list_max(list_filter(range(1, len(ll)), lambda i: {words("ll[i]")} > {p.item_words})), 1) else len(ll) end as j,
    coalesce(list_min(list_filter(range(2, len(rr) + 1), lambda i: {words("rr[i]")} > {p.item_words})), len(rr) + 1) as m from g1
), g3 as (
  select *, ' ' || array_to_string(ll[j:], ',') || ' ' as l, ' ' || array_to_string(rr[1:m - 1], ',') || ' ' as r, ' ' || sr || ' ' as after from g2
), gov as materialized (
  select rule_id, doc_id, start, "end", case when regexp_matches(r, {q(p.indifferent)}) then not regexp_matches(substr(after, length(string_split_regex(r, {q(p.indifferent)})[1]) + length(regexp_extract(r, {q(p.indifferent)}))), {q(p.contrast)})
    else coalesce({near(p.protect)} <= coalesce({near(p.require)}, 100000), false) end as governed from g3
)"""


def sql_matches(catalog: Catalog = DEFAULT, spans: str | None = None) -> str:
    """``cands`` and ``left_over`` of a catalog, from the spans ``sp`` of its patterns."""
    cands, left = [], []
    for r in presence_rules(catalog):
        cands.append(f'select distinct {q(r.id)} as rule_id, {q(r.layer)} as layer, doc_id, start, "end", txt from sp where k in {among(r.patterns)}')
        tests = [f"c.rule_id = {q(r.id)}"]
        if r.protect:
            tests.append('not exists (select 1 from gov g where g.governed and g.rule_id = c.rule_id and g.doc_id = c.doc_id and g.start = c.start and g."end" = c."end")')
        for e in r.exclude:
            cand = f" and regexp_matches(c.txt, {q(to_regex(e.candidate))})" if e.candidate else ""
            tests.append(f"not exists (select 1 from sp o where o.k = {q(to_regex(e.term))} and {sql_within(e.window, e.overlap)}{cand})")
        for g in r.context:
            tests.append(f"exists (select 1 from sp o where o.k in {among(g.patterns)} and {sql_within(g.window, other=True)})")
        left.append(f"select * from cands c where {' and '.join(tests)}")
    guard = f", {sql_governed(catalog)}" if any(r.protect for r in catalog.rules) else ""
    return f"{spans or sql_spans(patterns_of(catalog))}, cands as materialized ({' union all '.join(cands)}){guard}, left_over as materialized ({' union all '.join(left)})"


def sql_rules(catalog: Catalog) -> str:
    return "rules(rule_id, layer, dimension, severity, trigger, slot, scope, statute, article) as (values " + ", ".join("(" + ", ".join(q(x) if x else "null" for x in (r.id, r.layer, r.dimension, r.severity, r.trigger, r.slot, r.scope, r.statute, r.article)) + ")" for r in catalog.rules) + ")"


MATCHES = sql_matches()
FIRED = """fired as materialized (select doc_id, rule_id, layer, start, "end", l.txt, text from (select *, row_number() over (partition by doc_id, rule_id order by start, "end") as rn from left_over) l join documents using (doc_id) where rn = 1),
quelled as (select distinct doc_id, rule_id from cands where (doc_id, rule_id) not in (select (doc_id, rule_id) from left_over))"""
VALUES_RULES = sql_rules(DEFAULT)
VALUES_LINKS = "links(rule_id, question) as (values " + ", ".join(f"({q(r.id)}, {q(x)})" for r in DEFAULT.rules for x in r.related) + ")"
VALUES_ARTICLES = "articles(statute, article, title, effective) as (values " + ", ".join(f"({q(a.statute)}, {q(a.article)}, {q(a.title)}, {q(a.effective)})" for a in DEFAULT.articles) + ")"


def sql_slots() -> str:
    parts = []
    for s in DEFAULT.slots:
        acc = q(any_of(s.accept))
        n = " + ".join(f"regexp_matches(line, {q(any_of(p))})::int" for _, p in s.components)
        comps = ", ".join(f"case when regexp_matches(text, {q(any_of(p))}) then {q(k)} end" for k, p in s.components)
        parts.append(
            f"select doc_id, {q(s.id)} as slot, regexp_matches(text, {acc}) as found, case when regexp_matches(text, {acc}) then list_filter([{comps}], lambda x: x is not null) else [] end as components, b.no::int as line_no, b.line as unit "
            f"from documents d left join (select doc_id, no, line from (select *, row_number() over (partition by doc_id order by {n} desc, no) as rn from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from documents) where regexp_matches(line, {acc})) where rn = 1) b using (doc_id)"
        )
    return "slots as materialized (" + " union all ".join(parts) + ")"


SLOTS = sql_slots()
QUESTIONS = """asked as (
  select doc_id, rule_id, 2 as p from fired where layer = 'question'
  union all select s.doc_id, r.rule_id, 3 from slots s join rules r on r.slot = s.slot where not s.found
), linked as (
  select distinct f.doc_id, l.question as rule_id from fired f join links l using (rule_id) where f.layer = 'policy'
), free_links as (
  select * from linked where (doc_id, rule_id) not in (select (doc_id, rule_id) from quelled)
), questions as (
  select doc_id, rule_id, case when bool_or(p = 1) then 1 when bool_or(scope = 'common') then 4 else min(p) end as priority
  from (select doc_id, rule_id, 1 as p from free_links union all select * from asked) join rules using (rule_id) group by doc_id, rule_id
)"""
ALL = f"{MATCHES}, {FIRED}, {VALUES_RULES}, {VALUES_LINKS}, {SLOTS}, {QUESTIONS}"


@query(f'with {MATCHES}, {FIRED}, {VALUES_RULES} select doc_id, rule_id, severity, start, "end", txt from fired join rules using (rule_id) where rules.layer = \'policy\'')
def rule_findings(t: Tables) -> DataFrame:
    """The flagship: the first surviving match of each policy rule in each document."""
    rules = DEFAULT.rule_table(t.spark).where("layer = 'policy'").select("rule_id", "severity")
    return first_survivors(rule_matches(t.documents, DEFAULT)).join(F.broadcast(rules), "rule_id").select("doc_id", "rule_id", "severity", "start", "end", "txt")


@query("select doc_id, rule_id from (" + " union all ".join(f"select doc_id, {q(r.id)} as rule_id from documents where regexp_matches(text, {q(any_of(r.patterns))})" for r in presence_rules(DEFAULT)) + ")")
def rule_presence(t: Tables) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(any_of(r.patterns)), F.lit(r.id)) for r in presence_rules(DEFAULT)]))
    return t.documents.select("doc_id", F.explode(hits).alias("rule_id"))


@query(f'with {MATCHES} select doc_id, rule_id, start, "end", txt from cands')
def rule_spans(t: Tables) -> DataFrame:
    return rule_matches(t.documents, DEFAULT).select("doc_id", "rule_id", F.explode("candidates").alias("c")).select("doc_id", "rule_id", "c.*")


@query(f'with {MATCHES} select doc_id, rule_id, min(start) as start, arg_min(txt, (start, "end")) as txt from cands group by doc_id, rule_id')
def first_match(t: Tables) -> DataFrame:
    return rule_matches(t.documents, DEFAULT).select("doc_id", "rule_id", F.col("candidates")[0]["start"].alias("start"), F.col("candidates")[0]["txt"].alias("txt"))


@query(f"with {MATCHES}, l as (select doc_id, rule_id, count(*) as n from left_over group by doc_id, rule_id) select doc_id, rule_id, count(*)::int as n_candidates, (count(*) - coalesce(any_value(l.n), 0))::int as n_excluded from cands left join l using (doc_id, rule_id) group by doc_id, rule_id having count(*) > coalesce(any_value(l.n), 0)")
def excluded_candidates(t: Tables) -> DataFrame:
    n, left = F.size("candidates"), F.size("survivors")
    return rule_matches(t.documents, DEFAULT).where(n > left).select("doc_id", "rule_id", n.alias("n_candidates"), (n - left).alias("n_excluded"))


@query(f"with {MATCHES}, {FIRED} select doc_id, rule_id from quelled")
def suppressed_rules(t: Tables) -> DataFrame:
    return suppressed(rule_matches(t.documents, DEFAULT))


CONTEXT = r"[*#&%$]{3}"


@query(f"""with {sql_spans([CONTEXT, '%%%', '&&&'])}, c as (select * from sp where k = {q(CONTEXT)})
select doc_id, count(*) as n, count(*) filter (exists (select 1 from sp o where o.k = '%%%' and {sql_within(40, other=True)}) and exists (select 1 from sp o where o.k = '&&&' and {sql_within(40, other=True)})) as n_in_context from c group by doc_id""")
def context_groups(t: Tables) -> DataFrame:
    """Noise marks that have both of two other marks within 40 code points."""
    rule = Rule("X-NOISE", "question", "style", "low", "presence", (f"re:{CONTEXT}",), context=(ContextGroup("a", ("re:%%%",), 40), ContextGroup("b", ("re:&&&",), 40)))
    found = t.documents.select("doc_id", F.explode(matches(F.col("text"), [rule])).alias("m"))
    return found.select("doc_id", F.size("m.candidates").cast("long").alias("n"), F.size("m.survivors").cast("long").alias("n_in_context"))


SQL_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents), placed as (select *, (coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0))::int as start from lines)"
SQL_HEAD = r"(length(trim(line)) > 0 and len(string_split_regex(trim(line), '\s+')) <= 2)"
SQL_KEY = r"lower(regexp_replace(regexp_replace(line, '^[\s#*=>.:\[\]()-]+|[\s#*=<.:\[\]()-]+$', '', 'g'), '\s+', '', 'g'))"
SQL_SECTIONS = f"""{SQL_LINES}, marked as (select *, {SQL_HEAD} as head from placed), grouped as (select *, (sum(head::int) over (partition by doc_id order by line_no))::int as section_no from marked),
found as (select doc_id, section_no, max(case when head then {SQL_KEY} end) as name, min(start) as start, max(start + length(line)) as last from grouped group by doc_id, section_no),
sections as (select doc_id, section_no, coalesce(name, 'all') as name, start, coalesce(lead(start) over (partition by doc_id order by section_no), last)::int as "end" from found)"""


@query(f"with {SQL_SECTIONS} select * from sections")
def sections_of(t: Tables) -> DataFrame:
    return sections(t.documents)


@query(f"with {SQL_LINES} select doc_id, line_no::int as line_no, {SQL_KEY} as key from placed where {SQL_HEAD}")
def heading_lines(t: Tables) -> DataFrame:
    words = F.size(F.split(F.trim("line"), r"\s+"))
    return lines(t.documents).where((F.length(F.trim("line")) > 0) & (words <= 2)).select("doc_id", "line_no", heading_key(F.col("line")).alias("key"))


@query(f'with {SQL_SECTIONS}, {MATCHES}, {FIRED} select f.doc_id, f.rule_id, f.start, s.name as section from fired f join sections s on f.doc_id = s.doc_id and f.start >= s.start and f.start < s."end"')
def span_sections(t: Tables) -> DataFrame:
    """The section of each finding: an equi-join on the document with a range test."""
    found = first_survivors(rule_matches(t.documents, DEFAULT)).alias("f")
    return found.join(sections(t.documents).alias("s"), F.expr('f.doc_id = s.doc_id and f.start >= s.start and f.start < s.end')).select("f.doc_id", "f.rule_id", "f.start", F.col("s.name").alias("section"))


@query(f"with {MATCHES}, {FIRED}, {VALUES_RULES}, {VALUES_ARTICLES} select f.doc_id, f.rule_id, r.statute, r.article, a.title, a.effective from fired f join rules r using (rule_id) join articles a on a.statute = r.statute and a.article = r.article")
def finding_basis(t: Tables) -> DataFrame:
    bases = DEFAULT.rule_table(t.spark).join(DEFAULT.article_table(t.spark), ["statute", "article"]).select("rule_id", "statute", "article", "title", "effective")
    return first_survivors(rule_matches(t.documents, DEFAULT)).join(F.broadcast(bases), "rule_id").select("doc_id", "rule_id", "statute", "article", "title", "effective")


@query(f"with {SLOTS}, {VALUES_RULES} select s.doc_id, r.rule_id from slots s join rules r on r.slot = s.slot where not s.found")
def rule_absence(t: Tables) -> DataFrame:
    rules = DEFAULT.rule_table(t.spark).where("trigger = 'absence'").select("rule_id", "slot")
    return slot_status(t.documents, DEFAULT).where("not found").join(F.broadcast(rules), "slot").select("doc_id", "rule_id")


@query(f"with {SLOTS} select doc_id, slot, found, array_to_string(components, ',') as components from slots")
def slot_statuses(t: Tables) -> DataFrame:
    return slot_status(t.documents, DEFAULT).select("doc_id", "slot", "found", F.array_join("components", ",").alias("components"))


@query(f"with {SLOTS} select doc_id, slot, line_no, unit from slots where unit is not null")
def best_slot_unit(t: Tables) -> DataFrame:
    return slot_status(t.documents, DEFAULT).where("unit is not null").select("doc_id", "slot", "line_no", "unit")


@query(f"with {SQL_LINES}, n as (select *, lead(line) over (partition by doc_id order by line_no) as next from placed) select doc_id, line_no::int as line_no, case when trim(regexp_replace(line, '(?i)licensed under [^.]*\\.?', '')) = '' and next is not null then line || chr(10) || next else line end as unit from n where regexp_matches(line, '(?i)licensed under [^.]*\\.?')")
def slot_units(t: Tables) -> DataFrame:
    return label_units(t.documents, r"(?i)licensed under [^.]*\.?")


@query(f"with {ALL} select d.doc_id, (select count(*) from fired f where f.doc_id = d.doc_id and layer = 'policy')::int as n_findings, (select count(*) from questions x where x.doc_id = d.doc_id)::int as n_questions, (select count(*) from quelled x where x.doc_id = d.doc_id)::int as n_suppressed, (select count(*) from slots x where x.doc_id = d.doc_id and not found)::int as n_not_found, coalesce((select string_agg(rule_id, ',' order by priority, rule_id) from questions x where x.doc_id = d.doc_id), '') as questions from documents d")
def check_result(t: Tables) -> DataFrame:
    found = check(t.documents, DEFAULT)
    return found.select("doc_id", F.col("counts.findings").alias("n_findings"), F.col("counts.questions").alias("n_questions"), F.col("counts.suppressed").alias("n_suppressed"), F.col("counts.not_found").alias("n_not_found"), F.array_join(F.transform("questions", lambda x: x["rule_id"]), ",").alias("questions"))


@query(f"with {ALL} select 'findings' as kind, count(*) as n from fired where layer = 'policy' union all select 'questions', count(*) from questions union all select 'suppressed', count(*) from quelled union all select 'not_found', count(*) from slots where not found")
def result_counts(t: Tables) -> DataFrame:
    sums = check(t.documents, DEFAULT).agg(*[F.sum(f"counts.{k}").alias(k) for k in ("findings", "questions", "suppressed", "not_found")])
    return sums.unpivot([], ["findings", "questions", "suppressed", "not_found"], "kind", "n")


@query(f"with {ALL} select doc_id, rule_id from free_links")
def linked_questions(t: Tables) -> DataFrame:
    """Questions that findings pull in, but not those that are suppressed."""
    matches = rule_matches(t.documents, DEFAULT)
    rules = DEFAULT.rule_table(t.spark).where("layer = 'policy'").select("rule_id", F.explode("related").alias("question"))
    linked = first_survivors(matches).join(F.broadcast(rules), "rule_id").select("doc_id", F.col("question").alias("rule_id")).distinct()
    return linked.join(suppressed(matches), ["doc_id", "rule_id"], "left_anti")


@query(f"with {ALL} select doc_id, rule_id, priority::int as priority from questions")
def question_priority(t: Tables) -> DataFrame:
    return check(t.documents, DEFAULT).select("doc_id", F.explode_outer("questions").alias("x")).where("x is not null").select("doc_id", "x.rule_id", "x.priority")


@query(f"with {ALL}, answers as (select doc_id, case when toxic = 1 then 'Q-SHOUT' else 'Q-LINK' end as rule_id, 'quality ' || quality as answer from labels) select q.doc_id, q.rule_id, a.answer from questions q left join answers a using (doc_id, rule_id)")
def saved_answers(t: Tables) -> DataFrame:
    """Questions with the saved answer of their document, null where there is none."""
    answers = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "Q-SHOUT").otherwise("Q-LINK").alias("rule_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("answer"))
    asked = check(t.documents, DEFAULT).select("doc_id", F.explode_outer("questions").alias("x")).where("x is not null").select("doc_id", "x.rule_id")
    return asked.join(answers, ["doc_id", "rule_id"], "left")


SQL_EVIDENCE = """with {M}, {F}, b as (select *, string_split(substr(text, 1, start), chr(10))[-1] as tail, string_split(substr(text, "end" + 1), chr(10))[1] as rest from fired), l as (select *, tail || txt || rest as line, greatest(0, length(tail) - 96) as skip from b)
select doc_id, rule_id, case when skip > 0 then '…' else '' end || substr(line, skip + 1, 238) || case when length(line) > skip + 238 then '…' else '' end as evidence from l"""


@query(SQL_EVIDENCE.format(M=MATCHES, F=FIRED))
def evidence_snippet(t: Tables) -> DataFrame:
    found = first_survivors(rule_matches(t.documents, DEFAULT)).join(t.documents.select("doc_id", "text"), "doc_id")
    return found.select("doc_id", "rule_id", evidence(F.col("text"), F.col("start"), F.col("end")).alias("evidence"))


@query(f'with {MATCHES}, {FIRED} select doc_id, rule_id, substr(text, greatest(1, start + 1 - 40), least(start, 40) + "end" - start + 40) as context from fired')
def context_snippet(t: Tables) -> DataFrame:
    found = first_survivors(rule_matches(t.documents, DEFAULT)).join(t.documents.select("doc_id", "text"), "doc_id")
    return found.select("doc_id", "rule_id", snippet(F.col("text"), F.col("start"), F.col("end"), 40).alias("context"))
