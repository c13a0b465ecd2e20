"""The rule engine: candidates, protective clauses, exclusions, context, first survivors, slots, questions, with no shuffle.

Which rules a document can match at all is a JVM expression each; only documents with any go to an Arrow UDF,
which scans for those rules with compiled expressions and bisects the sorted spans of exclusions and
context, so that a text with very many matches costs no more than in proportion. Where views are asked for,
a text is also scanned as normalised and rewritten, and spans are those of the source. All else is column
algebra on the same row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.functions.text import evidence
from corvia.functions.views import ending_view, has_ending, is_plain, normal_view, same
from corvia.operators.clauses import Sentences, governed
from corvia.operators.sections import is_short_heading
from corvia.operators.spans import any_of, to_regex

if TYPE_CHECKING:
    from corvia.plans.catalog import Catalog, Rule, Slot

SPANS = "array<struct<start:int,end:int,txt:string>>"
MATCHES = f"array<struct<rule_id:string,candidates:{SPANS},survivors:{SPANS}>>"
#: Spans that a scan holds, as Python objects, before it hands them on; those of one text stay together.
MOST_SPANS = 1 << 14


@lru_cache(4096)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(to_regex(pattern))


class Texts:
    """A source with the views that differ from it, and the spans found in all of them."""

    def __init__(self, source: str, views: bool = False):
        plain = same(source)
        self.source, self.normal = source, plain.then(normal_view) if views else plain
        self.match = self.normal.then(ending_view) if views else plain
        self.found: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        self._sentences: Sentences | None = None

    @property
    def sentences(self) -> Sentences:
        if not self._sentences:
            self._sentences = Sentences(self.source)
        return self._sentences

    def spans(self, patterns: tuple[str, ...]) -> list[tuple[int, int]]:
        """The non-empty matches of several patterns, each span once, by (start, end): expressions on the normalised text, literals on that with its endings rewritten, all on the source."""
        if patterns not in self.found:
            out = {m.span() for p in patterns for m in _compiled(p).finditer(self.source) if m.end() > m.start()}
            for p in patterns:
                view = self.normal if p.startswith("re:") else self.match
                if view.text != self.source:
                    seen = _compiled(p if p.startswith("re:") else viewed(p))
                    out |= {view.span(*m.span()) for m in seen.finditer(view.text) if m.end() > m.start()}
            self.found[patterns] = sorted(out)
        return self.found[patterns]


@lru_cache(4096)
def viewed(literal: str) -> str:
    """A literal as it is written in the view that literals are matched on."""
    return same(literal).then(normal_view).then(ending_view).text


def near(span: tuple[int, int], others: list[tuple[int, int]], window: int, overlap: bool = False, other: bool = False) -> bool:
    """Whether one of the sorted ``others`` lies wholly within ``window`` of the span; ``overlap``: and shares a character with it; ``other``: and is not the span itself."""
    low, high = span[0] - window, span[1] + window
    for i in range(bisect_left(others, (low, -1)), len(others)):
        start, end = others[i]
        if start > high or overlap and start >= span[1]:
            return False
        if end <= high and (not overlap or end > span[0]) and not (other and (start, end) == span):
            return True
    return False


def match_text(text: str | Texts, rule: Rule) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """A rule's candidates in a text, and those that no protective word governs and no exclusion covers and that have every context group around them."""
    text = Texts(text) if isinstance(text, str) else text
    found = left = text.spans(rule.patterns)
    if found:
        if rule.protect:
            left = [c for c in left if not governed(text.sentences, *c, rule.protect)]
        for e in rule.exclude:
            terms = text.spans((e.term,))
            left = [c for c in left if not ((not e.candidate or _compiled(e.candidate).search(text.source[c[0] : c[1]])) and near(c, terms, e.window, e.overlap))]
        for g in rule.context:
            terms = text.spans(g.patterns)
            left = [c for c in left if near(c, terms, g.window, other=True)]
    return found, left


def scanned(batches: Iterator[pd.DataFrame], rules: list[Rule], views: bool = False) -> Iterator[pd.Series]:
    """What the rules of each row's ``numbers`` find in its ``text``, in the order of the rows; a batch of texts with many spans comes in several parts."""
    def one(text: str | None, which) -> list:
        if not isinstance(text, str):
            return []
        seen = Texts(text, views)
        named = lambda spans: [{"start": a, "end": b, "txt": text[a:b]} for a, b in spans]
        each = ((rules[i].id, *match_text(seen, rules[i])) for i in which)
        return [{"rule_id": k, "candidates": named(found), "survivors": named(left)} for k, found, left in each if found]

    for batch in batches:
        rows, n = [], 0
        for text, which in zip(batch.text, batch.numbers):
            rows.append(one(text, which))
            n += sum(len(m["candidates"]) + len(m["survivors"]) for m in rows[-1])
            if n >= MOST_SPANS:
                yield pd.Series(rows)
                rows, n = [], 0
        if rows:
            yield pd.Series(rows)


def matches(text: Column, rules: list[Rule], views: bool = False) -> Column:
    """``rule_id, candidates, survivors`` of each rule with candidates, in the order of the rules."""
    def may_match(r: Rule) -> Column:
        if r.needs:  # looked for as they are, which costs far less than an expression
            return reduce(or_, [F.contains(text, F.lit(x)) for x in r.needs])
        return text.rlike(any_of(r.patterns))

    may = F.array_compact(F.array(*[F.when(may_match(r), F.lit(i)) for i, r in enumerate(rules)]))
    if views:  # a text that has views may match in them alone
        may = F.when(~is_plain(text) | has_ending(text), F.array(*[F.lit(i) for i in range(len(rules))])).otherwise(may)

    @F.pandas_udf(MATCHES)
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        return scanned(batches, rules, views)

    # the numbers are bound once by a lambda; the scan is not to be evaluated again in the filters that Spark infers from an explode
    asked = F.transform(F.array(may), lambda n: F.struct(F.when(F.size(n) > 0, text).alias("text"), n.alias("numbers")))[0]
    return scan.asNondeterministic()(asked)


def presence_rules(catalog: Catalog) -> list[Rule]:
    return [r for r in catalog.rules if r.trigger == "presence"]


def rule_matches(docs: DataFrame, catalog: Catalog, id_col: str = "doc_id", text_col: str = "text", views: bool = False) -> DataFrame:
    """``doc_id, rule_id, candidates, survivors`` of each document and presence rule with candidates; with ``views``, also of what is only seen in a text's views."""
    found = docs.select(id_col, matches(F.col(text_col), presence_rules(catalog), views).alias("_m"))
    return found.select(id_col, F.explode("_m").alias("m")).select(id_col, "m.*")


def first_survivors(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, rule_id, start, end, txt``: a rule fires at its first survivor."""
    return matches.where(F.size("survivors") > 0).select(id_col, "rule_id", F.col("survivors")[0].alias("s")).select(id_col, "rule_id", "s.*")


def suppressed(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, rule_id``: rules with candidates none of which survives."""
    return matches.where(F.size("survivors") == 0).select(id_col, "rule_id")


def slot_in_context(text: Column, slot: Slot) -> Column:
    """The same for a slot whose lines count in context alone: components and the best line come from lines that are accepted and allowed."""
    c, vetoes = slot.context, dict(slot.context.vetoes)
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"), is_short_heading(x).alias("head")))
    heads = F.transform(F.filter(lines, lambda u: u["head"]), lambda u: F.struct(u["i"].alias("i"), u["x"].rlike(c.block).alias("opens")))
    accepted = F.filter(lines, lambda u: u["x"].rlike(any_of(slot.accept)) & ~(u["x"].rlike(c.deny) & ~u["x"].rlike(c.unless)))

    def in_block(u: Column) -> Column:
        return ~u["head"] & F.coalesce(F.array_max(F.filter(heads, lambda h: h["i"] < u["i"]))["opens"], F.lit(False))

    def has(line: Column, name: str, patterns: tuple[str, ...]) -> Column:
        return line.rlike(any_of(patterns)) & (~line.rlike(vetoes[name]) if name in vetoes else F.lit(True))

    allowed = F.filter(accepted, lambda u: ~in_block(u))
    count = lambda line: sum((has(line, k, p).cast("int") for k, p in slot.components), F.lit(0))
    best = F.array_max(F.transform(allowed, lambda u: F.struct(count(u["x"]).alias("n"), (-u["i"]).alias("o"), u["x"].alias("line"))))
    empty = F.array().cast("array<string>")
    shown = lambda name, patterns: F.when(F.exists(allowed, lambda u: has(u["x"], name, patterns)), F.lit(name))
    present = F.array_compact(F.array(*[shown(k, p) for k, p in slot.components])) if slot.components else empty
    return F.struct(F.lit(slot.id).alias("slot"), best.isNotNull().alias("found"), present.alias("components"), (-best["o"]).cast("int").alias("line_no"), best["line"].alias("unit"))


def slot_columns(text: Column, slot: Slot) -> Column:
    """``slot, found, components, line, unit``: the best unit is the first line with the most components among the lines that are accepted."""
    if slot.context:
        return slot_in_context(text, slot)
    accept = any_of(slot.accept)
    units = F.split(text, "\n", -1)

    def rank(line: Column, i: Column) -> Column:
        n = sum((line.rlike(any_of(p)).cast("int") for _, p in slot.components), F.lit(0))
        return F.struct(n.alias("n"), (-i).alias("o"), line.alias("line"))

    best = F.array_max(F.transform(F.filter(F.transform(units, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda u: u["x"].rlike(accept)), lambda u: rank(u["x"], u["i"])))
    present = F.array_compact(F.array(*[F.when(text.rlike(any_of(p)), F.lit(k)) for k, p in slot.components])) if slot.components else F.array().cast("array<string>")
    found = text.rlike(accept)
    if not re.search(r"[\^$]|\\[AZz]", accept):  # without anchors, a line cannot be accepted unless the text is
        best = F.when(found, best)
    empty = F.array().cast("array<string>")
    return F.struct(F.lit(slot.id).alias("slot"), found.alias("found"), F.when(found, present).otherwise(empty).alias("components"), (-best["o"]).cast("int").alias("line_no"), best["line"].alias("unit"))


def slot_status(docs: DataFrame, catalog: Catalog, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, slot, found, components, line_no, unit`` for every document and slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, F.explode(F.array(*[slot_columns(text, s) for s in catalog.slots])).alias("s")).select(id_col, "s.*")


def check(docs: DataFrame, catalog: Catalog, id_col: str = "doc_id", text_col: str = "text", views: bool = False) -> DataFrame:
    """The whole check of each document in one projection.

    ``findings`` (rule_id, severity, start, end, txt, evidence, statute, article) by rule id; ``suppressed``
    rule ids; ``slots``; ``questions`` (priority, rule_id) by priority and id: 1 if a finding links to it
    and it is not suppressed, 4 for common ones, 2 if its own pattern fired, 3 if its slot is missing;
    ``counts``. A null text is an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rules = presence_rules(catalog)
    found = docs.select(id_col, text.alias("_t"), matches(text, rules, views).alias("_m"), F.array(*[slot_columns(text, s) for s in catalog.slots]).alias("slots"))
    fired = F.transform(F.filter("_m", lambda m: F.size(m["survivors"]) > 0), lambda m: m["rule_id"])
    quelled = F.transform(F.filter("_m", lambda m: F.size(m["survivors"]) == 0), lambda m: m["rule_id"])
    found = found.select("*", fired.alias("_fired"), F.array_sort(quelled).alias("suppressed"))
    policies = {r.id: F.struct(F.lit(r.severity).alias("severity"), F.lit(r.statute).alias("statute"), F.lit(r.article).alias("article")) for r in rules if r.layer == "policy"}
    basis = F.create_map(*[x for k, v in policies.items() for x in (F.lit(k), v)])

    def finding(m: Column) -> Column:
        s, b = m["survivors"][0], basis[m["rule_id"]]
        return F.struct(m["rule_id"].alias("rule_id"), b["severity"].alias("severity"), s["start"].alias("start"), s["end"].alias("end"), s["txt"].alias("txt"), evidence(F.col("_t"), s["start"], s["end"]).alias("evidence"), b["statute"].alias("statute"), b["article"].alias("article"))

    def question(q: Rule) -> Column:
        linkers = [r.id for r in rules if r.layer == "policy" and q.id in r.related]
        linked = F.arrays_overlap("_fired", F.array(*map(F.lit, linkers))) if linkers else F.lit(False)
        own = F.array_contains("_fired", q.id) if q.trigger == "presence" else F.exists("slots", lambda s: (s["slot"] == q.slot) & ~s["found"])
        priority = F.when(linked & ~F.array_contains("suppressed", q.id), 1).when(own & F.lit(q.scope == "common"), 4).when(own, 2 if q.trigger == "presence" else 3)
        return F.when(priority.isNotNull(), F.struct(priority.cast("int").alias("priority"), F.lit(q.id).alias("rule_id")))

    findings = F.array_sort(F.transform(F.filter("_m", lambda m: (F.size(m["survivors"]) > 0) & m["rule_id"].isin(list(policies))), finding))
    questions = F.array_sort(F.array_compact(F.array(*[question(r) for r in catalog.rules if r.layer == "question"])))
    out = found.select(id_col, findings.alias("findings"), "suppressed", "slots", questions.alias("questions"))
    counts = F.struct(F.size("findings").alias("findings"), F.size("questions").alias("questions"), F.size("suppressed").alias("suppressed"), F.size(F.filter("slots", lambda s: ~s["found"])).alias("not_found"))
    return out.withColumn("counts", counts).withColumn("catalog_version", F.lit(catalog.version))
