"""Guidance catalogs: sources, controls that lead from questions to them, profiles that say whom they concern; and what follows for documents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields, replace
from datetime import date
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.operators.rules import check, first_survivors, rule_matches
from corvia.plans.catalog import DEFAULT, Catalog, CatalogError
from corvia.plans.matching import ALL, FIRED, MATCHES, VALUES_ARTICLES, VALUES_RULES, q
from corvia.plans.registry import Tables, query

KINDS, CONTROL_SCOPES = ("law", "guidance"), ("all", "public")


@dataclass(frozen=True)
class Source:
    id: str
    title: str
    publisher: str
    url: str
    kind: str
    accessed: str
    published: str | None = None


@dataclass(frozen=True)
class Control:
    id: str
    scope: str
    title: str
    questions: tuple[str, ...]
    sources: tuple[str, ...]


@dataclass(frozen=True)
class Profile:
    id: str
    title: str
    sources: tuple[str, ...]


@dataclass(frozen=True)
class Guidance:
    as_of: str
    hosts: tuple[str, ...]
    sources: tuple[Source, ...]
    controls: tuple[Control, ...]
    profiles: tuple[Profile, ...]

    def __post_init__(self) -> None:
        problems = list(self.problems())
        if problems:
            raise CatalogError("; ".join(problems))

    def problems(self, questions: frozenset[str] | None = None) -> Iterable[str]:
        """Every breach: repeated ids, enumerations, dates, addresses, links to nothing, repeated or empty lists."""
        for what, rows in (("source", self.sources), ("control", self.controls), ("profile", self.profiles)):
            ids = [r.id for r in rows]
            yield from (f"{what} {x}: repeated id" for x in sorted({i for i in ids if ids.count(i) > 1}))
            yield from (f"{what} {r.id or '?'}: {f.name} is empty" for r in rows for f in fields(r) if getattr(r, f.name) in ("", ()))
        yield from (f"no {what}s" for what in ("source", "control", "profile") if not getattr(self, f"{what}s"))
        known = {s.id for s in self.sources}
        for when, where in [(self.as_of, "as_of")] + [(x, s.id) for s in self.sources for x in (s.accessed, s.published) if x]:
            try:
                if date.fromisoformat(when).isoformat() != when or where != "as_of" and when > self.as_of:
                    yield f"{where}: {when} is written otherwise or after {self.as_of}"
            except ValueError:
                yield f"{where}: not a date: {when}"
        for s in self.sources:
            parts = urlsplit(s.url)
            host = (parts.hostname or "").lower()
            if parts.scheme != "https" or not any(host == h or host.endswith(f".{h}") for h in self.hosts) or parts.username or parts.password or parts.fragment:
                yield f"{s.id}: not an address of a publisher: {s.url}"
            if s.kind not in KINDS:
                yield f"{s.id}: {s.kind!r} is none of {KINDS}"
        for row in (*self.controls, *self.profiles):
            yield from (f"{row.id}: unknown source {x}" for x in row.sources if x not in known)
            yield from (f"{row.id}: a source twice" for _ in range(len(set(row.sources)) != len(row.sources)))
        for c in self.controls:
            if c.scope not in CONTROL_SCOPES:
                yield f"{c.id}: {c.scope!r} is none of {CONTROL_SCOPES}"
            yield from (f"{c.id}: a question twice" for _ in range(len(set(c.questions)) != len(c.questions)))
            yield from (f"{c.id}: unknown question {x}" for x in c.questions if questions is not None and x not in questions)

    def checked(self, catalog: Catalog) -> Guidance:
        """The guidance, if its controls name questions of the catalog alone."""
        problems = list(self.problems(frozenset(r.id for r in catalog.rules if r.layer == "question")))
        if problems:
            raise CatalogError("; ".join(problems))
        return self

    @property
    def version(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]

    @staticmethod
    def load(path: str | Path) -> Guidance:
        """From a JSON file; unknown and missing keys, and values of another kind, are errors."""
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8"))
            texts = lambda x: tuple(str(i) for i in x) if isinstance(x, list) and all(isinstance(i, str) for i in x) else _wrong(x)
            rows = lambda kind, lists: tuple(kind(**{k: texts(v) if k in lists else v if isinstance(v, str) or v is None else _wrong(v) for k, v in r.items()}) for r in data.pop(f"{kind.__name__.lower()}s"))
            found = {"sources": rows(Source, ()), "controls": rows(Control, ("questions", "sources")), "profiles": rows(Profile, ("sources",)), "hosts": texts(data.pop("hosts"))}
            return Guidance(**found, **data)
        except (TypeError, KeyError, AttributeError, UnicodeError, json.JSONDecodeError) as e:
            raise CatalogError(f"{path}: {e}") from e

    def dump(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=1)

    def source_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.id, s.title, s.publisher, s.url, s.kind, s.accessed, s.published) for s in self.sources], "source_id string, title string, publisher string, url string, kind string, accessed string, published string")

    def question_links(self, spark: SparkSession) -> DataFrame:
        """``rule_id, control, source_id``: both hops, a row a way."""
        return spark.createDataFrame([(x, c.id, s) for c in self.controls for x in c.questions for s in c.sources], "rule_id string, control string, source_id string")

    def profile_links(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.id, s) for p in self.profiles for s in p.sources], "profile string, source_id string")


def _wrong(x: object) -> None:
    raise TypeError(f"{x!r} is of another kind")


#: Guidance for collections of texts.
GUIDANCE = Guidance(
    as_of="2024-01-31",
    hosts=("example.org",),
    sources=(
        Source("persons", "Texts about persons", "Data office", "https://example.org/persons", "law", "2024-01-10", "2020-01-01"),
        Source("licences", "Licences of texts", "Rights office", "https://rights.example.org/licences", "law", "2024-01-10", "2022-05-01"),
        Source("style", "Plain style", "Editors", "https://example.org/style", "guidance", "2023-12-01"),
        Source("origin", "Where texts come from", "Archive", "https://example.org/origin", "guidance", "2023-11-05", "2021-02-03"),
    ),
    controls=(
        Control("C-ASK", "all", "Ask whom a text is about", ("Q-CONTACT", "Q-LINK"), ("persons", "origin")),
        Control("C-RIGHTS", "public", "Name the licence", ("Q-RIGHTS",), ("licences", "origin")),
        Control("C-STYLE", "all", "Write to be read", ("Q-SHOUT", "Q-NOISE", "Q-SHORT"), ("style",)),
    ),
    profiles=(Profile("maker", "Makers", ("licences", "style")), Profile("household", "Households", ("persons",)), Profile("other", "All others", ("origin", "style"))),
).checked(DEFAULT)

VALUES_LINKS = "ways(rule_id, control, source_id) as (values " + ", ".join(f"({q(x)}, {q(c.id)}, {q(s)})" for c in GUIDANCE.controls for x in c.questions for s in c.sources) + ")"
VALUES_SOURCES = "sources(source_id, title, kind) as (values " + ", ".join(f"({q(s.id)}, {q(s.title)}, {q(s.kind)})" for s in GUIDANCE.sources) + ")"
VALUES_PROFILES = "profiles(profile, source_id) as (values " + ", ".join(f"({q(p.id)}, {q(s)})" for p in GUIDANCE.profiles for s in p.sources) + ")"


def asked(t: Tables) -> DataFrame:
    return check(t.documents, DEFAULT).select("doc_id", F.explode_outer("questions.rule_id").alias("rule_id")).where("rule_id is not null")  # of a plain explode, Spark infers a filter that makes the questions once more


@query(f"with {ALL}, {VALUES_LINKS}, {VALUES_SOURCES} select x.doc_id, source_id, any_value(title) as title, any_value(kind) as kind, array_to_string(list_sort(list_distinct(list(control))), ',') as controls, array_to_string(list_sort(list_distinct(list(x.rule_id))), ',') as questions from questions x join ways using (rule_id) join sources using (source_id) group by x.doc_id, source_id")
def document_guidance(t: Tables) -> DataFrame:
    """The sources that the questions of each document lead to, over the controls; a row a document and source."""
    ways = GUIDANCE.question_links(t.spark).join(GUIDANCE.source_table(t.spark).select("source_id", "title", "kind"), "source_id")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return asked(t).join(F.broadcast(ways), "rule_id").groupBy("doc_id", "source_id").agg(F.first("title").alias("title"), F.first("kind").alias("kind"), names("control").alias("controls"), names("rule_id").alias("questions"))


def profile_of(segment: Column, balance: Column) -> Column:
    """The profile of an organisation: known segments by name, whatever case and blanks they are written with; those in debt and all others are ``other``."""
    name = F.lower(F.trim(segment))
    known = F.when(name.isin("building", "machinery", "automobile", "furniture"), "maker").when(name == "household", "household").otherwise("other")
    return F.when(F.coalesce(balance, F.lit(0.0)) < 0, "other").otherwise(known)


SQL_PROFILE = "case when coalesce(c_acctbal, 0) < 0 then 'other' when lower(trim(c_mktsegment)) in ('building', 'machinery', 'automobile', 'furniture') then 'maker' when lower(trim(c_mktsegment)) = 'household' then 'household' else 'other' end"


@query(f"with {VALUES_PROFILES}, {VALUES_SOURCES}, p as (select c_custkey, {SQL_PROFILE} as profile from customer) select c_custkey, profile, source_id, title from p join profiles using (profile) join sources using (source_id)")
def profile_guidance(t: Tables) -> DataFrame:
    """The sources that concern each customer, by its profile."""
    links = GUIDANCE.profile_links(t.spark).join(GUIDANCE.source_table(t.spark).select("source_id", "title"), "source_id")
    return t.customer.select("c_custkey", profile_of(F.col("c_mktsegment"), F.col("c_acctbal")).alias("profile")).join(F.broadcast(links), "profile").select("c_custkey", "profile", "source_id", "title")


@query(f"with {MATCHES}, {FIRED}, {VALUES_RULES}, {VALUES_ARTICLES} select f.doc_id, f.rule_id, case when a.title is not null then a.statute || ' ' || a.article || ': ' || a.title when r.slot is not null then 'slot ' || r.slot else r.dimension end as reference, case when a.title is not null then 'article' when r.slot is not null then 'slot' else 'dimension' end as kind from fired f join rules r using (rule_id) left join articles a on a.statute = r.statute and a.article = r.article")
def document_references(t: Tables) -> DataFrame:
    """What each rule that fires in a document refers to: its article, else its slot, else its dimension."""
    joined = DEFAULT.rule_table(t.spark).join(DEFAULT.article_table(t.spark).select("statute", "article", "title"), ["statute", "article"], "left")
    reference = F.when(F.col("title").isNotNull(), F.concat("statute", F.lit(" "), "article", F.lit(": "), "title")).when(F.col("slot").isNotNull(), F.concat(F.lit("slot "), "slot")).otherwise(F.col("dimension"))
    kind = F.when(F.col("title").isNotNull(), "article").when(F.col("slot").isNotNull(), "slot").otherwise("dimension")
    return first_survivors(rule_matches(t.documents, DEFAULT)).join(F.broadcast(joined.select("rule_id", reference.alias("reference"), kind.alias("kind"))), "rule_id").select("doc_id", "rule_id", "reference", "kind")


#: The articles after a revision: one text changed, one article's date, one new.
REVISED = tuple(
    replace(a, text=a.text.replace("left out", "left out or masked"), effective="2024-01-01") if (a.statute, a.article) == ("privacy", "1") else replace(a, title="Licence lines") if a.statute == "rights" else a
    for a in DEFAULT.articles if a.statute != "conduct"
) + (replace(DEFAULT.articles[0], article="3", title="Names", text="Names are kept if they are public."),)


def article_changes(t: Tables) -> DataFrame:
    """``statute, article, fields``: what a revision changes of each article; a new or dropped article has all fields changed."""
    old, new = (Catalog.article_table(c, t.spark) for c in (DEFAULT, replace(DEFAULT, rules=(), articles=REVISED)))
    names = ("title", "effective", "hash")
    both = old.alias("o").join(new.alias("n"), ["statute", "article"], "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{x}").eqNullSafe(F.col(f"n.{x}")), F.lit("text" if x == "hash" else x)) for x in names]))
    return both.select("statute", "article", changed.alias("fields")).where(F.size("fields") > 0)


_REVISED = "revised(statute, article, title, effective, hash) as (values " + ", ".join(f"({q(a.statute)}, {q(a.article)}, {q(a.title)}, {q(a.effective)}, {q(a.hash)})" for a in REVISED) + ")"
_BEFORE = "earlier(statute, article, title, effective, hash) as (values " + ", ".join(f"({q(a.statute)}, {q(a.article)}, {q(a.title)}, {q(a.effective)}, {q(a.hash)})" for a in DEFAULT.articles) + ")"
SQL_CHANGES = f"{_REVISED}, {_BEFORE}, changes as (select statute, article, array_to_string(list_filter([case when o.title is distinct from n.title then 'title' end, case when o.effective is distinct from n.effective then 'effective' end, case when o.hash is distinct from n.hash then 'text' end], lambda x: x is not null), ',') as fields from earlier o full join revised n using (statute, article))"


@query(f"with {MATCHES}, {FIRED}, {VALUES_RULES}, {SQL_CHANGES} select c.statute, c.article, c.fields, r.rule_id, count(f.doc_id) as docs from changes c left join rules r on r.statute = c.statute and r.article = c.article left join fired f using (rule_id) where c.fields <> '' group by all")
def article_impact(t: Tables) -> DataFrame:
    """The rules that each changed article stands behind, and how many documents they fire in; an article without rules has one row with none."""
    rules = DEFAULT.rule_table(t.spark).select("rule_id", "statute", "article")
    docs = first_survivors(rule_matches(t.documents, DEFAULT)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("docs"))
    touched = article_changes(t).join(rules, ["statute", "article"], "left").join(F.broadcast(docs), "rule_id", "left")
    return touched.select("statute", "article", F.array_join("fields", ",").alias("fields"), "rule_id", F.coalesce("docs", F.lit(0)).alias("docs"))


@query(f"with {MATCHES}, {FIRED}, {VALUES_RULES}, {VALUES_ARTICLES} select f.doc_id, min(effective) as first_effective, max(effective) as last_effective, count(distinct r.statute) as statutes from fired f join rules r using (rule_id) join articles a on a.statute = r.statute and a.article = r.article group by f.doc_id")
def finding_dates(t: Tables) -> DataFrame:
    """The oldest and newest date of the articles behind each document's findings."""
    dated = DEFAULT.rule_table(t.spark).join(DEFAULT.article_table(t.spark), ["statute", "article"]).select("rule_id", "statute", "effective")
    return first_survivors(rule_matches(t.documents, DEFAULT)).join(F.broadcast(dated), "rule_id").groupBy("doc_id").agg(F.min("effective").alias("first_effective"), F.max("effective").alias("last_effective"), F.count_distinct("statute").alias("statutes"))


@query(f"with {ALL} select r.rule_id, r.slot, case when x.rule_id is not null and not s.found then 'paired' when x.rule_id is not null then 'linked' when not s.found then 'unasked' else 'present' end as state, count(*) as docs from slots s join rules r on r.slot = s.slot left join questions x on x.doc_id = s.doc_id and x.rule_id = r.rule_id group by all")
def question_slot_states(t: Tables) -> DataFrame:
    """How each question goes with its slot over all documents: asked of a missing slot (paired), asked though it is there, by a link alone (linked), not asked though missing (unasked), or neither."""
    found = check(t.documents, DEFAULT)
    pairs = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.slot).alias("slot")) for r in DEFAULT.rules if r.slot])
    each = found.select("questions", "slots", F.explode(pairs).alias("p"))
    is_asked = F.exists("questions", lambda x: x["rule_id"] == F.col("p.rule_id"))
    missing = F.exists("slots", lambda s: (s["slot"] == F.col("p.slot")) & ~s["found"])
    state = F.when(is_asked & missing, "paired").when(is_asked, "linked").when(missing, "unasked").otherwise("present")
    return each.groupBy(F.col("p.rule_id").alias("rule_id"), F.col("p.slot").alias("slot"), state.alias("state")).agg(F.count(F.lit(1)).alias("docs"))
