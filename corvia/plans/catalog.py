"""The rule catalog: rules, slots and statutes as data, validated on load."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from corvia.operators.spans import to_regex

LAYERS, TRIGGERS, SEVERITIES, SCOPES = ("policy", "question"), ("presence", "absence"), ("high", "medium", "low"), ("common", "specific")


class CatalogError(ValueError):
    """A catalog that breaks the rules of its schema."""


@dataclass(frozen=True)
class Exclusion:
    term: str
    window: int
    candidate: str | None = None
    overlap: bool = False


@dataclass(frozen=True)
class ContextGroup:
    name: str
    patterns: tuple[str, ...]
    window: int


@dataclass(frozen=True)
class Protection:
    """Expressions that govern a candidate in its clause; they may hold no groups."""

    protect: str
    require: str
    indifferent: str
    contrast: str
    breaks: str
    item_words: int = 3


@dataclass(frozen=True)
class Rule:
    id: str
    layer: str
    dimension: str
    severity: str
    trigger: str
    patterns: tuple[str, ...] = ()
    exclude: tuple[Exclusion, ...] = ()
    context: tuple[ContextGroup, ...] = ()
    slot: str | None = None
    related: tuple[str, ...] = ()
    scope: str = "specific"
    statute: str | None = None
    article: str | None = None
    message: str = ""
    protect: Protection | None = None
    #: Literals of which every text that the rule matches holds one, to let others past its expressions; none: no such literals.
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class LineContext:
    """Which accepted lines do not count: those with ``deny`` and not ``unless``, and those of a block that a heading with ``block`` opens, up to the next heading. ``vetoes`` are components and what a line may not hold with them."""

    deny: str
    unless: str
    block: str
    vetoes: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Slot:
    id: str
    label: str
    accept: tuple[str, ...]
    components: tuple[tuple[str, tuple[str, ...]], ...] = ()
    context: LineContext | None = None


@dataclass(frozen=True)
class Article:
    statute: str
    article: str
    title: str
    text: str
    effective: str

    @property
    def hash(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()


@dataclass(frozen=True)
class Catalog:
    rules: tuple[Rule, ...]
    slots: tuple[Slot, ...]
    articles: tuple[Article, ...]
    snapshot: str = "2024-01-31"
    local: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        problems = list(self.problems())
        if problems:
            raise CatalogError("; ".join(problems))

    def problems(self) -> Iterable[str]:
        """Every breach of the schema: enumerations, ids, windows, references, patterns that match nothing, dates."""
        ids, slots, bases = [r.id for r in self.rules], {s.id for s in self.slots}, {(a.statute, a.article) for a in self.articles}
        questions = {r.id for r in self.rules if r.layer == "question"}
        for x in sorted({i for i in ids if ids.count(i) > 1}):
            yield f"{x}: repeated id"
        for r in self.rules:
            if not re.fullmatch(r"[A-Z]+-[A-Z0-9]+(?:-[0-9]+)?", r.id):
                yield f"{r.id}: malformed id"
            for value, allowed in ((r.layer, LAYERS), (r.trigger, TRIGGERS), (r.severity, SEVERITIES), (r.scope, SCOPES)):
                if value not in allowed:
                    yield f"{r.id}: {value!r} is none of {allowed}"
            if any(not x or not x.strip() for x in r.needs):
                yield f"{r.id}: a needed literal is empty"
            if (r.trigger == "presence") != bool(r.patterns) or (r.trigger == "absence") != bool(r.slot):
                yield f"{r.id}: a presence rule has patterns, an absence rule a slot"
            if r.slot and r.slot not in slots:
                yield f"{r.id}: unknown slot {r.slot}"
            if r.layer == "policy" and (r.statute, r.article) not in bases:
                yield f"{r.id}: no such basis"
            if r.id in self.local and r.layer != "question":
                yield f"{r.id}: local rules are of the question layer"
            yield from (f"{r.id}: unknown question {q}" for q in r.related if q not in questions)
            yield from (f"{r.id}: window {e.window}" for e in r.exclude if e.window < 0)
            yield from (f"{r.id}: window {g.window}" for g in r.context if not 1 <= g.window <= 6000)
            for p in (*r.patterns, *(e.term for e in r.exclude), *(p for g in r.context for p in g.patterns)):
                try:
                    if not p.strip() or re.search(to_regex(p), ""):
                        yield f"{r.id}: pattern {p!r} matches the empty text"
                except re.error as e:
                    yield f"{r.id}: pattern {p!r}: {e}"
            for p in (r.protect.protect, r.protect.require, r.protect.indifferent, r.protect.contrast, r.protect.breaks) if r.protect else ():
                try:
                    if re.compile(p).groups or re.search(p, ""):
                        yield f"{r.id}: governor {p!r} has groups or matches the empty text"
                except re.error as e:
                    yield f"{r.id}: governor {p!r}: {e}"
        for s in self.slots:
            names = {k for k, _ in s.components}
            for name, p in ((None, s.context.deny), (None, s.context.unless), (None, s.context.block), *s.context.vetoes) if s.context else ():
                if name is not None and name not in names:
                    yield f"{s.id}: a veto of no component: {name}"
                try:
                    if re.search(p, ""):
                        yield f"{s.id}: pattern {p!r} matches the empty text"
                except re.error as e:
                    yield f"{s.id}: pattern {p!r}: {e}"
        for a in self.articles:
            try:
                if date.fromisoformat(a.effective) > date.fromisoformat(self.snapshot):
                    yield f"{a.statute} {a.article}: in force after the snapshot"
            except ValueError:
                yield f"{a.statute} {a.article}: not a date: {a.effective}"

    @property
    def version(self) -> str:
        """Changes with any rule, slot or article."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]

    @property
    def matching_version(self) -> str:
        """Changes only with what decides matches."""
        parts = [(r.id, r.trigger, r.patterns, [asdict(e) for e in r.exclude], [asdict(g) for g in r.context], r.slot, *([asdict(r.protect)] if r.protect else [])) for r in self.rules]
        return hashlib.sha256(json.dumps([parts, [asdict(s) for s in self.slots]], sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]

    def with_local(self, rules: Iterable[Rule]) -> Catalog:
        """The catalog with further rules of the question layer."""
        rules = tuple(rules)
        return replace(self, rules=(*self.rules, *rules), local=(*self.local, *(r.id for r in rules)))

    def only(self, ids: Iterable[str] = (), layers: Iterable[str] = LAYERS) -> Catalog:
        """The catalog with the presence rules of some layers alone, or with those of ``ids``, which must be among them; what links to others does so no more."""
        layers, ids = frozenset(layers), list(ids)
        eligible = [r for r in self.rules if r.layer in layers and r.trigger == "presence"]
        if unknown := sorted(set(ids) - {r.id for r in eligible}):
            raise CatalogError(f"no such rules to choose: {', '.join(unknown)}")
        if len(ids) != len(set(ids)):
            raise CatalogError("a rule chosen twice")
        chosen = [r for r in eligible if not ids or r.id in ids]
        left = {r.id for r in chosen}
        return replace(self, rules=tuple(replace(r, related=tuple(q for q in r.related if q in left)) for r in chosen), local=tuple(x for x in self.local if x in left))

    @staticmethod
    def load(path: str | Path) -> Catalog:
        """From a JSON file, or a YAML file where a YAML library is installed; unknown keys are errors."""
        raw = Path(path).read_text(encoding="utf-8")
        if str(path).endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(raw)
        else:
            data = json.loads(raw)
        try:
            rules = tuple(
                Rule(**r | {"patterns": tuple(r.get("patterns", ())), "needs": tuple(r.get("needs", ())), "related": tuple(r.get("related", ())), "exclude": tuple(Exclusion(**e) for e in r.get("exclude", ())), "context": tuple(ContextGroup(g["name"], tuple(g["patterns"]), g["window"]) for g in r.get("context", ())), "protect": Protection(**r["protect"]) if r.get("protect") else None})
                for r in data["rules"]
            )
            if unknown := sorted(set(data) - {"rules", "slots", "articles", "snapshot"} | {k for s in data["slots"] for k in set(s) - {"id", "label", "accept", "components", "context"}}):
                raise CatalogError(f"unknown keys: {', '.join(unknown)}")
            slots = tuple(Slot(s["id"], s["label"], tuple(s["accept"]), tuple((k, tuple(v)) for k, v in s.get("components", {}).items()), LineContext(**s["context"] | {"vetoes": tuple(map(tuple, s["context"].get("vetoes", ())))}) if s.get("context") else None) for s in data["slots"])
            return Catalog(rules, slots, tuple(Article(**a) for a in data["articles"]), data.get("snapshot", Catalog.snapshot))
        except (TypeError, KeyError) as e:
            raise CatalogError(str(e)) from e

    def dump(self) -> str:
        """JSON that :meth:`load` reads."""
        data = asdict(self)
        del data["local"]
        for s in data["slots"]:
            s["components"] = dict(s["components"])
        return json.dumps(data, ensure_ascii=False, indent=1)

    def rule_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.id, r.layer, r.dimension, r.severity, r.trigger, r.slot, list(r.related), r.scope, r.statute, r.article, r.message) for r in self.rules]
        return spark.createDataFrame(rows, "rule_id string, layer string, dimension string, severity string, trigger string, slot string, related array<string>, scope string, statute string, article string, message string")

    def article_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a.statute, a.article, a.title, a.text, a.effective, a.hash) for a in self.articles], "statute string, article string, title string, text string, effective string, hash string")

    def slot_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.id, s.label) for s in self.slots], "slot string, label string")


#: A catalog for collections of prose with personal data, secrets, licence lines and junk in them.
DEFAULT = Catalog(
    rules=(
        Rule("P-MAIL", "policy", "privacy", "high", "presence", (r"re:[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",), (Exclusion("noreply@", 8),), related=("Q-CONTACT", "Q-SHOUT"), statute="privacy", article="1", message="holds an e-mail address", needs=("@",)),
        Rule("P-ADDR", "policy", "privacy", "medium", "presence", (r"re:[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",), (Exclusion("re:(?i)version", 20), Exclusion(r"re:127\.0\.0\.1", 0, overlap=True)), related=("Q-CONTACT",), statute="privacy", article="2", message="holds a network address"),
        Rule("P-CARD", "policy", "privacy", "high", "presence", (r"re:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",), (Exclusion("order", 30, candidate="re:^[0-9]{16}$"),), related=("Q-NOISE",), statute="privacy", article="1", message="holds a card number"),
        Rule("P-SECRET", "policy", "security", "high", "presence", (r're:(?i)(?:token|api_key|password|secret)\s*=\s*"[^"]+"',), (Exclusion("example", 12),), related=("Q-NOISE", "Q-SHORT"), statute="security", article="1", message="holds a secret", needs=("=",)),
        Rule("P-LICENSE", "policy", "rights", "medium", "presence", ("licensed under", "all rights reserved"), (Exclusion("apache license", 40), Exclusion("public license", 24)), related=("Q-RIGHTS",), statute="rights", article="1", message="holds a licence line"),
        Rule("P-INSULT", "policy", "conduct", "medium", "presence", (r"re:(?i)\b(?:idiot|moron|scum|worthless|disgusting)\b",), (), (ContextGroup("second", (r"re:(?i)\b(?:trash|loser|stupid|idiot|moron|scum)\b",), 120),), related=("Q-SHOUT",), statute="conduct", article="1", message="holds insults"),
        Rule("Q-SHOUT", "question", "style", "low", "presence", (r"re:[A-Z]{3,}!!",), scope="common", message="is it meant to shout?", needs=("!!",)),
        Rule("Q-NOISE", "question", "style", "low", "presence", (r"re:[*#&%$]{3}",), (Exclusion(r"re:\*\*\*", 0, overlap=True),), (ContextGroup("more", ("%%%", "&&&"), 80),), message="is it noise?"),
        Rule("Q-CONTACT", "question", "privacy", "low", "presence", ("contact", "@"), message="who can be asked?"),
        Rule("Q-TABLE", "question", "style", "low", "presence", (r"re: \| [^|\n]+ \| ",), message="is it a table?", needs=(" | ",)),
        Rule("Q-RIGHTS", "question", "rights", "low", "absence", slot="license", message="under which licence?"),
        Rule("Q-SHORT", "question", "style", "low", "absence", slot="body", message="is there more of it?"),
        Rule("Q-LINK", "question", "source", "low", "absence", slot="link", message="where is it from?"),
        Rule("Q-NUMBER", "question", "facts", "low", "absence", slot="number", message="are there figures?"),
    ),
    slots=(
        Slot("license", "licence", (r"re:(?i)licen[sc]e",), (("name", (r"re:(?i)apache|gnu|mit|creative",)), ("version", (r"re:(?i)version [0-9]|[0-9]\.[0-9]",)))),
        Slot("body", "body", (r"re:\A\s*\S+(?:\s+\S+){39}",), (("sentence", (r"re:[.!?]\s",)), ("comma", (r"re:, ",)))),
        Slot("link", "link", (r"re:https?://", r"re:www\."), (("secure", (r"re:https://",)),)),
        Slot("number", "number", (r"re:[0-9]+",), (("long", (r"re:[0-9]{4}",)), ("decimal", (r"re:[0-9]\.[0-9]",)))),
    ),
    articles=(
        Article("privacy", "1", "Direct identifiers", "Direct identifiers of persons are left out.", "2020-01-01"),
        Article("privacy", "2", "Indirect identifiers", "Addresses of devices are left out unless they are public.", "2021-07-01"),
        Article("security", "1", "Secrets", "Secrets are left out and replaced.", "2019-03-15"),
        Article("rights", "1", "Licences", "Licence lines are kept with their texts.", "2022-05-01"),
        Article("conduct", "1", "Insults", "Insults are marked.", "2023-11-30"),
    ),
)


#: Words that protect what stands in their clause, in the languages of the texts; each with the blanks or marks around it.
NEGATIONS = Protection(
    protect=r"(?i)[ ,(](?:not|no|without|never|nicht|kein|pas|sans|sin)[ ,.)]",
    require=r"(?i)[ ,(](?:must|required|only|muss|doit|debe)[ ,.)]",
    indifferent=r"(?i)[ ,(](?:regardless|whatever|all|alle|tout)[ ,.)]",
    contrast=r"(?i)[ ,(](?:but|however|or|aber|mais|pero)[ ,.)]",
    breaks=r"(?i)[;:]| (?:but|however|and|aber|und|mais|et|pero|y) ",
)

#: The default catalog with its personal data protected where a text negates it, and a rule whose candidates are plain words.
GUARDED = replace(
    DEFAULT,
    rules=(
        *(replace(r, protect=NEGATIONS) if r.id in ("P-MAIL", "P-ADDR", "P-CARD", "P-SECRET", "Q-NOISE") else r for r in DEFAULT.rules),
        Rule("Q-CLAIM", "question", "facts", "low", "presence", (r"re:(?i) (?:are|was|ist|sind|est|sont|es|son)[ ,.]",), message="is it so?", protect=NEGATIONS),
    ),
)

#: Rules for texts in look-alike characters: expressions see the normalised text, literals that with its endings rewritten.
VIEWED = replace(
    DEFAULT,
    rules=(
        *DEFAULT.rules,
        Rule("Q-ENDING", "question", "style", "low", "presence", ("heate", "tión", "eung"), (Exclusion("re:[0-9]{3}", 40),), message="which word is it?"),
        Rule("Q-LIGATURE", "question", "style", "low", "presence", ("fi",), (), (ContextGroup("mark", (",", "."), 30),), message="is it one character?"),
    ),
)

#: Slots whose lines count in context: none in noise, none below a heading of one word.
CONTEXTED = replace(
    DEFAULT,
    slots=tuple(
        replace(s, context=LineContext(deny=r"%%%|&&&", unless=r"###|\|", block=r"^\S+$", vetoes=((s.components[0][0], r"[*]{3}|[?]"),))) if s.id in ("number", "license") else s for s in DEFAULT.slots
    ),
)
