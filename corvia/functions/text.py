"""Text functions on columns: views, masking, snippets. Offsets are code points, from 0, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that normalisation deletes, and white space other than tab, CR and LF, which becomes a space.
ZERO_WIDTH = "​‌‍﻿"
SPACES = "\x0b\x0c\x1c\x1d\x1e\x1f\x85                 　"
#: Full-width ASCII, by rule.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))

#: Identifiers in the order in which they are masked, and credentials. All are in the subset of Java and RE2 syntax.
IDENTIFIERS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "resident_number": r"[0-9]{6}-[1-4][0-9]{6}",
    "card": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "phone": r"\+?[0-9]{2,3}[ -][0-9]{3,4}[ -][0-9]{4}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}
CREDENTIALS = {
    "assigned_secret": r"(?i)(?:token|api_key|password|secret)\s*=\s*\"[^\"]+\"",
    "bearer": r"(?i)bearer\s+[A-Za-z0-9._-]{16,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def normalized(text: Column) -> Column:
    """Zero-width characters deleted, odd white space as spaces, full-width ASCII as ASCII: the one-to-one part of per-character NFKC."""
    return F.translate(text, SPACES + WIDE + ZERO_WIDTH, " " * len(SPACES) + NARROW)


def masked(text: Column, patterns: dict[str, str] | None = None) -> Column:
    for kind, pattern in (patterns or IDENTIFIERS).items():
        text = F.regexp_replace(text, pattern, f"[{kind}]")
    return text


def look_alike(pattern: str) -> str:
    """A pattern of :data:`IDENTIFIERS` that takes full-width digits, dashes and at signs as well."""
    for plain, wide in (("0-9", "0-9０-９"), ("[1-4]", "[1-4１-４]"), ("[ -]", "[ \u2010-\u2015－-]"), ("@", "[@＠]")):
        pattern = pattern.replace(plain, wide)
    return pattern


def masked_folded(text: Column) -> Column:
    """Identifiers in look-alike characters masked where they stand; all else stays as it is written."""
    return masked(text, {k: look_alike(p) for k, p in IDENTIFIERS.items()})


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its members in the order of their names and no white space."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def kinds(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """The sorted names of the patterns that occur in the text."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in (patterns or IDENTIFIERS).items()])))


def deidentified(text: Column, organization: Column) -> Column:
    """The organisation's name, e-mails and phones masked, and the name after a label such as ``Contact:``."""
    named = F.when(F.length(F.trim(organization)) > 0, F.replace(text, F.trim(organization), F.lit("[organization]"))).otherwise(text)
    out = masked(named, {k: IDENTIFIERS[k] for k in ("email", "phone")})
    return F.regexp_replace(out, r"(?i)((?:contact|author|name)\s*:\s*)[^\s,;.]+", "$1[name]")


def compact(text: Column, most: int = 400) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"\A\s+|\s+\z", ""), r"\n{3,}", "\n\n"), 1, most)


def heading_key(line: Column) -> Column:
    """A heading for comparison: decoration and white space dropped, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(line, r"^[\s#*=>.:\[\]()-]+|[\s#*=<.:\[\]()-]+$", ""), r"\s+", ""))


def expression_key(text: Column) -> Column:
    """An expression for grouping: quotes and brackets dropped, white space squeezed, lower case, a plural or past ending cut if anything is left."""
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\"'`()\[\]{}<>]", ""), r"\s+", " ")))
    return F.coalesce(F.nullif(F.regexp_replace(plain, r"(?:ing|ed|es|s)$", ""), F.lit("")), plain)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def page_text(html: Column) -> Column:
    """Visible text of a page by patterns: scripts, styles and the head go, breaking tags break lines, other tags go."""
    body = F.regexp_replace(html, r"(?is)<(?:script|style|head)\b.*?</(?:script|style|head)>", "")
    lines = F.regexp_replace(body, r"(?i)</?(?:p|div|br|li|ul|h[1-6]|tr|article|nav|footer)\b[^>]*>", "\n")
    plain = F.replace(F.replace(F.replace(F.regexp_replace(lines, r"<[^>]+>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t]*\n\s*", "\n"), r"\A\s+|\s+\z", "")


def canonical_url(url: Column) -> Column:
    """HTTPS URLs with a lower-case host, no port 443, no query or fragment, ``/`` for an empty path; null for anything else."""
    parts = F.regexp_extract(url, r"^(?i:https)://([^/?#@\s]+)([^?#\s]*)", 1)
    path = F.regexp_extract(url, r"^(?i:https)://([^/?#@\s]+)([^?#\s]*)", 2)
    host = F.regexp_replace(F.lower(parts), r":443$", "")
    return F.when(parts != "", F.concat(F.lit("https://"), host, F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))))


def snippet(text: Column, start: Column, end: Column, around: int) -> Column:
    """``around`` code points on either side of a span."""
    return F.substring(text, F.greatest(F.lit(1), start + 1 - around), F.least(start, F.lit(around)) + end - start + around)


def evidence(text: Column, start: Column, end: Column, window: int = 238, lead: int = 96) -> Column:
    """The line around a span; cut to ``window`` code points with ellipses, ``lead`` of them before the span, if it is longer."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    tail = F.substring_index(before, "\n", -1)
    line = F.concat(tail, F.substring(text, start + 1, end - start), F.substring_index(after, "\n", 1))
    skip = F.greatest(F.lit(0), F.length(tail) - lead)
    cut = F.substring(line, skip + 1, F.lit(window))
    left, right = F.when(skip > 0, F.lit("…")).otherwise(F.lit("")), F.when(F.length(line) > skip + window, F.lit("…")).otherwise(F.lit(""))
    return F.concat(left, cut, right)


def bigrams(text: Column) -> Column:
    """The character bigrams of a text, repeats included; none for texts under two characters."""
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def occurrences(text: Column, term: str) -> Column:
    """How often a literal occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def keyword_class(text: Column, classes: dict[str, list[str]], fallback: str) -> Column:
    """The class whose keywords occur most often; ties go to the class named first, no keyword to the fallback."""
    low = F.lower(text)
    counts = [(name, sum((occurrences(low, w) for w in words[1:]), occurrences(low, words[0]))) for name, words in classes.items()]
    most = F.greatest(*[c for _, c in counts]) if len(counts) > 1 else counts[0][1]
    out = F.when(most == 0, F.lit(fallback))
    for name, count in counts:
        out = out.when(count == most, F.lit(name))
    return out.otherwise(F.lit(fallback))


def hmac_sha256(text: Column, key: bytes) -> Column:
    """The keyed hash of a text in hex (RFC 2104), by two plain hashes."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)
