"""Text normalisation as Column expressions (Catalyst only, no Python workers)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

# Tracking parameters, title decorations, legal forms, gender markers.
TRACKING_PREFIXES = ("utm_", "ref=", "source=", "gh_src=", "gh_jid=")
TITLE_NOISE = (
    "(m/f/d)", "(m/f/x)", "(f/m/d)", "(m/w/d)", "(m/f)",
    "- new", "new!", "[remote]", "(remote)", "(hybrid)", "(onsite)",
)
LEGAL_FORMS = (
    r"a/s|aps|i/s|k/s|p/s|amba|a\.m\.b\.a\.?|ab|\(publ\)|publ|asa|as|oy|oyj"
    r"|ltd\.?|limited|plc|llc|l\.l\.c\.?|inc\.?|incorporated|corp\.?|corporation"
    r"|gmbh|ag|se|kg|b\.?v\.?|n\.?v\.?|s\.?a\.?|s\.?a\.?s\.?|sarl|s\.?r\.?l\.?"
    r"|s\.?p\.?a\.?|s\.?l\.?|pty"
)
GENDER_MARKER = r"\((?:\s*[mfwdxkh]\s*/)+\s*[mfwdxkh]\s*\)|\(all genders\)"
BLOCK_TAG = r"(?i)<\s*/?\s*(?:br|p|li|ul|ol|div|h[1-6]|tr|td|section|article)\b[^>]*>"
DESCRIPTION_LIMIT = 20_000
# Letters without a canonical decomposition, folded by hand.
FOLD_ONE = {"ø": "o", "đ": "d", "ł": "l"}
FOLD_MANY = {"æ": "ae", "ß": "ss", "œ": "oe"}
# End of fixed values.

_WS = r"(?U)[\s\x{A0}\x{2007}\x{202F}\x{1C}-\x{1F}]+"


def _fold_table() -> tuple[str, str]:
    """Single letters of the Latin, Greek and Cyrillic blocks and their base letters."""
    src, dst = list(FOLD_ONE), list(FOLD_ONE.values())
    for cp in (*range(0xA0, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1 and ch == ch.lower() and ch not in FOLD_ONE:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _fold_table()


def normalise_text(c: Column) -> Column:
    """Null to '', every run of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _WS, " "))


def normalise_title(c: Column) -> Column:
    """Title without board decorations; each token is removed until none is left."""
    t = normalise_text(c)
    for token in TITLE_NOISE:
        quoted = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in token)
        t = F.regexp_replace(t, f"(?i){quoted}", " ")
    return F.btrim(normalise_text(t), F.lit(" -|,"))


def canonical_url(c: Column) -> Column:
    """URL without fragment, trailing slashes of the path and tracking parameters."""
    u = F.split_part(normalise_text(c), F.lit("#"), F.lit(1))
    base = F.regexp_replace(F.split_part(u, F.lit("?"), F.lit(1)), "/+$", "")
    query = F.when(F.instr(u, "?") > 0, F.expr("1"))
    raw = F.regexp_replace(u, r"^[^?]*\??", "")
    pattern = "^(?:" + "|".join(p.replace("=", "=") for p in TRACKING_PREFIXES) + ")"
    keep = F.filter(F.split(raw, "&", -1), lambda p: (p != "") & ~F.lower(p).rlike(pattern))
    joined = F.array_join(keep, "&")
    return F.when(query.isNotNull() & (joined != ""), F.concat(base, F.lit("?"), joined)).otherwise(base)


def fold(c: Column) -> Column:
    """Lower case, accent-free text for comparison."""
    t = F.lower(normalise_text(c))
    for ch, base in FOLD_MANY.items():
        t = F.replace(t, F.lit(ch), F.lit(base))
    t = F.translate(t, _FOLD_FROM, _FOLD_TO)
    return F.regexp_replace(t, r"[\u0300-\u036f]", "")


def company_key(c: Column) -> Column:
    """Employer name reduced to what identifies it: no legal form, no leading 'the'."""
    t = F.regexp_replace(fold(c), rf"(?<=[^\s,])(?:[\s,]+(?:{LEGAL_FORMS}))+$", "")
    t = F.regexp_replace(F.trim(t), "^the ", "")
    return F.trim(F.regexp_replace(t, "[^0-9a-z]+", " "))


def title_key(c: Column) -> Column:
    t = F.regexp_replace(fold(normalise_title(c)), GENDER_MARKER, " ")
    return F.trim(F.regexp_replace(t, "[^0-9a-z]+", " "))


def vacancy_key(company: Column, title: Column) -> Column:
    return F.concat_ws("|", company_key(company), title_key(title))


def fingerprint(company: Column, title: Column, url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of company, title and canonical URL."""
    basis = F.concat_ws("|", F.lower(normalise_text(company)), F.lower(normalise_title(title)), canonical_url(url))
    return F.substring(F.sha2(basis, 256), 1, 16)


#: Characters by entity name, from the standard's own table.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
# Names the standard also reads without a semicolon, where no letter or digit follows.
_OPEN = r"&(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + r")(?![A-Za-z0-9;=])"


def _named() -> Column:
    """A map literal of all named entities (one folded constant, no matter how often it is used)."""
    text = "\u0001".join(f"{name}\u0002{chars}" for name, chars in sorted(NAMED.items()))
    return F.str_to_map(F.lit(text), F.lit("\u0001"), F.lit("\u0002"))


def _character(entity: Column) -> Column:
    """What one entity stands for: a name of the table or a code point; anything else stays."""
    body = F.regexp_replace(entity, "^&|;$", "")
    hexa = F.when(body.rlike("^#[xX]"), F.substring(body, 3, 12)).when(
        body.rlike("^#[0-9]{1,9}$"), F.hex(F.substring(body, 2, 9).try_cast("bigint"))
    )
    point = F.conv(hexa, 16, 10).try_cast("bigint")
    known = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF) & ~point.between(0x80, 0x9F)
    # Code points of the C1 range are read as Windows-1252, as browsers do.
    western = F.element_at(F.array(*[F.lit(_C1.get(i, "\ufffd")) for i in range(0x80, 0xA0)]), (point - 0x7F).cast("int"))
    numeric = F.when(known, F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")).when(point.between(0x80, 0x9F), western).otherwise(F.lit("\ufffd"))
    return F.when(hexa.isNotNull(), numeric).otherwise(F.coalesce(F.try_element_at(_named(), body), entity))


_C1 = {i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unescape(c: Column) -> Column:
    """HTML entities, named and numeric, to characters; one pass undoes one escape.

    Without its semicolon a name is read where no letter, digit or '=' follows.
    """

    def filled(text: Column) -> Column:
        parts, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
        pairs = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda before, e: F.concat(before, _character(e)))
        return F.concat(F.array_join(pairs, ""), F.element_at(parts, -1))

    return _let(c, lambda t: F.when(F.contains(t, F.lit("&")), _let(F.regexp_replace(t, f"({_OPEN})", "$1;"), filled)).otherwise(t))


def normalise_description(c: Column, limit: int | None = DESCRIPTION_LIMIT) -> Column:
    """Plain text of an ad body: block tags to line breaks, other tags to spaces."""
    t = F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), BLOCK_TAG, "\n")
    t = unescape(F.regexp_replace(t, "<[^>]+>", " "))
    lines = F.transform(
        F.split(t, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]", -1),
        lambda x: F.trim(F.regexp_replace(x, _WS, " ")),
    )
    out = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return out if limit is None else F.substring(out, 1, limit)


def plain(c: Column) -> Column:
    """Markup-free single-line text."""
    return normalise_text(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")))


def normalise_tags(c: Column) -> Column:
    """Distinct lower-case tags, sorted; null gives an empty array."""
    tags = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.lower(normalise_text(t)))))


def word_in(text: Column, word: str) -> Column:
    """Whole-word containment with Unicode word characters."""
    quoted = "".join("\\" + ch if not ch.isalnum() and ch not in " _" else ch for ch in word)
    return text.rlike(rf"(?U)(?<!\w){quoted}(?!\w)")


def slug(c: Column, length: int) -> Column:
    """Lower-case ASCII slug of at most ``length`` characters, 'ad' when nothing is left."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    s = F.btrim(F.substring(F.btrim(s, F.lit("-")), 1, length), F.lit("-"))
    return F.when(s == "", F.lit("ad")).otherwise(s)
