"""DuckDB fragments used by the SQL counterparts of the catalogue."""

from __future__ import annotations

from html.entities import name2codepoint

from ..functions import text as t

WS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'))"


def _escape(token: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in token)


def norm_title(x: str) -> str:
    e = norm(x)
    for token in t.TITLE_NOISE:
        e = f"regexp_replace({e}, {q(_escape(token))}, ' ', 'gi')"
    return f"trim({norm(e)}, ' -|,')"


def fold(x: str) -> str:
    e = f"lower({norm(x)})"
    for a, b in {**t.FOLD_MANY, **t.FOLD_ONE}.items():
        e = f"replace({e}, {q(a)}, {q(b)})"
    return f"strip_accents({e})"


def company_key(x: str) -> str:
    e = f"regexp_replace({fold(x)}, {q(r'^(.*?[^\s,])(?:[\s,]+(?:' + t.LEGAL_FORMS + r'))+$')}, '\\1')"
    e = f"regexp_replace(trim({e}), '^the ', '')"
    return f"trim(regexp_replace({e}, '[^0-9a-z]+', ' ', 'g'))"


def title_key(x: str) -> str:
    e = f"regexp_replace({fold(norm_title(x))}, {q(t.GENDER_MARKER)}, ' ', 'g')"
    return f"trim(regexp_replace({e}, '[^0-9a-z]+', ' ', 'g'))"


def url(x: str) -> str:
    u = f"split_part({norm(x)}, '#', 1)"
    base = f"regexp_replace(split_part({u}, '?', 1), '/+$', '')"
    raw = f"regexp_replace({u}, '^[^?]*\\??', '')"
    drop = "^(?:" + "|".join(t.TRACKING_PREFIXES) + ")"
    keep = f"array_to_string(list_filter(string_split({raw}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{drop}')), '&')"
    return f"CASE WHEN {keep} <> '' THEN {base} || '?' || {keep} ELSE {base} END"


def fingerprint(company: str, title: str, link: str) -> str:
    return f"sha256(lower({norm(company)}) || '|' || lower({norm_title(title)}) || '|' || {url(link)})[1:16]"


_NAMED = "MAP {" + ", ".join(f"{q('&' + k + ';')}: {q(chr(v))}" for k, v in {**name2codepoint, "apos": 39}.items()) + "}"


def unescape(x: str) -> str:
    """Numeric entities and those named in HTML 4; the standard's further names do not occur in the tables."""
    pat = q("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    one = (
        f"CASE WHEN z[2] IS NULL THEN '' WHEN z[2][2:2] <> '#' THEN coalesce(({_NAMED})[z[2]], z[2]) "
        "WHEN lower(z[2][3:3]) = 'x' THEN chr(('0x' || z[2][4:length(z[2]) - 1])::INT) ELSE chr((z[2][3:length(z[2]) - 1])::INT) END"
    )
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, {pat}), regexp_extract_all({x}, {pat})), lambda z: z[1] || {one}), '')"


def description(x: str) -> str:
    e = f"regexp_replace({unescape(f'coalesce({x}, {q('')})')}, {q(t.BLOCK_TAG)}, chr(10), 'g')"
    e = unescape(f"regexp_replace({e}, '<[^>]+>', ' ', 'g')")
    lines = f"regexp_split_to_array({e}, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"array_to_string(list_filter(list_transform({lines}, lambda x: trim(regexp_replace(x, '{WS}', ' ', 'g'))), lambda x: x <> ''), chr(10))[1:{t.DESCRIPTION_LIMIT}]"


#: Normalised listings with identities, and distinct ones (first of each fingerprint).
LISTINGS = f"""
l0 AS MATERIALIZED (
  SELECT listing_id, ord, posted, tags, {norm_title('title')} AS title, {norm('company')} AS company, {norm('location')} AS location,
         {url('url')} AS url, lower({norm('source')}) AS source, {description('description')} AS description,
         {fingerprint('company', 'title', 'url')} AS fingerprint, {company_key('company')} AS company_key, {title_key('title')} AS title_key
  FROM listings
), l AS MATERIALIZED (SELECT *, company_key || '|' || title_key AS vacancy_key FROM l0 WHERE title <> '' AND company <> ''),
u AS MATERIALIZED (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ord, listing_id) = 1)
"""

SENIOR = "[" + ", ".join(q(w) for w in __import__("vacantia.operators.entity", fromlist=["SENIORITY"]).SENIORITY) + "]"


def similar(a: str, b: str) -> str:
    """Condition on rows a, b with company_key, title_key, words."""
    emp = (
        f"{a}.company_key <> '' AND {b}.company_key <> '' AND ({a}.company_key = {b}.company_key OR starts_with({b}.company_key, {a}.company_key || ' ')"
        f" OR starts_with({a}.company_key, {b}.company_key || ' '))"
    )
    inter = f"len(list_intersect({a}.words, {b}.words))"
    union = f"len(list_distinct(list_concat({a}.words, {b}.words)))"
    apart = f"list_filter(list_distinct(list_concat({a}.words, {b}.words)), lambda w: NOT (list_contains({a}.words, w) AND list_contains({b}.words, w)))"
    close = f"(NOT list_has_any({apart}, {SENIOR}) AND {inter} >= 0.6 * {union} AND {a}.title_key <> '' AND {b}.title_key <> '')"
    return f"{emp} AND ({a}.title_key = {b}.title_key OR replace({a}.title_key, ' ', '') = replace({b}.title_key, ' ', '') OR {close})"


def words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def detect(x: str) -> str:
    """Columns n, best, second of the word counts of text x, then the language."""
    from ..operators import lang

    toks = f"regexp_extract_all(lower(coalesce({x}, '')), {q(lang.TOKEN)})"
    hits = ", ".join(
        f"{{'n': len(list_filter(toks, lambda w: list_contains([{', '.join(q(w) for w in ws)}], w))), 'o': {-i}, 'lang': '{code}'}}"
        for i, (code, ws) in enumerate(lang.distinctive().items())
    )
    return toks, f"list_reverse_sort([{hits}])"


def _places(t: str, pattern: str, kind: int) -> str:
    """list of {centre, kind}: centres of a pattern's matches in t."""
    parts, found = f"regexp_split_to_array({t}, {q(pattern)})", f"regexp_extract_all({t}, {q(pattern)})"
    before = lambda xs, to: f"coalesce(list_sum(list_transform({xs}[1:{to}], lambda y: length(y))), 0)"
    return (
        f"list_transform(range(1, len({found}) + 1), lambda i: {{'centre': ((2 * ({before(parts, 'i')} + {before(found, 'i - 1')}) + length({found}[i])) // 2)::INT, 'kind': {kind}}})"
    )


def _blank(t: str, pattern: str) -> str:
    pairs = f"list_zip(regexp_split_to_array({t}, {q(pattern)}), regexp_extract_all({t}, {q(pattern)}))"
    return f"array_to_string(list_transform({pairs}, lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE repeat(' ', length(z[2])) END), '')"


def evidence(source: str, key: str, text: str) -> str:
    """CTEs ending in ``ev``: key, ad_language, required, preferred, waived (sorted lists), english_workplace.

    A clause is taken apart into words and single other characters, so a language's name is
    a whole word by construction; what follows it is looked at in the rest of the clause.
    """
    from ..operators import evidence as e, lang

    names = "MAP {" + ", ".join(f"{q(n)}: {q(c)}" for c, ns in e.NAMES.items() for n in ns) + "}"
    heads = "MAP {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in e.COMPOUNDS.items()) + "}"
    compound = f"({'|'.join(e.COMPOUNDS)})(?:{e.COMPOUND_ENDS})"
    followers = "[" + ", ".join(q(f) for f in sorted(set(e.FOLLOWERS))) + "]"
    letter = r"[\p{L}\p{Nl}\p{No}]"
    weak = e.WEAK.replace(r"\bé", r"(?:^|[^\p{L}\p{N}_])é")
    any_name = "|".join(sorted({n for ns in e.NAMES.values() for n in ns} | set(e.COMPOUNDS), key=len, reverse=True))
    toks, hits = detect("t")
    return f"""
e0 AS MATERIALIZED (SELECT {key} AS k, coalesce({text}, '') AS t FROM {source}),
e1 AS (SELECT k, unnest(list_distinct(regexp_split_to_array(lower(t), {q(e.CLAUSE)}))) AS c FROM e0),
e2 AS (SELECT k, c, regexp_extract_all(c, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]') AS p FROM e1 WHERE regexp_matches(c, {q(any_name)})),
e3 AS (SELECT k, c, p, unnest(range(1, len(p) + 1)) AS i FROM e2),
e4 AS (SELECT k, c, p[i] AS w, CASE WHEN i > 1 THEN p[i - 1] ELSE '' END AS prev, coalesce(list_sum(list_transform(p[1:i - 1], lambda y: length(y))), 0)::INT AS pos FROM e3
  WHERE ({names})[p[i]] IS NOT NULL OR regexp_full_match(p[i], {q(compound)})),
e5 AS (SELECT k, c, pos, ({names})[w] AS named, ({heads})[regexp_extract(w, {q('^' + compound + '$')}, 1)] AS joined, prev, c[pos + length(w) + 1:] AS rest FROM e4),
e6 AS (SELECT k, c, pos, coalesce(named, joined) AS code FROM e5 WHERE joined IS NOT NULL OR (prev <> '-' AND (regexp_matches(rest, '^\\s*[,:/()&]')
  OR list_contains({followers} || [''], regexp_extract(rest, '^\\s*[-–]?\\s*({letter}+)', 1))))),
m0 AS (SELECT DISTINCT c FROM e6), m1 AS (SELECT c, {_blank('c', e.WAIVE)} AS a FROM m0), m2 AS (SELECT c, a, {_blank('a', e.SOFT)} AS b FROM m1),
m3 AS (SELECT c, {_places('c', e.WAIVE, 0)} || {_places('a', e.SOFT, 1)} || {_places('b', e.STRONG, 2)} AS cues, regexp_matches(b, {q(weak)}) AS weak FROM m2),
e7 AS (SELECT k, c, code, CASE WHEN len(cues) > 0 THEN list_sort(list_transform(cues, lambda x: {{'d': abs(x.centre - pos), 'kind': x.kind}}))[1].kind WHEN weak THEN 2 END AS v FROM e6 JOIN m3 USING (c)),
e8 AS (SELECT k, c, code, max(CASE v WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS s FROM e7 WHERE v IS NOT NULL GROUP BY ALL),
e9 AS (SELECT k, coalesce(list_sort(list(DISTINCT code) FILTER (WHERE s = 2)), []) AS w, coalesce(list_sort(list(DISTINCT code) FILTER (WHERE s = 1)), []) AS r,
  coalesce(list_sort(list(DISTINCT code) FILTER (WHERE s = 0)), []) AS p FROM e8 GROUP BY k),
d0 AS (SELECT k, t, {toks} AS toks FROM e0), d1 AS (SELECT k, t, len(toks) AS n, {hits} AS h FROM d0),
d2 AS (SELECT k, t, CASE WHEN h[1].n = 0 THEN NULL WHEN n < {lang.SHORT_TEXT} THEN CASE WHEN h[2].n = 0 THEN h[1].lang END
  WHEN h[1].n >= {lang.MIN_HITS} AND h[1].n >= {lang.MIN_LEAD} * h[2].n AND h[1].n / n >= {lang.MIN_SHARE} THEN h[1].lang END AS ad_language FROM d1),
ev AS MATERIALIZED (SELECT d2.k AS k, ad_language, list_filter(coalesce(r, []), lambda x: NOT list_contains(w, x)) AS required,
  list_filter(coalesce(p, []), lambda x: NOT list_contains(w, x) AND NOT list_contains(r, x)) AS preferred, coalesce(w, []) AS waived,
  regexp_matches(lower(t), {q(lang.ENGLISH_WORKPLACE)}) AS english_workplace FROM d2 LEFT JOIN e9 USING (k))"""


def verdict(profile) -> str:
    """CTE ``vd`` over ``ev``: k, level, label, reason, languages, stated."""
    from ..operators import verdict as v

    table = "MAP {" + ", ".join(f"{q(c)}: {q(n)}" for c, n in v.LANGUAGES.items()) + "}"
    arr = lambda xs: "[" + ", ".join(q(x) for x in sorted(xs)) + "]"
    names = lambda x: f"array_to_string(list_transform({x}, lambda y: ({table})[y]), ' + ')"
    foreign = lambda x: f"list_sort(list_filter({x}, lambda y: NOT list_contains({arr(profile.fluent)}, y)))"
    basic = f"list_filter(missing, lambda y: list_contains({arr(profile.basic)}, y))"
    return f"""
v0 AS (SELECT *, {foreign('required')} AS missing, {foreign('preferred')} AS soft, {foreign('waived')} AS free, coalesce(ad_language, list_sort(required)[1]) AS shown FROM ev),
v1 AS (SELECT *, CASE WHEN len(missing) > 0 THEN 'blocked' WHEN ad_language IS NOT NULL AND NOT list_contains({arr(profile.fluent)}, ad_language) AND NOT english_workplace
    AND NOT list_contains(waived, ad_language) AND NOT list_contains(preferred, ad_language) THEN 'likely' WHEN len(soft) > 0 THEN 'plus'
    WHEN english_workplace OR len(free) > 0 OR shown IS NOT NULL THEN 'ok' ELSE 'unknown' END AS level FROM v0),
vd AS (SELECT k, level, level = 'ok' AND (english_workplace OR len(free) > 0) AS stated, soft,
  CASE level WHEN 'blocked' THEN 'Needs ' || {names('missing')} WHEN 'likely' THEN 'Ad in ' || ({table})[ad_language] WHEN 'plus' THEN {names('soft')} || ' a plus'
    WHEN 'unknown' THEN '?' ELSE CASE WHEN english_workplace THEN 'English workplace' WHEN len(free) > 0 THEN 'No ' || {names('free')} || ' needed' ELSE ({table})[shown] END END AS label,
  CASE level WHEN 'blocked' THEN 'ad requires ' || {names('missing')} || CASE WHEN len({basic}) > 0 THEN ' (you have basic ' || {names(basic)} || ')' ELSE '' END
    WHEN 'likely' THEN 'ad is written in ' || ({table})[ad_language] || CASE WHEN list_contains({arr(profile.basic)}, ad_language) THEN ' (you have basic)' ELSE '' END
    WHEN 'plus' THEN {names('soft')} || ' is a plus' WHEN 'unknown' THEN 'no language information in the ad'
    ELSE CASE WHEN english_workplace THEN 'working language is English' WHEN len(free) > 0 THEN 'ad says ' || {names('free')} || ' is not required' ELSE 'ad is in ' || ({table})[shown] END END AS reason
  FROM v1)"""
