"""Typed values mapped to a canonical list, unmatched ones reported.

Method: one multi-pattern automaton holds every canonical name and alias (folded and
with accents spelled out). It finds the names embedded in a value; the longest mentions
that do not overlap win. Values without a mention go to token-set similarity: the words
of a name are matched with the words of the value in any order, each within a few edits
of its length (a word of up to three letters exactly; neighbouring words may be joined,
and a word cut by a full stop may be the beginning of a name), and the name whose whole
set of words is found with the most letters, less the edits, is meant.

A name of several entries is settled by a country named beside it. A country that
contradicts the only entry of a name speaks for another place (``0``).

Each distinct value of a batch is resolved once, and a bounded table per worker keeps
resolved values, so the work follows the distinct values and nothing is shuffled. The
list goes to the workers only up to ``MAX_NAMES`` entries, which is checked; a longer list
is taken in blocks of that size. What the blocks find for a value (mentions and similar
names with their entries) is brought together before anything is decided, and the country
words of the whole list go to every block, so blocks change no answer.

Defined cases: a null or blank value has no row; a value that means no entry gives 0; a
tie between entries of one name goes to the one with the smaller id, two names equally
similar give 0; values of any length are read whole; repeated ids give one row each; an
empty list leaves every value unmatched; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import skew_join
from .strings import fold, fold_spelled, osa

MAX_NAMES = 100_000
VALUE_TABLE = 200_000
# Country names in English and their own language by code, and words around a place.
ENDONYMS = {
    "DK": ("danmark", "denmark"), "SE": ("sverige", "sweden"), "NO": ("norge", "norway"), "FI": ("suomi", "finland"), "DE": ("deutschland", "germany"),
    "NL": ("nederland", "netherlands", "holland"), "FR": ("la france", "france"), "IT": ("italia", "italy"), "ES": ("espana", "spain"), "PT": ("portugal",),
    "IE": ("eire", "ireland"), "AT": ("osterreich", "austria"), "BE": ("belgie", "belgique", "belgium"), "CH": ("schweiz", "suisse", "switzerland"),
    "PL": ("polska", "poland"), "GB": ("uk", "united kingdom", "england"), "US": ("usa", "united states"),
}
NOISE = frozenset(
    "remote hybrid or and near greater area region metro centrum city centre center mitte raum og omegn og omland home office work from fully on site onsite"
    " n s e w c k o nv nw ne sw se sydvest nord syd ost vest west south north east hq the in at via rue".split()
)
# End of fixed values.
_TOKEN = re.compile(r"[^\W_]+\.?")


def country_words(rows) -> dict[str, str]:
    """Country code by name: the fixed names and those of the list; rows: (code, name)."""
    out = {w: code for code, words in ENDONYMS.items() for w in words}
    out.update({fold(name): (code or "").upper() for code, name in rows if name})
    return out


def _limit(letters: int) -> int:
    """Edits a word or name of so many letters may have."""
    return 0 if letters < 4 else 1 if letters < 8 else 2 if letters < 11 else 3


class Gazetteer:
    """Names, automaton and word index of one list (or one block of it)."""

    def __init__(self, rows: list[tuple[int, list[str], str, str]], countries: dict[str, str] | None = None, codes: set[str] | None = None):
        """rows: (id, names, country code, country name); countries and codes of the whole list, where this is a block."""
        self.names: dict[str, list[tuple[int, str]]] = {}
        self.countries = countries if countries is not None else country_words([(r[2], r[3]) for r in rows])
        for pid, names, code, _ in sorted(rows):
            for n in names:
                for form in {self._clean(fold(n)), self._clean(fold_spelled(n))}:
                    entry = (pid, (code or "").upper())
                    if form and entry not in self.names.setdefault(form, []):
                        self.names[form].append(entry)
        longest = sorted(self.countries, key=len, reverse=True)
        self._country = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, longest)) + r")(?!\w)")
        self._code = re.compile(r"(?<![^\W_])([A-Za-z]{2})(?![^\W_])")
        self._country_words = {c: set() for c in self.countries.values()}
        for name, c in self.countries.items():
            self._country_words[c] |= set(name.split()) | {c.lower()}
        self.codes = codes if codes is not None else {c for es in self.names.values() for _, c in es if c} | set(ENDONYMS)
        self.forms = sorted(self.names)
        self.automaton = ahocorasick.Automaton()
        for f in self.forms:
            self.automaton.add_word(f, f)
        if self.forms:
            self.automaton.make_automaton()
        # Words of names and whole names without spaces, with the names they belong to.
        of: dict[str, set[str]] = {}
        for f in self.forms:
            for u in (*f.split(), f.replace(" ", "")):
                of.setdefault(u, set()).add(f)
        self.of, self.units = of, sorted(of)
        self.most_words = max((len(f.split()) for f in self.forms), default=1)
        pairs: dict[str, int] = {}
        index = [[pairs.setdefault(p, len(pairs)) for p in self._pairs(u)] for u in self.units]
        self.pairs = pairs
        post: list[list[int]] = [[] for _ in pairs]
        for i, ps in enumerate(index):
            for p in set(ps):
                post[p].append(i)
        self.post = [np.array(p, dtype=np.int32) for p in post]
        self.size = np.array([len(set(p)) for p in index], dtype=np.int32)
        self._known: dict[str, tuple[int, int]] = {}

    @staticmethod
    def _clean(s: str) -> str:
        return " ".join(re.findall(r"[^\W_]+", s))

    @staticmethod
    def _pairs(s: str) -> set[str]:
        t = f"^{s}$"
        return {t[i : i + 2] for i in range(len(t) - 1)}

    def _mentions(self, text: str) -> list[tuple[int, int, str]]:
        """Whole-word mentions: (start, end, name form)."""
        found = []
        if self.forms:
            for end, form in self.automaton.iter(text):
                start, stop = end - len(form) + 1, end + 1
                if (start == 0 or not text[start - 1].isalnum()) and (stop == len(text) or not text[stop].isalnum()):
                    found.append((start, stop, form))
        return found

    def _countries_in(self, raw: str, text: str, skip: list[tuple[int, int]] = ()) -> set[str]:
        rest = text
        for s, e in skip:
            rest = rest[:s] + "|" * (e - s) + rest[e:]
        out = {self.countries[m] for m in self._country.findall(rest)}
        # Two-letter codes only where they stand apart or are written in capitals.
        for m in self._code.finditer(raw):
            c = m.group(1).upper()
            at_end = raw.islower() and (m.start() == 0 or m.end() == len(raw))
            if c in self.codes and (m.group(1).isupper() or at_end or re.search(r"[,(/\-]\s*$", raw[: m.start()])):
                out.add(c)
        return out

    @staticmethod
    def _pick(entries: list[tuple[int, str]], countries: set[str]) -> int:
        """The entry of a name: by country where one is named, else the first."""
        fit = sorted(i for i, c in entries if not countries or c in countries)
        return fit[0] if fit else 0

    def _near(self, word: str) -> list[tuple[int, str]]:
        """(edits, unit) of the words of names within the limit of the word's length, the closest only."""
        if word in self.of:
            return [(0, word)]
        ps = [self.pairs[p] for p in self._pairs(word) if p in self.pairs]
        if not ps or len(word) < 4:
            return []
        shared = np.bincount(np.concatenate([self.post[p] for p in ps]), minlength=len(self.units))
        # An edit disturbs at most two letter pairs (a swap three).
        out: list[tuple[int, str]] = []
        for near in range(1, _limit(len(word)) + 1):
            for i in np.nonzero(shared >= np.maximum(self.size - 3 * near, 2))[0]:
                u = self.units[i]
                # Of a short word the first letter has to be right.
                if len(u) > 3 and (min(len(u), len(word)) > 4 or u[0] == word[0]):
                    d = osa(word, u, near)
                    if d <= near:
                        out.append((d, u))
            if out:
                break
        return sorted(out)

    def _beginnings(self, head: str) -> list[tuple[int, str]]:
        """Names that begin with a word cut short (one typed wrong letter allowed)."""
        exact = [f for f in self.forms if f.startswith(head) and len(f) - len(head) <= 6]
        if exact:
            return [(0, f) for f in exact]
        return [
            (1, f) for f in self.forms
            if len(head) >= 7 and len(f) >= len(head) and min(osa(head, f[:n], 1) for n in (len(head) - 1, len(head), len(head) + 1)) <= 1
        ]

    def _alike(self, words: list[str]) -> list[tuple[int, int, int, str]]:
        """(start, letters, edits, form) of the names whose whole set of words is among the words."""
        bare = [w.rstrip(".") for w in words]
        spans: dict[str, list[tuple[int, int, int]]] = {}
        whole: list[tuple[int, int, int, str]] = []
        for n in range(1, self.most_words + 2):
            for i in range(len(words) - n + 1):
                near = self._near("".join(bare[i : i + n]))
                for d, u in near:
                    spans.setdefault(u, []).append((d, i, n))
                head = " ".join(bare[i : i + n])
                if not near and words[i + n - 1].endswith(".") and len(head) >= 5:
                    whole += [(i, len(head), d, f) for d, f in self._beginnings(head)]
        for f in {f for u in spans for f in self.of[u]}:
            letters, ways = len(f.replace(" ", "")), []
            for units in {(f.replace(" ", ""),), tuple(f.split())}:
                taken: set[int] = set()
                edits, start = 0, len(words)
                for u in sorted(units, key=len, reverse=True):
                    fit = next((x for x in sorted(spans.get(u, ())) if not taken & set(range(x[1], x[1] + x[2]))), None)
                    if fit is None:
                        break
                    taken |= set(range(fit[1], fit[1] + fit[2]))
                    edits, start = edits + fit[0], min(start, fit[1])
                else:
                    if edits <= _limit(letters):
                        ways.append((edits, start))
            if ways:
                edits, start = min(ways)
                whole.append((start, letters, edits, f))
        return whole

    def find(self, value: str) -> list[tuple[int, int, int, int, str, list[tuple[int, str]]]]:
        """What speaks for entries: (kind, start, end or letters, edits, name, entries); kinds 0 and 1 are mentions, 2 similar names."""
        raw = re.sub(r"\s+", " ", value).strip()
        out = []
        for kind, text in enumerate((fold(raw), fold_spelled(raw))):
            out += [(kind, s, e, 0, f, self.names[f]) for s, e, f in self._mentions(text)]
        if not out:
            text = fold(raw)
            named = set().union(*(self._country_words.get(c, {c.lower()}) for c in self._countries_in(raw, text)))
            words = [w for w in _TOKEN.findall(text) if not w[0].isdigit() and w.rstrip(".") not in NOISE and w.rstrip(".") not in named]
            out = [(2, i, n, d, f, self.names[f]) for i, n, d, f in self._alike(words)]
        return out

    def decide(self, value: str, found: list) -> tuple[int, int]:
        """(entry id or 0, score 0..100) from what one or more blocks found."""
        raw = re.sub(r"\s+", " ", value).strip()
        texts = (fold(raw), fold_spelled(raw))
        for kind in (0, 1):
            mentions: dict[tuple[int, int], list] = {}
            for k, s, e, _, _, entries in found:
                if k == kind:
                    mentions.setdefault((s, e), []).extend(map(tuple, entries))
            kept: list[tuple[int, int]] = []
            for m in sorted(mentions, key=lambda m: (m[0] - m[1], m[0])):
                if all(m[1] <= o[0] or m[0] >= o[1] for o in kept):
                    kept.append(m)
            if kept:
                countries = self._countries_in(raw, texts[kind], kept)
                picks = [(self._pick(mentions[m], countries), m[1] - m[0]) for m in sorted(kept)]
                best = max(picks, key=lambda p: (p[0] > 0, p[1]))
                return best[0], 100 if best[0] else 0
        countries = self._countries_in(raw, texts[0])
        alike: dict[tuple, list] = {}
        for k, start, letters, edits, form, entries in found:
            if k == 2:
                alike.setdefault((start, letters, edits, form), []).extend(map(tuple, entries))
        similar = []
        for (start, letters, edits, _), entries in alike.items():
            pid = self._pick(entries, countries)
            if pid:
                similar.append((letters - 2 * edits, -start, pid, edits, letters))
        if not similar:
            return 0, 0
        best = max(similar)
        if any(x[:2] == best[:2] and x[2] != best[2] for x in similar):
            return 0, 0  # equally similar to two entries: no answer
        return best[2], round(100 * (1 - best[3] / (best[4] + 1)))

    def resolve(self, value: str) -> tuple[int, int]:
        """(entry id or 0, score 0..100)."""
        known = self._known.get(value)
        if known is not None:
            return known
        result = self.decide(value, self.find(value))
        if len(self._known) >= VALUE_TABLE:
            self._known.clear()
        if len(value) <= 200:
            self._known[value] = result
        return result


def _rows(block) -> list[tuple[int, list[str], str, str]]:
    return [(r[0], [n for n in r[1] if n], r[2] or "", r[3] or "") for r in block]


def map_values(
    values: DataFrame, reference: DataFrame, key: str, value: str, ref_id: str = "place_id",
    names: tuple[str, ...] = ("place_name", "alt_name"), code: str = "country_code", country: str = "country_name",
    max_names: int = MAX_NAMES,
) -> DataFrame:
    """(key, ref_id, score): the entry each value means, 0 for none."""
    ref = reference.select(
        F.col(ref_id).cast("bigint"), F.array(*[F.col(n) for n in names]), F.col(code).alias("code"), F.col(country).alias("country")
    ).where(F.col(ref_id).isNotNull())
    todo = values.select(F.col(key).alias("k"), F.col(value).alias("v")).where(F.trim(F.regexp_replace("v", r"(?U)[\s\p{Cf}]+", " ")) != "")
    kind = todo.schema["k"].dataType.simpleString()

    n = ref.count()
    if n <= max_names:
        entries = _rows(ref.collect())  # at most max_names rows

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = None
            for df in batches:
                g = g or Gazetteer(entries)
                codes, distinct = pd.factorize(df["v"])
                res = [g.resolve(v) for v in distinct]
                ids = np.array([r[0] for r in res], dtype=np.int64)[codes] if len(res) else np.empty(0, np.int64)
                sc = np.array([r[1] for r in res], dtype=np.int32)[codes] if len(res) else np.empty(0, np.int32)
                yield pd.DataFrame({"k": df["k"], "id": ids, "score": sc})

        out = todo.mapInPandas(run, f"k {kind}, id bigint, score int")
        return out.select(F.col("k").alias(key), F.col("id").alias(ref_id), "score")

    # Country words are few whatever the list's length: one name a country and spelling.
    countries = country_words([tuple(r) for r in ref.select("code", "country").distinct().collect()])
    known = {r[0].upper() for r in ref.select("code").distinct().collect() if r[0]} | set(ENDONYMS)
    parts = -(-n // max_names) + 1
    part = F.pmod(F.xxhash64(F.col(ref_id)), F.lit(parts))
    evidence = "k int, s int, e int, d int, f string, entries array<struct<id: bigint, c: string>>"
    distinct = todo.select("v").distinct()

    def finder(block):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = None
            for df in batches:
                g = g or Gazetteer(block, countries, known)
                rows = [(v, *x[:5], [{"id": i, "c": c} for i, c in x[5]]) for v in df["v"] for x in g.find(v)]
                if rows:
                    yield pd.DataFrame(rows, columns=["v", "k", "s", "e", "d", "f", "entries"])

        return run

    found = None
    for p in range(parts):
        one = distinct.mapInPandas(finder(_rows(ref.where(part == p).collect())), f"v string, {evidence}")
        found = one if found is None else found.unionByName(one)
    # The evidence of a value is bounded by its own length and the entries of its names.
    gathered = distinct.join(found.groupBy("v").agg(F.collect_list(F.struct("k", "s", "e", "d", "f", "entries")).alias("found")), "v", "left")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Gazetteer([], countries, known)
        for df in batches:
            res = [
                g.decide(v, [] if f is None else [(x["k"], x["s"], x["e"], x["d"], x["f"], [(y["id"], y["c"]) for y in x["entries"]]) for x in f])
                for v, f in zip(df["v"], df["found"])
            ]
            yield pd.DataFrame({"v": df["v"], "id": pd.array([r[0] for r in res], dtype="int64"), "score": pd.array([r[1] for r in res], dtype="int32")})

    decided = gathered.mapInPandas(settle, "v string, id bigint, score int")
    counts = todo.groupBy("v").agg(F.count("*").alias("n"))
    out = skew_join(todo, decided.join(counts, "v"), ["v"], "n", F.col("k"))
    return out.select(F.col("k").alias(key), F.col("id").alias(ref_id), "score")
