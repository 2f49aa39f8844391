"""Spellings of names that mean the same person or organisation, linked.

Method: a symmetric-delete neighbourhood index on the words of the names finds words one
or two edits apart (both lose as many letters and meet in the same shorter word; of long
words the first ``PREFIX`` letters do, which loses no pair). Names that share such words
and a trade, or of which one states no trade, are aligned by the optimal assignment of their words, in which an
initial, a nickname or an abbreviation may stand for the full word, words may be joined,
split or in another order, and words that only describe the trade may be left out.

A pair that agrees in every word is a strong link; one that leaves something out (a
dropped trade, an initial) is a weak link, and holds only if all the weak links of that
spelling lead to one and the same name: "F. Noravol" joins nobody while both a Frederik
and a Francisca Noravol exist. Links are closed by connected components.

No bucket is expanded into all its pairs: within a bucket of the index every word is
linked to the bucket's most frequent word only. The names of a block (a word and a trade)
all meet. Of a word that very many names have (``HOT``) only those meet that also share a
second such word, or what may stand for the rest of the name: all words of an accepted
pair are aligned, so its names have a rarer word in common or share that (``_narrow``). A
test of letters that every accepted pair passes is part of the join, before the comparison.

Defined cases: null and empty names are no names and have no row; names are compared as
given (callers fold them); a name without any other spelling is in no pair; repeated
rows change nothing; an empty table gives an empty result. Only the named column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.components import connected_components
from ..session import cut, dealt
from .strings import osa

#: Names of a block above which they need more than its word in common; names of a part of what is left.
HOT = 200
#: In place of a second word: the names are compared as a whole.
WHOLE = "-"
#: Letters of a word the neighbourhood index looks at.
PREFIX = 12
# Words for a trade or form of organisation, additions, abbreviations, nicknames.
TRADES = frozenset(
    "engineering marine research analytics security insurance energy diagnostics networks software pharma pharmaceuticals foods logistics interactive systems instruments "
    "studios games payments robotics technologies technology solutions mobility media recruitment design law translations advisory consulting architects accounting training "
    "international global industrial united nordic applied clinical digital bank capital health finance electronics construction motors airlines chemicals materials "
    "automation telecom entertainment publishing education pictures".split()
)
ADDITIONS = frozenset(
    "hq labs services group scandinavia europe holding holdings branch partners division office company co subsidiary ltd limited gmbh ab aps as sa "
    "sas inc bv nv srl spa ag oy plc llc corp publ".split()
)
ABBREVIATIONS = {
    "dx": ("diagnostics",), "sw": ("software",), "ia": ("interactive",), "anl": ("analytics",), "rsch": ("research",), "std": ("studios",), "trng": ("training",),
    "engrg": ("engineering",), "solns": ("solutions",), "intl": ("international",), "mgmt": ("management",), "cons": ("consulting",), "acct": ("accounting",),
    "arch": ("architects",), "pmts": ("payments",), "pmt": ("payments",), "rx": ("pharma",), "sec": ("security",), "svcs": ("services",), "grp": ("group",),
}
SAME_TRADE = {"pharmaceuticals": "pharma", "technology": "technologies"}
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bobby": "robert", "bill": "william", "will": "william", "wim": "william", "lisa": "elisabeth", "liz": "elisabeth", "beth": "elisabeth",
    "else": "elisabeth", "ella": "elisabeth", "betty": "elisabeth", "kaja": "katarina", "kat": "katarina", "kate": "katarina", "karin": "katarina", "trine": "katarina",
    "bo": "ingeborg", "inge": "ingeborg", "inga": "ingeborg", "thea": "theodora", "dora": "theodora", "theo": "theodora", "meta": "margrethe", "grete": "margrethe",
    "greta": "margrethe", "rita": "margrethe", "maggie": "margrethe", "alex": "alexander", "sander": "alexander", "sasha": "alexander", "xander": "alexander",
    "fran": "francisca", "franzi": "francisca", "cisca": "francisca", "paca": "francisca", "fred": "frederik", "frede": "frederik", "fritz": "frederik", "rik": "frederik",
    "sus": "susanne", "sanne": "susanne", "susi": "susanne", "sue": "susanne", "niko": "nikolaj", "nico": "nikolaj", "klaus": "nikolaj", "nik": "nikolaj", "tori": "victoria",
    "vicky": "victoria", "vic": "victoria", "chris": "christoffer", "stoffer": "christoffer", "kris": "christoffer", "leo": "leonhard", "leon": "leonhard", "lena": "magdalena",
    "magda": "magdalena", "malene": "magdalena", "hans": "johannes", "jo": "johannes", "jan": "johannes", "john": "johannes", "gianni": "giovanni", "vanni": "giovanni", "nino": "giovanni",
}
# End of fixed values.


@lru_cache(maxsize=200_000)
def _trade(word: str, late: bool) -> frozenset[str]:
    """The trades a word may stand for; abbreviations count behind the first word only."""
    if word in TRADES:
        return frozenset((SAME_TRADE.get(word, word),))
    if not late:
        return frozenset()
    if word in ABBREVIATIONS:
        return frozenset(ABBREVIATIONS[word])
    out = set()
    for t in TRADES:
        if len(word) >= 6 and len(t) >= 6 and osa(word, t, 2 if len(t) >= 9 else 1) <= (2 if len(t) >= 9 else 1):
            out.add(t)
        elif 2 <= len(word) <= 8 and t.startswith(word) and len(word) < len(t):
            out.add(SAME_TRADE.get(t, t))
        elif 3 <= len(word) <= 5 and word[0] == t[0] and word[-1] == t[-1] and len(word) < len(t) - 1 and _within(word, t):
            out.add(t)
    return frozenset(out)


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def _said(name: str) -> int:
    """How much a name says: its trades, then the letters of its words."""
    core, trades = parse(name)
    return sum(map(len, core)) + 100 * len(trades)


@lru_cache(maxsize=100_000)
def parse(name: str) -> tuple[tuple[str, ...], tuple[frozenset[str], ...]]:
    """(words of the name proper, trades named)."""
    words = name.split()
    while len(words) > 1 and words[-1] in ADDITIONS:
        words.pop()
    while len(words) > 2 and words[0] in ADDITIONS:
        words = words[1:]
    # Reordered names carry the trade in front, also a shortened one.
    # (a split-off beginning of a word is followed by a short rest, not by whole words).
    head = words[0] if words else ""
    short = head in ABBREVIATIONS or (len(head) >= 3 and any(t.startswith(head) for t in TRADES - {head}))
    if len(words) >= 3 and short and head not in TRADES and head not in NICKNAMES and all(len(w) >= 5 and not _trade(w, True) for w in words[1:]):
        return tuple(words[1:]), (_trade(head, True),)
    core: list[str] = []
    trades: list[frozenset[str]] = []
    for i, w in enumerate(words):
        # An abbreviation stands at the end: only trades and additions may follow it.
        tail = all(x in ADDITIONS or _trade(x, True) for x in words[i + 1 :])
        t = _trade(w, bool(core) and tail and (i > 1 or len(words) == 2 or len(core[0]) > 8))
        if t and (core or w in TRADES):
            trades.append(t)
        elif w in ADDITIONS and core:
            continue
        else:
            core.append(w)
    if not core:
        core = words
    return tuple(core), tuple(trades)


def _stands_for(a: str, b: str) -> bool:
    """Whether the first word is an initial, a nickname or the beginning of the second."""
    if len(a) == 1:
        return b[0] == a and len(b) > 2
    return NICKNAMES.get(a) == b or (3 <= len(a) <= 5 and len(b) >= len(a) + 2 and b.startswith(a))


@lru_cache(maxsize=500_000)
def _word_cost(a: str, b: str) -> tuple[int, bool] | None:
    """(edits, stands-for): how two words match, None if they do not."""
    if a == b:
        return 0, False
    if len(a) > len(b):
        a, b = b, a
    if _stands_for(a, b):
        return 0, True
    if len(a) < 4:
        return None
    limit = 1 if len(b) < 9 else 2
    d = osa(a, b, limit)
    return (d, False) if d <= limit else None


@lru_cache(maxsize=50_000)
def _merges(words: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The words with neighbours joined in either order (initials stay apart): in every way for up
    to three words, of more words any two neighbours or all of them."""
    if len(words) > 3:
        one = [
            words[:i] + (j,) + words[i + 2 :]
            for i in range(len(words) - 1) if len(words[i]) > 1 and len(words[i + 1]) > 1
            for j in (words[i] + words[i + 1], words[i + 1] + words[i])
        ]
        return [words, *one, ("".join(words),)]
    out = [()]
    for i, w in enumerate(words):
        joined = [x for x in out if i and len(w) > 1 and len(x[-1]) > 1]
        out = [x + (w,) for x in out] + [x[:-1] + (x[-1] + w,) for x in joined] + [x[:-1] + (w + x[-1],) for x in joined]
    return out


def _assign(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[int, int] | None:
    """(edits, words that stand for others) of the best one-to-one alignment."""
    if len(a) > 4:
        return _assign_many(a, b)
    fits = []
    for x in a:
        row = [(j, c) for j, y in enumerate(b) if (c := _word_cost(x, y)) is not None]
        if not row:
            return None
        fits.append(row)
    best: list[tuple[int, int]] = []

    def place(i: int, taken: int, edits: int, stands: int) -> None:
        if best and edits + stands >= sum(best[0]):
            return
        if i == len(fits):
            best[:] = [(edits, stands)]
            return
        for j, c in fits[i]:
            if not taken >> j & 1:
                place(i + 1, taken | 1 << j, edits + c[0], stands + c[1])

    place(0, 0, 0, 0)
    return best[0] if best else None


def _assign_many(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[int, int] | None:
    """The same for any number of words: each word in turn by a cheapest augmenting path."""
    n = len(a)
    costs = []
    for x in a:
        costs.append([_word_cost(x, y) for y in b])
        if all(c is None for c in costs[-1]):
            return None
    far = 1000 * n  # beyond any alignment of words that match
    price = [[far if c is None else c[0] + c[1] for c in row] for row in costs]
    u, v, of = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    for i in range(n):
        of[n], j = i, n
        least, back, done = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while of[j] >= 0:
            done[j] = True
            row = of[j]
            for k in range(n):
                if not done[k] and price[row][k] - u[row] - v[k] < least[k]:
                    least[k], back[k] = price[row][k] - u[row] - v[k], j
            to = min((k for k in range(n) if not done[k]), key=lambda k: least[k])
            step = least[to]
            for k in range(n + 1):
                if done[k]:
                    u[of[k]] += step
                    v[k] -= step
                elif k < n:
                    least[k] -= step
            j = to
        while j != n:
            of[j], j = of[back[j]], back[j]
    got = [costs[of[k]][k] for k in range(n)]
    return None if None in got else (sum(c[0] for c in got), sum(c[1] for c in got))


@lru_cache(maxsize=100_000)
def _bag(words: tuple[str, ...]) -> tuple[int, ...]:
    """Counts of the letters; letters may share one of the 32 places."""
    out = [0] * 32
    for w in words:
        for c in w:
            out[ord(c) & 31] += 1
    return tuple(out)


@lru_cache(maxsize=100_000)
def _tokens(words: tuple[str, ...]) -> tuple[frozenset[str], tuple[str, ...]]:
    """(words and joined words of a name, those of them that may stand for a longer one)."""
    every = frozenset(w for m in _merges(words) for w in m)
    return every, tuple(w for w in every if len(w) <= 5 or w in NICKNAMES)


def _stands(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether a word of a, maybe joined, stands for one of b."""
    return any(_stands_for(x, y) for x in _tokens(a)[1] for y in _tokens(b)[0])


def compare(x: str, y: str) -> int:
    """2 for a strong link, 1 for a weak one, 0 for none."""
    (ca, ta), (cb, tb) = parse(x), parse(y)
    letters = min(sum(map(len, ca)), sum(map(len, cb)))
    if letters < 5:
        return 2 if x == y else 0
    left, right = (ta, tb) if len(ta) <= len(tb) else (tb, ta)
    rest = list(right)
    for t in left:
        fit = next((r for r in rest if r & t), None)
        if fit is None:
            return 0
        rest.remove(fit)
    # Without a word that stands for another the names are two edits apart: each changes two letters at most.
    bag, other = _bag(ca), _bag(cb)
    if sum(map(abs, map(sub, bag, other))) > 4 and not _stands(ca, cb) and not _stands(cb, ca):
        return 0
    best = None
    for a in _merges(ca):
        for b in _merges(cb):
            if len(a) != len(b) or (len(a) == 1 and max(len(ca), len(cb)) > 1 and min(len(a[0]), len(b[0])) < 8):
                continue
            got = _assign(a, b)
            # A word that stands for another needs the rest of the name beside it.
            if got and got[0] <= 2 and (got[1] == 0 or (got[1] == 1 and sum(len(w) for w in a if len(w) > 5) >= 10)):
                if best is None or sum(got) < sum(best):
                    best = got
        if best == (0, 0):
            break
    if best is None:
        return 0
    return 1 if rest or best[1] else 2


def _index_places(name: str) -> dict[str, list[frozenset[int]]]:
    """The words the index holds of a name, each with the places in it that it covers (once for each way)."""
    core, _ = parse(name)
    out: dict[str, list[frozenset[int]]] = {}
    for i, w in enumerate(core):
        if len(w) >= 3:
            out.setdefault(w, []).append(frozenset((i,)))
    for i in range(len(core) - 1):
        for w in (core[i] + core[i + 1], core[i + 1] + core[i]):
            out.setdefault(w, []).append(frozenset((i, i + 1)))
    out.setdefault("".join(core), []).append(frozenset(range(len(core))))
    return out


def _index_words(name: str) -> list[str]:
    return sorted(_index_places(name))


def _beginnings(words: list[str]) -> set[str]:
    """The first three letters of the words and of what they can be joined to, whatever the order."""
    out = set()
    for i, w in enumerate(words):
        if len(w) >= 3:
            out.add(w[:3])
            continue
        for j, x in enumerate(words):
            if j != i:
                out |= {(w + x)[:3]} if len(w + x) >= 3 else {(w + x + y)[:3] for k, y in enumerate(words) if k not in (i, j)}
    return out


def _narrow(name: str, hot: list[tuple[str, int]]) -> set[tuple[str, int, str, str]]:
    """(key, side, word, second word): what two names of a hot block have in common beside it, if they are alike.

    hot: the words that brought the name into hot blocks, with these. In an accepted pair
    all words are aligned, and all but one that stands for another within two edits. Names
    without a common block that is not hot therefore share two hot words, or one and what
    stands for the rest: side 1 has the initial, nickname or beginning, side 2 what it may
    stand for; on side 0 all meet. A name with a word in no hot block meets no other here
    unless that word is what stands or is stood for.
    """
    core, _ = parse(name)
    places = _index_places(name)
    at = [(w, b, pos) for w, b in hot for pos in places[w]]
    covered = frozenset().union(*(pos for _, _, pos in at))
    cold = [i for i, w in enumerate(core) if i not in covered and len(w) >= 3]
    one = len(cold) < 2 or (len(cold) == 2 and cold[1] - cold[0] == 1)
    out: set[tuple[str, int, str, str]] = set()
    for w, b, pos in at:
        rest = [i for i in range(len(core)) if i not in pos]
        # Three words joined in another order than they stand in: the index has no such word. Two
        # edits in a rest of nine letters, which stands together, would have met in that.
        letters, left = sum(map(len, core)), sum(len(core[i]) for i in rest)
        if len(core) == 3 and rest and (pos == {1} or left <= 10):
            out |= {(f"{b} J{n}", 1, w, WHOLE) for n in range(letters - 2, letters + 3)}
        if len(rest) and (len(core) == 2 or (len(core) == 3 and (pos == {1} or left <= 12))):
            out.add((f"{b} J{letters}", 2, w, WHOLE))
        if not one:
            continue
        if not rest:
            out.add((f"{b} E", 0, w, ""))
        words = [core[i] for i in rest]
        out |= {(f"{b} I{x[0]}", 2, w, "") for x in words} | {(f"{b} P{x}", 2, w, "") for x in _beginnings(words)}
        short = set()
        for i in rest:
            if not set(cold) <= {i}:
                continue
            x = core[i]
            if len(x) == 1:
                short.add(f"I{x}")
            elif 3 <= len(x) <= 5:
                short.add(f"P{x[:3]}")
            if x in NICKNAMES:
                short.add(f"P{NICKNAMES[x][:3]}")
            if len(x) < 3 and not cold:
                out.add((f"{b} X{x}", 0, w, ""))
        for i, j in zip(rest, rest[1:]):
            if j == i + 1 and set(cold) <= {i, j} and len(core[i]) > 1 and len(core[j]) > 1:
                for x in (core[i] + core[j], core[j] + core[i]):
                    if len(x) <= 5:
                        short.add(f"P{x[:3]}")
                    if x in NICKNAMES:
                        short.add(f"P{NICKNAMES[x][:3]}")
        out |= {(f"{b} {x}", 1, w, "") for x in short}
        if not cold:
            out |= {(f"{b} {c}", 0, w, v) for v, c, other in at if b <= c and not pos & other}
    return out


def _shape(name: str) -> tuple[list[str], int, int, bool]:
    """(trades, letters, set of letters, short): what a trade or two edits can change only so far.

    Two names that state trades have one in common. Without a short word or nickname on
    either side no word stands for another, so an accepted pair is two edits apart: two
    letters in length, four in the set of letters. Letters share the 63 places of the set;
    that only lets more pairs through.
    """
    core, trades = parse(name)
    mask = 0
    for c in set("".join(core)):
        mask |= 1 << (ord(c) % 63)
    return sorted(set().union(*trades)), sum(map(len, core)), mask, any(len(w) <= 5 or w in NICKNAMES for w in core)


_POWERS = np.cumprod(np.full(PREFIX, 0x9E3779B97F4A7C15, dtype=np.uint64))


def _shorter(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, hash): the words' beginnings, with one letter left out, or with two from nine letters on.

    Two edits are allowed to words of which the longer has nine letters; the shorter then
    lacks what the longer loses, and need not lose two itself below that length. Words of
    one length are hashed together; words that share a hash by chance only meet once more.
    """
    groups: dict[tuple[int, int], list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault((min(len(w), PREFIX), 2 if len(w) >= 9 else 1 if len(w) >= 4 else 0), []).append(i)
    at, out = [], []
    for (n, most), rows in groups.items():
        codes = np.array([[ord(c) for c in words[i][:PREFIX]] for i in rows], dtype=np.uint64)
        for lost in range(most + 1):
            for keep in combinations(range(n), n - lost):
                at.append(np.array(rows))
                out.append((codes[:, keep] * _POWERS[: n - lost]).sum(axis=1, dtype=np.uint64))
    hashes = np.concatenate(out)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate(at), (hashes ^ (hashes >> np.uint64(29))).view(np.int64)


def _meet(rows: DataFrame) -> DataFrame:
    """(a, b): the names of the rows (name, block, side, word, second, trades, letters, mask, short) that share a block and could be alike.

    Names that state trades meet by each of them, a name that states none meets all. A
    block also holds words that are not close to each other (all are to its most frequent
    one): the words that brought two names there have to be. The right side's keys of
    many names are taken in parts, each of which meets the left side's rows once.
    """
    stated = F.transform("trades", lambda t: F.concat(F.lit("="), t))
    left_tags = F.when(F.size("trades") == 0, F.array(F.lit("none"))).otherwise(F.concat(stated, F.array(F.lit("some"))))
    right_tags = F.when(F.size("trades") == 0, F.array(F.lit("none"), F.lit("some"))).otherwise(F.concat(stated, F.array(F.lit("none"))))
    keyed = lambda tags: F.explode(F.transform(tags, lambda t: F.xxhash64(F.col("block"), t, F.least(F.col("side"), F.lit(1))))).alias("key")
    columns = ["name", "side", "word", "second", "letters", "mask", "short"]
    left = rows.where("side < 2").select(*columns, keyed(left_tags))
    right = rows.where("side <> 1").select(*columns, keyed(right_tags))
    many = right.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(many, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    right = right.join(many, "key", "left").withColumn("part", F.pmod(F.xxhash64("name"), parts))
    # Two swaps of neighbours are two edits there and four here.
    near = lambda w: f"(l.{w} = r.{w} OR (abs(length(l.{w}) - length(r.{w})) <= 2 AND levenshtein(l.{w}, r.{w}, 4) >= 0))"
    # Names that can only be alike as a whole are two edits apart, whatever stands for what.
    close = f"(((l.short OR r.short) AND l.second <> '{WHOLE}') OR (abs(l.letters - r.letters) <= 2 AND bit_count(l.mask ^ r.mask) <= 4)) AND {near('word')} AND {near('second')}"
    order = "(l.name < r.name OR (l.side = 1 AND l.name <> r.name))"
    return left.alias("l").join(right.alias("r"), F.expr(f"l.key = r.key AND l.part = r.part AND {order} AND {close}")).select(
        F.least("l.name", "r.name").alias("a"), F.greatest("l.name", "r.name").alias("b")
    ).distinct()


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of distinct names that share a block and could be alike."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(n, _index_words(n), *_shape(n)) for n in df["name"]]
            yield pd.DataFrame(rows, columns=["name", "words", "trades", "letters", "mask", "short"])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                at, hashes = _shorter(some.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(hashes), some.column(1).take(pa.array(at))], ["bucket", "own"])

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(n, *r) for n, hot in zip(df["name"], df["hot"]) for r in _narrow(n, [(x["word"], x["block"]) for x in hot])]
            yield pd.DataFrame(rows, columns=["name", "key", "side", "word", "second"])

    read_names = cut(distinct.mapInPandas(read, "name string, words array<string>, trades array<string>, letters int, mask bigint, short boolean"))
    by_word = read_names.select("name", F.explode("words").alias("word")).select("name", "word", F.xxhash64("word").alias("w"))
    df = by_word.groupBy("w").agg(F.count("*").alias("df"), F.min("word").alias("word"))
    # A word's number orders it by its names; two words that share one by chance only meet once more.
    number = F.shiftleft(F.least("df", F.lit((1 << 20) - 1)), 42).bitwiseOR(F.shiftrightunsigned("w", 22))
    df = cut(dealt(df.select("w", "word", number.alias("own")), "w"))
    # Moved and sorted once. A bucket has few words: what one or two letters make of its own.
    index = df.select("word", "own").mapInArrow(shorten, "bucket bigint, own bigint")
    bucket = Window.partitionBy("bucket")
    met = index.select("own", F.max("own").over(bucket).alias("block"), F.min("own").over(bucket).alias("least")).where("least < block")
    near = met.select("own", "block").distinct().join(df.select("w", "own"), "own").select("w", "block")
    blocks = cut(by_word.join(near.unionByName(df.select("w", F.col("own").alias("block"))), "w").select("name", "block", "word").distinct())
    hot = blocks.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("block", F.lit(True).alias("hot"))
    marked = cut(blocks.join(hot, "block", "left"))
    few = marked.where("hot IS NULL").select("name", "block", F.lit(0).alias("side"), "word", F.lit("").alias("second"))
    many = (
        marked.where("hot").groupBy("name").agg(F.collect_list(F.struct("word", "block")).alias("hot"))
        .mapInPandas(narrow, "name string, key string, side int, word string, second string")
        .select("name", F.xxhash64("key").alias("block"), "side", "word", "second")
    )
    return _meet(cut(few.unionByName(many).join(read_names.drop("words"), "name")))


def link(names: DataFrame, name: str) -> DataFrame:
    """(name, entity): every name that has another spelling, with its entity's least name."""
    distinct = cut(dealt(names.select(F.col(name).alias("name")).where(F.trim("name") != "").distinct(), "name"))
    pairs = dealt(candidates(distinct), "a")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df["s"] = pd.array([compare(a, b) for a, b in zip(df["a"], df["b"])], dtype="int32")
            df = df[df["s"] > 0]
            yield df.assign(a_less=[_said(a) < _said(b) for a, b in zip(df["a"], df["b"])])

    links = cut(pairs.mapInPandas(verify, "a string, b string, s int, a_less boolean"))
    weak = links.where("s = 1").select(
        F.when(F.col("a_less"), F.col("a")).otherwise(F.col("b")).alias("less"),
        F.when(F.col("a_less"), F.col("b")).otherwise(F.col("a")).alias("more"),
    )
    edges = links.where("s = 2").select("a", "b")
    # Names that weak links join can be the one name that further weak links lead to. Each
    # round that goes on joins components, so the rounds end.
    while True:
        of = connected_components(edges)
        placed = (
            weak.join(of.select(F.col("node").alias("less"), F.col("component").alias("cl")), "less", "left")
            .join(of.select(F.col("node").alias("more"), F.col("component").alias("cm")), "more", "left")
            .select(F.coalesce("cl", "less").alias("cl"), F.coalesce("cm", "more").alias("cm")).where("cl <> cm").distinct()
        )
        held = cut(placed.groupBy("cl").agg(F.count("*").alias("k"), F.min("cm").alias("cm")).where("k = 1").select(F.col("cl").alias("a"), F.col("cm").alias("b")))
        if held.isEmpty():
            return of.select(F.col("node").alias("name"), F.col("component").alias("entity"))
        edges = cut(edges.unionByName(held))


def pairs_of(entities: DataFrame) -> DataFrame:
    """(key_a, key_b): all pairs of an entity's names, key_a < key_b by code point."""
    return (
        entities.alias("l").join(entities.alias("r"), F.expr("l.entity = r.entity AND l.name < r.name"))
        .select(F.col("l.name").alias("key_a"), F.col("r.name").alias("key_b"))
    )
