"""String comparison used inside the operators' Python steps."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters without a decomposition, and how they are typed without accents.
PLAIN = str.maketrans({"ø": "o", "æ": "ae", "ß": "ss", "đ": "d", "ł": "l", "œ": "oe", "ð": "d", "þ": "th"})
SPELLED = str.maketrans({"ø": "oe", "æ": "ae", "ß": "ss", "œ": "oe", "ö": "oe", "ü": "ue", "ä": "ae", "å": "aa"})
# End of fixed values.


def fold(s: str) -> str:
    """Lower case without accents (ü to u, ø to o)."""
    s = unicodedata.normalize("NFKC", s).casefold()
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFKD", s.translate(PLAIN)) if not unicodedata.combining(c))


def fold_spelled(s: str) -> str:
    """Lower case with accents spelled out (ü to ue, ø to oe, å to aa)."""
    s = unicodedata.normalize("NFKC", s).casefold()
    return fold(s.translate(SPELLED))


@lru_cache(maxsize=500_000)
def letter_set(s: str) -> int:
    """The letters of s as bits; letters may share one of the 64 places."""
    out = 0
    for c in s:
        out |= 1 << (ord(c) & 63)
    return out


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment), or limit+1."""
    if a == b:
        return 0
    # An edit changes the set of letters by two at most.
    if abs(len(a) - len(b)) > limit or (letter_set(a) ^ letter_set(b)).bit_count() > 2 * limit:
        return limit + 1
    # Common ends cost nothing.
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b:
        n = len(a) + len(b)
        return n if n <= limit else limit + 1
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        low = i
        for j, y in enumerate(b, 1):
            d = prev[j - 1] if x == y else 1 + min(prev[j - 1], prev[j], cur[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            cur.append(d)
            if d < low:
                low = d
        if low > limit:
            return limit + 1
        before, prev = prev, cur
    return prev[-1] if prev[-1] <= limit else limit + 1
