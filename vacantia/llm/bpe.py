"""Encoding with a public byte-level BPE vocabulary, exact and incremental.

Method: prefix dynamic programming. For a byte-pair vocabulary every prefix of a word
has exactly one valid encoding, and that encoding's last token alone decides which token
may follow. So one array entry per byte prefix, the unique valid last token, is the
whole state: the entry of a prefix is the token t ending there whose predecessor (the
entry of the prefix before t) forms a valid pair with t. Reading the entries backwards
gives the ids. Appending bytes adds entries and changes none.

A text is split into words by the vocabulary's pattern first; words are encoded once per
worker and kept in a bounded table.

Defined cases: null and empty text give an empty list; blank text is encoded as it is;
texts of any length are encoded whole. Special tokens are never produced: their strings
are ordinary text. Repeated ids give one row each. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_FOLDER = "/opt/tokenizers"
# Fixed value: the vocabulary's published pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker; the table is emptied when it is full, so memory is bounded.
WORD_TABLE = 200_000
PAIR_TABLE = 1_000_000
#: Words longer than this many bytes are encoded without being kept.
KEEP_BYTES = 64


class PrefixEncoder:
    """Encodes byte strings by the array of unique valid last tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, list[int]] = {}
        # Token lengths by last byte, longest first: what may end at a given byte.
        ends: dict[int, set[int]] = {}
        for b in ranks:
            ends.setdefault(b[-1], set()).add(len(b))
        self._lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self._split = regex.compile(PATTERN).findall

    @classmethod
    def from_file(cls, path: str) -> "PrefixEncoder":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})

    def _merge(self, data: bytes) -> list[int]:
        """The textbook encoding of a few bytes: merge the lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, first: int, second: int) -> bool:
        """Whether the two tokens, side by side, are their bytes' own encoding."""
        key = (first, second)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIR_TABLE:
                self._pairs.clear()
            known = self._merge(self.token[first] + self.token[second]) == [first, second]
            self._pairs[key] = known
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Entries for every prefix of data beyond those already in ``last`` (in place)."""
        ranks = self.ranks
        for end in range(len(last) + 1, len(data) + 1):
            for n in self._lengths[data[end - 1]]:
                start = end - n
                if start < 0:
                    continue
                t = ranks.get(data[start:end])
                if t is not None and (start == 0 or self.follows(last[start - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return last

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """The ids of the prefix of ``end`` bytes, from its entries."""
        out, end = [], len(last) if end is None else end
        while end:
            t = last[end - 1]
            out.append(t)
            end -= len(self.token[t])
        return out[::-1]

    def word(self, w: str) -> list[int]:
        ids = self._words.get(w)
        if ids is None:
            data = w.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None and len(data) <= 2 else self.read(self.extend(data, []))
            if len(data) <= KEEP_BYTES:
                if len(self._words) >= WORD_TABLE:
                    self._words.clear()
                self._words[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self._words, []
        for w in self._split(text):
            out += known.get(w) or self.word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token[i] for i in ids).decode("utf-8", "replace")


class EncodedText:
    """A text with its words' prefix entries: appends and edits re-encode only nearby."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.spans: list[tuple[int, int]] = []
        self._lasts: list[list[int]] = []
        self._resplit(0, 0, len(self.spans))

    def _entries(self, w: str) -> list[int]:
        return self.encoder.extend(w.encode("utf-8", "replace"), [])

    def _resplit(self, keep: int, shift: int, resume: int, settled_from: int | None = None) -> None:
        """Split anew behind the first ``keep`` words, up to a boundary of the old split.

        Words beyond ``settled_from`` (a text position) whose start was already a start
        in the old split, moved by ``shift``, are taken over: splitting only looks ahead.
        """
        old = {s + shift: i for i, (s, _) in enumerate(self.spans[resume:], resume)}
        at = self.spans[keep - 1][1] if keep else 0
        spans, lasts = self.spans[:keep], self._lasts[:keep]
        for m in regex.compile(PATTERN).finditer(self.text, at):
            if settled_from is not None and m.start() >= settled_from and m.start() in old:
                i = old[m.start()]
                spans += [(s + shift, e + shift) for s, e in self.spans[i:]]
                lasts += self._lasts[i:]
                break
            w = m.group()
            spans.append((m.start(), m.end()))
            before = self._lasts[len(spans) - 1] if len(spans) <= len(self._lasts) else None
            prior = self.spans[len(spans) - 1] if before is not None else None
            # A word that only grew keeps its entries: the array is extended.
            if before is not None and shift >= 0 and prior == (m.start(), prior[1]) and prior[1] <= m.end() and settled_from is None:
                data = w.encode("utf-8", "replace")
                lasts.append(self.encoder.extend(data, list(before[: len(data)])) if self._same_head(prior, data, before) else self._entries(w))
            else:
                lasts.append(self._entries(w))
        self.spans, self._lasts = spans, lasts

    def _same_head(self, prior: tuple[int, int], data: bytes, before: list[int]) -> bool:
        head = self.text[prior[0] : prior[1]].encode("utf-8", "replace")
        return len(head) == len(before) and data.startswith(head)

    def append(self, more: str) -> None:
        """Add text at the end; only the last words can be split differently."""
        self.text += more
        # A run of white space can pass its last character on to a new word: step back two words.
        self._resplit(max(0, len(self.spans) - 2), 0, len(self.spans))

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]; words far from the edit keep their entries."""
        self.text = self.text[:start] + new + self.text[end:]
        keep = 0
        while keep < len(self.spans) and self.spans[keep][1] < start:
            keep += 1
        self._resplit(max(0, keep - 2), len(new) - (end - start), keep, settled_from=start + len(new))

    @property
    def ids(self) -> list[int]:
        return [i for last in self._lasts for i in self.encoder.read(last)]


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder of a vocabulary file (built once a process)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder.from_file(path)
    return _ENCODERS[path]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str | None = None, out: str = "ids") -> DataFrame:
    """(key, ids): narrow, without a shuffle; each row is encoded where it is read."""
    path = vocabulary or f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"
    source = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            # Small steps keep the memory of one output batch small for very long texts.
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, out])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")
