"""Held-out passages inside a corpus, whole or in part, with odd words altered.

Method: spaced-seed hashing. Fixed masks look at some of the words of a short window and
ignore the others, so an altered word leaves seeds around it. Seeds of the held-out
passages are hashed; the corpus is scanned once with the same masks; equal hashes are
joined; and each hit is verified by comparing the words around it.

Every seed of every passage is kept, however many items share it. A seed that many
documents or items have makes a large partition of the join, which adaptive execution
splits along its map outputs.

Before the join a seed of the corpus must be in a bit set of the held-out seeds. The set
has a fixed size (``FILTER_BITS``), whatever the size of either side, so shipping it is
bounded; only seeds that pass are shuffled.

A document carries an item when a window of ``span`` words around a hit agrees with the
passage in at least ``agree`` words. A passage shorter than
``span`` has to be there whole but for the same share of altered words.

Defined cases: null, empty and wordless texts carry nothing and wordless passages match
nothing; markup, entities, punctuation, case and line breaks are ignored; texts are read
whole; repeated ids give one row a pair; empty tables give empty results. Only the named
columns are read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Offsets of the words a mask looks at, within windows of at most SEED words.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 2, 5, 7))
SEED = 8
SPAN = 18
AGREE = 16
FILTER_BITS = 1 << 25
_TAG = re.compile(r"<(?:[/?]?[A-Za-z]|!)[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    t = html.unescape(_TAG.sub(" ", text)) if ("<" in text or "&" in text) else text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    return _WORD.findall(t.lower())


def _codes(ws: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit code a word, the same on every machine (FNV-1a), kept per batch."""
    out = np.empty(len(ws), dtype=np.uint64)
    for i, w in enumerate(ws):
        c = known.get(w)
        if c is None:
            c = 0xCBF29CE484222325
            for b in w.encode("utf-8", "replace"):
                c = ((c ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            known[w] = c
        out[i] = c
    return out


def _seeds(codes: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The hash of every window of the mask (one per start), as int64."""
    n = len(codes) - mask[-1]
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.full(n, number + 1, dtype=np.uint64)
    for k, at in enumerate(mask):
        x = codes[at : at + n] * _MULT[k]
        h = (h ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _window(codes: np.ndarray, at: int, span: int) -> bytes:
    """Words at-span .. at+SEED+span as 32-bit codes; places outside the text are 0."""
    lo, hi = at - span, at + SEED + span
    out = np.zeros(hi - lo, dtype=np.int32)
    a, b = max(lo, 0), min(hi, len(codes))
    if a < b:
        out[a - lo : b - lo] = (codes[a:b] >> np.uint64(33)).astype(np.int32)
    return out.tobytes()


def _scan(key: str, text: str, span: int, bits: np.ndarray | None):
    """Map function: rows (key, seed, at, window, size) of the seeds that pass the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for df in batches:
            if len(known) > 500_000:
                known.clear()
            texts = [_codes(words(t), known) for t in df[text]]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            flat = np.concatenate(texts) if texts else np.empty(0, dtype=np.uint64)
            of = np.repeat(np.arange(len(texts)), sizes)
            first = np.cumsum(sizes) - sizes
            found = []
            for number, mask in enumerate(MASKS):
                h = _seeds(flat, mask, number)
                if not len(h):
                    continue
                ok = of[: len(h)] == of[mask[-1] :]  # windows within one text
                if bits is not None:
                    b = h & (FILTER_BITS - 1)
                    ok &= (bits[b >> 5] >> (b & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
                at = np.nonzero(ok)[0]
                found.append((at, h[at]))
            at = np.concatenate([f[0] for f in found]) if found else np.empty(0, dtype=np.int64)
            seed = np.concatenate([f[1] for f in found]) if found else np.empty(0, dtype=np.int64)
            row, place = of[at], at - first[of[at]]
            yield pd.DataFrame({
                "k": df[key].to_numpy()[row], "seed": seed, "at": place.astype(np.int32),
                "window": [_window(texts[r], int(p), span) for r, p in zip(row, place)],
                "size": sizes[row].astype(np.int32),
            })

    return run


def _filter_bits(item_seeds: DataFrame) -> np.ndarray:
    """The bit set of the held-out seeds: at most FILTER_BITS/32 words reach the driver."""
    slot = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = (
        item_seeds.select((slot / 32).cast("int").alias("word"), F.pow(F.lit(2), slot % 32).cast("bigint").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    )
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out


def leaks(
    documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text",
    item_key: str = "item_id", item_text: str = "passage", span: int = SPAN, agree: int = AGREE,
) -> DataFrame:
    """(doc_key, item_key, words): each leaked item of a document, with the most agreeing words."""
    d = documents.select(F.col(doc_key).alias("k"), F.col(doc_text).alias("t")).where(F.col("t").isNotNull())
    i = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    dk, ik = d.schema["k"].dataType.simpleString(), i.schema["k"].dataType.simpleString()
    cols = "seed bigint, at int, window binary, size int"
    item_seeds = cut(i.mapInPandas(_scan("k", "t", span, None), f"k {ik}, {cols}").drop("at"))
    bits = _filter_bits(item_seeds.select("seed"))
    doc_seeds = d.mapInPandas(_scan("k", "t", span, bits), f"k {dk}, {cols}")
    # Neither side has a size bound, so the join is a shuffled one.
    hits = (
        doc_seeds.select(F.col("k").alias("doc"), "seed", F.col("window").alias("w"))
        .join(item_seeds.select(F.col("k").alias("item"), "seed", F.col("window").alias("v"), "size").hint("merge"), "seed")
        .select("doc", "item", "w", "v", "size")
    )
    width = 2 * span + SEED

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if not len(df):
                continue
            w = np.frombuffer(b"".join(df["w"]), dtype=np.int32).reshape(-1, width)
            v = np.frombuffer(b"".join(df["v"]), dtype=np.int32).reshape(-1, width)
            run = np.cumsum(np.pad((w == v) & (w != 0), ((0, 0), (1, 0))), axis=1, dtype=np.int32)
            n = (run[:, span:] - run[:, :-span]).max(axis=1)
            need = -(-np.minimum(span, df["size"].to_numpy()) * agree // span)
            yield pd.DataFrame({"doc": df["doc"], "item": df["item"], "n": n.astype(np.int32)})[n >= need]

    return (
        hits.mapInPandas(verify, f"doc {dk}, item {ik}, n int")
        .groupBy(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).agg(F.max("n").alias("words"))
    )
