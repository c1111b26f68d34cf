"""Held-out passages inside a corpus: one FM-index per shard (problem 8).

The words of a shard's documents form one sequence of numbers, a separator after each document. Its
suffix array gives the Burrows-Wheeler transform, a wavelet matrix over the transform answers rank
queries, and every phrase of the held-out items (twelve consecutive words) is searched backwards,
all phrases of all items at once. The rows found are walked along the last-to-first mapping to the
next sampled suffix, which gives the place of each occurrence; places of one document and item that
overlap or touch merge into one span.

Shards are the documents' own partitions, so nothing is shuffled before the index; what leaves a
shard is one row per merged span. The items are a reference table whose size is checked before it
is sent out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.runtime import bounded_rows

WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿͏؜᠎]")
BROKEN = re.compile(r"(?<=[^\W_])[-‐‑­][^\S\n]*\r?\n[^\S\n]*(?=[^\W_])")
PHRASE = 12
FOUND = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, item_word bigint"


def words_of(text: str | None) -> list[str]:
    """Words as runs of letters and digits, in one case, composition and spelling.

    A hyphen and line break inside a word are dropped, as are invisible characters.
    """
    if not text:
        return []
    if not text.isascii():
        text = INVISIBLE.sub("", BROKEN.sub("", text))
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).casefold())
        if not text.isascii():
            return WORD.findall(BROKEN.sub("", text))
    return WORD.findall(BROKEN.sub("", text).lower())


def word_places(text: str) -> list[tuple[str, int, int]]:
    """The words of :func:`words_of` with the characters of the text as written that each comes from."""
    import regex

    kept = [True] * len(text)
    for m in BROKEN.finditer(text):
        kept[m.start():m.end()] = [False] * (m.end() - m.start())
    places = [i for i in range(len(text)) if kept[i] and not INVISIBLE.match(text[i])]
    plain = "".join(text[i] for i in places)
    if plain.isascii():
        spelled, first, last = plain.lower(), places, [p + 1 for p in places]
    else:
        shown: list[str] = []
        first, last = [], []
        fold = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFKC", t).casefold())
        for chunk in re.finditer(r"\s+|\S+", plain):
            whole = fold(chunk.group())
            clusters = [(fold(c.group()), chunk.start() + c.start(), chunk.start() + c.end()) for c in regex.finditer(r"\X", chunk.group())]
            if "".join(c[0] for c in clusters) != whole:
                clusters = [(whole, chunk.start(), chunk.end())]
            for piece, a, b in clusters:
                shown.append(piece)
                first += [places[a]] * len(piece)
                last += [places[b - 1] + 1] * len(piece)
        spelled = "".join(shown)
        again = [True] * len(spelled)
        for m in BROKEN.finditer(spelled):
            again[m.start():m.end()] = [False] * (m.end() - m.start())
        first, last = ([x for x, keep in zip(xs, again) if keep] for xs in (first, last))
        spelled = "".join(c for c, keep in zip(spelled, again) if keep)
    return [(m.group(), first[m.start()], last[m.end() - 1]) for m in WORD.finditer(spelled)]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of an integer sequence in order, by prefix doubling that re-sorts only what is still tied."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = heads
    step = 1
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        rows = order[at]
        after = np.where(rows + step < n, rank[np.minimum(rows + step, n - 1)] + 1, 0)
        key = rank[rows] * np.int64(n + 1) + after
        sort = np.argsort(key, kind="stable")
        order[at] = rows[sort]
        key = key[sort]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        fresh[at] = new | fresh[at]
        heads = np.maximum.accumulate(np.where(new, at, 0))
        rank[rows[sort]] = heads
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with running counts for each bit of the symbols."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        current = s
        for level in range(bits - 1, -1, -1):
            bit = (current >> level) & 1
            count = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(s) - int(count[-1]))
            keep = bit == 0
            current = np.concatenate([current[keep], current[~keep]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        a, b = np.zeros_like(upto), upto
        for level, count, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            one = ((symbol >> level) & 1).astype(bool)
            ca, cb = count[a], count[b]
            a, b = np.where(one, zeros + ca, a - ca), np.where(one, zeros + cb, b - cb)
        return b - a

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out = np.zeros_like(at)
        for level, count, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            before = count[at]
            bit = count[at + 1] - before
            out |= bit.astype(out.dtype) << level
            at = np.where(bit == 1, zeros + before, at - before)
        return out


class FMIndex:
    """Full-text index over a sequence of word numbers that ends in its only 0."""

    def __init__(self, s: np.ndarray, sample: int = 16):
        order = suffix_array(s)
        n = len(s)
        self.n, self.sample = n, sample
        bwt = s[order - 1]
        top = int(s.max()) + 1
        self.before = np.zeros(top + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=top), out=self.before[1:])
        self.wavelet = WaveletMatrix(bwt, max(1, int(top - 1).bit_length()))
        marked = order % sample == 0
        self.marked = np.zeros(n + 1, np.int64)
        np.cumsum(marked, out=self.marked[1:])
        self.places = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of each phrase (a row of equally many word numbers), by backward search; empty for unknown words."""
        known = (phrases < len(self.before) - 1).all(axis=1)
        low, high = np.zeros(len(phrases), np.int64), np.where(known, self.n, 0)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = phrases[live, k]
            low[live], high[live] = (self.before[symbol] + self.wavelet.rank(symbol, x[live]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes at ``rows``, from sampled suffixes along the last-to-first mapping."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            at = rows[open_rows]
            marked = self.marked[at + 1] > self.marked[at]
            done = open_rows[marked]
            out[done] = self.places[self.marked[rows[done]]] + steps
            open_rows = open_rows[~marked]
            at = rows[open_rows]
            symbol = self.wavelet.access(at)
            rows[open_rows] = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out


class ItemPhrases:
    """Every phrase of ``size`` consecutive words of the held-out items, over one vocabulary."""

    def __init__(self, items: list[tuple[int, str]], size: int = PHRASE):
        self.size = size
        self.numbers: dict[str, int] = {}
        rows, owners, offsets = [], [], []
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words_of(text)]
            for k in range(len(ids) - size + 1):
                rows.append(ids[k:k + size])
                owners.append(item)
                offsets.append(k)
        self.rows = np.array(rows, np.int64).reshape(-1, size)
        self.owners, self.offsets = np.array(owners, np.int64), np.array(offsets, np.int64)


def search_shard(ids: np.ndarray, texts: list[str | None], phrases: ItemPhrases) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, item_id, first word, words, item's first word) of every merged occurrence in one shard.

    Words that no item has share one number: no phrase contains it, so it only separates.
    """
    numbers, parts, starts, at = phrases.numbers, [], [], 0
    lookup = numbers.get
    for text in texts:
        words = words_of(text)
        starts.append(at)
        parts.append(np.fromiter((lookup(w, 1) for w in words), np.int64, len(words)))
        parts.append(np.ones(1, np.int64))
        at += len(words) + 1
    parts.append(np.zeros(1, np.int64))
    sequence = np.concatenate(parts)
    if not len(phrases.rows) or len(sequence) <= phrases.size:
        return []
    index = FMIndex(sequence)
    low, high = index.search(phrases.rows)
    counts = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(counts)), counts)
    if not len(which):
        return []
    row = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
    place = index.locate(row)
    document = np.searchsorted(np.array(starts), place, side="right") - 1
    item, shift = phrases.owners[which], place - phrases.offsets[which]
    sort = np.lexsort((place, shift, item, document))
    out: list[list[int]] = []
    last = None
    for k in sort:
        d, i, p, s = int(document[k]), int(item[k]), int(place[k]), int(shift[k])
        if last == (d, i, s) and p <= out[-1][2] + out[-1][3] + starts[d]:
            out[-1][3] = max(out[-1][3], p - starts[d] + phrases.size - out[-1][2])
        else:
            out.append([int(ids[d]), i, p - starts[d], phrases.size, int(phrases.offsets[which[k]])])
            last = (d, i, s)
    return [tuple(x) for x in out]


def merged_passages(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(first character, end, item ids) of passages (item, first word, words), merged where they overlap or only blanks and marks part them."""
    places = word_places(text)
    out: list[list] = []
    for item, first, n in sorted(found, key=lambda f: (f[1], -f[2])):
        a, b = places[first][1], places[first + n - 1][2]
        if out and first <= out[-1][3]:
            out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], first + n)
            out[-1][2].add(item)
        else:
            out.append([a, b, {item}, first + n])
    return [(a, b, sorted(items)) for a, b, items, _ in out]


def _search(documents: DataFrame, items: DataFrame, size: int, shard_words: int, max_items: int, schema: str, rows_of) -> DataFrame:
    """``rows_of(ids, texts, found)`` of every shard, ``found`` being the rows of :func:`search_shard` with the place in the shard for the id."""
    rows = bounded_rows(items.where("item_id is not null and item_text is not null").select("item_id", "item_text"), max_items, "held-out items")
    listed = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["item_text"]) for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = ItemPhrases(listed.value, size)
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not text:
                    continue
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= shard_words * 6:
                    yield rows_of(ids, texts, search_shard(np.arange(len(ids)), texts, phrases))
                    ids, texts, held = [], [], 0
        if ids:
            yield rows_of(ids, texts, search_shard(np.arange(len(ids)), texts, phrases))

    return documents.select("doc_id", "text").mapInArrow(search, schema)


def _word_rows(ids: list, texts: list, found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*((ids[k], *rest) for k, *rest in found))) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "first_word", "n_words", "item_word"])


def _character_rows(ids: list, texts: list, found: list[tuple]) -> pa.RecordBatch:
    by_text: dict[int, list] = {}
    for k, item, first, n, _ in found:
        by_text.setdefault(k, []).append((item, first, n))
    columns = list(zip(*((ids[k], *passage) for k, hits in by_text.items() for passage in merged_passages(texts[k], hits)))) or [[]] * 4
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "char_start", "char_end", "item_ids"])


def leaked_spans(documents: DataFrame, items: DataFrame, size: int = PHRASE, shard_words: int = 2_000_000, max_items: int = 100_000) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, item_word) of every passage of an item in a document.

    Null and blank texts hold nothing; items shorter than ``size`` words have no phrase and are
    never found; a document of any length lies whole in one shard, so no passage is cut. Shards end
    with the document that fills them to ``shard_words``, which bounds a task's memory.
    """
    return _search(documents, items, size, shard_words, max_items, FOUND, _word_rows)


def removal_spans(documents: DataFrame, items: DataFrame, size: int = PHRASE, shard_words: int = 2_000_000, max_items: int = 100_000) -> DataFrame:
    """(doc_id, char_start, char_end, item_ids): the passages of all items in each document, merged, in characters of the text as written.

    Passages that overlap or follow each other without a word in between are one span. Only texts
    with a passage are read a second time for their characters.
    """
    return _search(documents, items, size, shard_words, max_items, "doc_id bigint, char_start bigint, char_end bigint, item_ids array<bigint>", _character_rows)


def without_passages(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its spans, nothing else changed."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def leaked_documents(documents: DataFrame, items: DataFrame, size: int = PHRASE) -> DataFrame:
    """(doc_id, item_id), once for each item a document contains at least ``size`` consecutive words of."""
    return leaked_spans(documents, items, size).select("doc_id", "item_id").distinct()
