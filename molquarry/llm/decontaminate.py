"""Benchmark decontamination: a generalised suffix automaton of the test items is fed with each document's words.

A word is a run of [0-9a-z] and non-ASCII characters after A-Z are lower-cased. The automaton holds every item,
one after another, each from the root. While a document's words stream through it, it gives the length of the longest
item substring that ends at each word. A position with a length of at least `window` ends an occurrence of a window of
an item; an item of fewer words is one window, found on the suffix links of the state.

Defined cases: null or empty text, or text without words: no words, no hits. Null items and items without words match
nothing. An item with a null id counts for hits but is not listed. Equal rows give equal results, one row each. An empty
benchmark marks nothing. Other columns are never read; the removal keeps them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

#: Every ASCII character but letters and digits becomes a space, A-Z become a-z; bytes from 0x80 stay.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A word in a text that is not lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Benchmarks of up to so many words make one automaton; larger ones are cut into several, each sent on its own.
SHARD_WORDS = 500_000
BITS = 22


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLDED).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over word numbers (from 1; 0 is a word that no item has)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = 10):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = []
        for item_id, text in items:
            seq = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if seq:
                seqs.append((item_id, seq))
                last = 0
                for w in seq:
                    last = self._extend(last, w)
        self.shortest = min([window, *(len(s) for _, s in seqs)])
        self._mark(seqs)
        self._pairs(seqs)

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the longest part of q that is reached from p by w."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _mark(self, seqs: list) -> None:
        """For each state: the items that have its strings of window words, and the short items that end there."""
        n, window = len(self.length), self.window
        self.at_window = [-1] * n  # the state on the suffix path that holds the string of exactly `window` words
        self.shorts: list[tuple[int, ...]] = [()] * n  # lengths of short items that are suffixes
        self.items_of: dict[int, set] = {}
        self.short_items: dict[tuple[int, int], set] = {}
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        for s in by_length:
            up = self.link[s]
            self.at_window[s] = s if self.length[s] >= window > self.length[up] else self.at_window[up]
        ends: dict[int, set[int]] = {}
        for item_id, seq in seqs:
            state = 0
            for i, w in enumerate(seq, 1):
                state = self.next[state][w]
                if i >= window:
                    self.items_of.setdefault(self.at_window[state], set()).add(item_id)
            if len(seq) < window:
                while self.length[self.link[state]] >= len(seq):
                    state = self.link[state]
                ends.setdefault(state, set()).add(len(seq))
                self.short_items.setdefault((state, len(seq)), set()).add(item_id)
        for s in by_length:
            self.shorts[s] = self.shorts[self.link[s]] + tuple((s, k) for k in sorted(ends.get(s, ())))

    def _pairs(self, seqs: list) -> None:
        """A bit for each pair of neighbouring item words: other pairs end every match of two words or more."""
        self.pair_bits = np.zeros(1 << BITS, bool)
        for _, seq in seqs:
            a = np.array(seq, np.uint64)
            self.pair_bits[self._slot(a[:-1], a[1:])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words (start, end) long enough for a window, in which each pair may be a pair of item words."""
        known = ids > 0
        if self.shortest == 1:
            on = known
        else:
            on = known[:-1] & known[1:]
            at = np.flatnonzero(on)
            on[at] = self.pair_bits[self._slot(ids[at].astype(np.uint64), ids[at + 1].astype(np.uint64))]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).view(np.int8)))
        start, end = edge[::2], edge[1::2] + (self.shortest > 1)
        keep = end - start >= self.shortest
        return list(zip(start[keep].tolist(), end[keep].tolist(), strict=True))

    def feed(self, ids: list[int], base: int) -> tuple[list[tuple[int, int]], set, int]:
        """Hit spans [start, end) of words, the items found, and the longest match, for one stretch at word `base`."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        state, length, longest = 0, 0, 0
        nxt, link, size, window = self.next, self.link, self.length, self.window
        for i, w in enumerate(ids, base + 1):
            while state and w not in nxt[state]:
                state = link[state]
                length = size[state]
            if w in nxt[state]:
                state = nxt[state][w]
                length += 1
            else:
                length = 0
            longest = max(longest, length)
            if length >= window:
                spans.append((i - length, i))
                s = self.at_window[state]
                items |= self.items_of.get(s, set()) if s >= 0 else set()
            for s, k in self.shorts[state]:
                if k <= length:
                    spans.append((i - k, i))
                    items |= self.short_items[s, k]
        return merged(spans), items, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(automaton: ItemAutomaton, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
    """(number of words, hit spans, items) for each text."""
    get = automaton.vocab.get
    ids, starts = [], []
    for t in texts:
        starts.append(len(ids) + 1)
        ids.append(0)
        ids.extend([get(w, 0) for w in words_of(t)])
    starts.append(len(ids) + 1)
    flat = np.array(ids, np.int64)
    found: dict[int, list] = {}
    first = np.array(starts)
    for a, b in automaton.runs(flat) if len(flat) > 1 else []:
        d = int(np.searchsorted(first, a, "right")) - 1
        spans, items, _ = automaton.feed(ids[a:b], a - starts[d])
        if spans:
            at = found.setdefault(d, [[], set()])
            at[0] += spans
            at[1] |= items
    return [(starts[d + 1] - starts[d] - 1, *(found.get(d) or ([], set()))) for d in range(len(texts))]


def _shards(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[ItemAutomaton]:
    """Items read one after another, at most SHARD_WORDS words held at a time; one automaton at least."""
    held, size, first = [], 0, True
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    for r in rows.toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(words_of(r["t"]))
        if size >= SHARD_WORDS:
            yield ItemAutomaton(held, window)
            held, size, first = [], 0, False
    if held or first:
        yield ItemAutomaton(held, window)


SPANS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def match_items(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, spans (merged hit spans in words), items (sorted ids of items found)."""
    key = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    # a benchmark of several automata goes through them one after another, in one pass over the documents
    sent = [docs.sparkSession.sparkContext.broadcast(automaton) for automaton in _shards(benchmark, item_id, item_text, window)]

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for one in sent:
                for d, (words, s, i) in enumerate(scan(one.value, texts)):
                    n[d] = words
                    spans[d] += s
                    items[d] |= i
            shown = [[{"start": x, "end": y} for x, y in merged(s)] for s in spans]
            named = [sorted(x for x in i if x is not None) for i in items]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(shown, kind), pa.array(named, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

    return mapped(narrow, run, f"doc_id {key}, {SPANS}")


def remove_items(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text", n_chars: str = "n_chars", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents with all their columns, hit spans cut out of the text (whole words and what stands between them).

    A document of which hits cover more than `max_coverage` of the words goes altogether. n_chars, where there is such a
    column, follows the new text. Untouched documents stay as they are.
    """
    # every automaton is a broadcast of its own, and reads the uncut text; what they find together is judged and cut once
    sent = [docs.sparkSession.sparkContext.broadcast(automaton) for automaton in _shards(benchmark, item_id, item_text, window)]

    def run(batches):
        for b in slices(batches, text):
            at, k = b.schema.get_field_index(text), b.schema.get_field_index(n_chars)
            texts = b.column(at).to_pylist()
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            for one in sent:
                for held, (_, found, _) in zip(spans, scan(one.value, texts), strict=True):
                    held += found
            spans = [merged(s) for s in spans]
            hit = any(spans)
            keep = [not s or sum(e - a for a, e in s) <= max_coverage * len(words_of(t)) for t, s in zip(texts, spans, strict=True)]
            if hit:
                new = [cut(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
                if k >= 0:
                    sizes = [len(t) if s else o for t, s, o in zip(new, spans, b.column(k).to_pylist(), strict=True)]
                    b = b.set_column(k, b.schema.field(k), pa.array(sizes, b.schema.field(k).type))
            yield b.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, e in spans:
        out.append(text[at : places[a][0]])
        at = places[e - 1][1]
    return "".join([*out, text[at:]])
