"""Token ids of whole texts with a public tokenizer file, with the ids of known words kept between texts.

Text is cut at spaces and line feeds, where the tokenizer never carries anything over, and each part is encoded once.
A part of Latin letters, with punctuation after it or not, goes straight to the vocabulary's merges; all others go
through the whole tokenizer. tests/llm compares the ids with those of the tokenizer on whole texts.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept, released

#: Words whose ids are kept in a worker from text to text; later ones are encoded again in each batch.
KEPT = 150_000
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,!?;:#$%&*|]*)")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free letter from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordIds:
    """ids of texts as unsigned 32-bit numbers, for the lower-casing vocabulary with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.words: dict[str, bytes] = {"": b""}
        self.letters = byte_letters()
        released(keep=True)  # what reading the file took

    def _word(self, w: str) -> bytes:
        as_letters = w if w.isascii() else "".join(self.letters[b] for b in w.encode())
        ids = [t.id for t in self.model.tokenize(as_letters)]
        known = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.words) < KEPT:
            self.words[w] = known
        return known

    def _parts(self, parts: list[str]) -> list[bytes]:
        get, word, simple, out = self.words.get, self._word, SIMPLE.fullmatch, []
        for p in parts:
            m = simple(p)
            if m:
                w, rest = m.groups()
                w = w.lower()
                a = get(w)
                a = word(w) if a is None else a
                if rest:
                    b = get(rest)
                    a += word(rest) if b is None else b
            else:
                ids = self.full.encode(p, add_special_tokens=False).ids
                a = struct.pack(f"<{len(ids)}I", *ids)
            out.append(a)
        return out

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the place at which each text starts (and the end)."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        flat = lists.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        packed = self._parts(flat.dictionary.to_pylist())
        known = np.frombuffer(b"".join(packed), "<u4")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        n = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = known[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]

    def packed(self, text: str | None) -> bytes:
        return self.encoded(pa.array([text], pa.string()))[0].tobytes()


def word_ids(path: str) -> WordIds:
    """One encoder for each worker and file; Spark keeps its workers from task to task."""
    return kept(f"tokens {path}", lambda: WordIds(path))
