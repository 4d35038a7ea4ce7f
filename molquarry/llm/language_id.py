"""Language ID as mixture inference.

A language is a table of character trigram log-likelihoods (hashed to CELLS cells), learnt from a bounded sample of
labelled documents. A document is a bag of words, each with a likelihood under every language (the product over its
trigrams, edges included). Expectation-maximisation finds the proportions of the languages; sets of languages are grown
from the largest proportion on, and the set with the greatest penalised likelihood (PENALTY * log(words) for each
language more) is selected. The prediction is the set's largest language, the score its proportion times the share of
the evidence that speaks for it.

Defined cases: null text, empty text and text without a letter: `und`, score 0, no mixture. Words are runs of letters,
lower-cased. Ties go to the language that sorts first. Repeated rows are predicted alike. A table without any labelled
text gives `und` throughout. The language, source and id columns are never part of a prediction.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw, fold, kept, mapped, one_each, slices

CELLS = 1 << 16
#: Learning sample: documents a language at most, and the longest text that it takes in (longer ones are only predicted).
SAMPLE, SAMPLE_CHARS = 1_500, 30_000
#: Documents and characters of the learning sample in all, shared evenly by the languages.
SAMPLE_ALL, SAMPLE_ALL_CHARS = 30_000, 60_000_000
#: A column with more values than this is no column of languages.
MOST_LANGUAGES = 500
ROUNDS = 12
PENALTY = 3.0
KEPT_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+")


def trigram_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each character's trigram, first place of each word)."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    cells = (h >> np.uint64(48)).astype(np.int64)
    # the space between two words has a trigram of its own, which belongs to neither
    inside = np.ones(len(cells), bool)
    inside[starts[1:] - 1] = False
    return cells[inside], np.concatenate(([0], np.cumsum(sizes)))[:-1]


class Languages:
    def __init__(self, samples: Iterable[tuple[str, str]]):
        """samples: (language, text)."""
        by: dict[str, list[str]] = {}
        for lang, text in samples:
            by.setdefault(lang, []).extend(WORD.findall(text.lower()))
        self.names = sorted(k for k, w in by.items() if w)
        counts = np.full((len(self.names), CELLS), 0.05)
        for i, k in enumerate(self.names):
            counts[i] += np.bincount(trigram_cells(by[k])[0], minlength=CELLS)
        self.table = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32).T.copy()

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Words by languages, each row divided by its greatest."""
        cells, starts = trigram_cells(words)
        log = np.add.reduceat(self.table[cells], starts)
        return np.exp(log - log.max(1, keepdims=True))


def expectation_maximisation(like: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of one document."""
    pi = np.full(like.shape[1], 1.0 / like.shape[1])
    for _ in range(rounds):
        joint = like * pi
        total = joint.sum(1, keepdims=True)
        new = (joint / np.maximum(total, 1e-300)).mean(0)
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, float(np.log(np.maximum(like @ pi, 1e-300)).sum())


def mixture(like: np.ndarray, penalty: float = PENALTY) -> list[tuple[int, float]]:
    """(language, proportion) of the selected set, largest first."""
    like = np.maximum(like, 1e-6)  # a single odd word is never worth a language
    pi, _ = expectation_maximisation(like)
    order = np.argsort(-pi, kind="stable")
    best, chosen = -np.inf, []
    for k in range(1, like.shape[1] + 1):
        at = order[:k]
        part, log = expectation_maximisation(like[:, at]) if k > 1 else (np.ones(1), float(np.log(like[:, at[0]]).sum()))
        value = log - penalty * k * np.log(len(like) + 1)
        if value <= best:
            break
        best, chosen = value, [(int(a), float(p)) for a, p in zip(at, part, strict=True)]
    return sorted(chosen, key=lambda x: (-x[1], x[0]))


def learnt(docs: DataFrame, doc_id: str, text: str, lang: str, parts: int, held: int, most_languages: int = MOST_LANGUAGES) -> Languages:
    """From a bounded sample of the rows with a label outside the held-out fold; whole texts of up to SAMPLE_CHARS.

    Of rows with one doc_id and language one text is learnt. More than most_languages labels raise a ValueError.
    """
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (fold(doc_id, parts) != held) & (F.length(text) <= SAMPLE_CHARS))
    known = known.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.length(text).alias("size"))
    most = known.select("lang").distinct().limit(most_languages + 1).count()
    if most > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    drawn = draw(known, "id", min(SAMPLE, SAMPLE_ALL // max(1, most)), "lang", SAMPLE_ALL_CHARS // max(1, most), "size")
    return Languages(sorted((r["lang"], r["text"]) for r in one_each(drawn, ["id", "lang"], "text").collect()))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 3, held: int = 1, model: Languages | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages (a map from language to proportion), one row a document."""
    model = model or learnt(docs, doc_id, text, lang, parts, held)
    key = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = mapped(narrow, _predictor(model), f"doc_id {key}, lang_pred string, score double, languages map<string,double>")
    return out.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def predict(model: Languages, texts: list[str | None], seen: dict[str, int], rows: list[np.ndarray]) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """(language, score, mixture) for each text; seen and rows keep the likelihoods of words."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    new = list(dict.fromkeys(w for ws in found for w in ws if w not in seen))
    table = rows[0] if rows else np.zeros((0, len(model.names)))
    if new and model.names:
        extra = model.likelihoods(new)
        table = np.concatenate((table, extra)) if len(table) else extra
        seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
    out = []
    for t, ws in zip(texts, found, strict=True):
        if not ws or not model.names or not any(map(str.isalpha, t)):
            out.append(("und", 0.0, []))
            continue
        like = table[np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))]
        chosen = mixture(like)
        lead, share = chosen[0]
        sure = float((like[:, lead] / like.sum(1)).mean())
        out.append((model.names[lead], min(1.0, share * (0.5 + 0.5 * sure)), [(model.names[i], p) for i, p in chosen]))
    rows[:] = [table]
    if len(seen) > KEPT_WORDS:
        seen.clear()
        rows.clear()
    return out


def _predictor(model: Languages):
    name = uuid.uuid4().hex

    def run(batches):
        seen, rows = kept(name, lambda: ({}, []))
        kind = pa.map_(pa.string(), pa.float64())
        for b in slices(batches, most=2 << 20):
            got = predict(model, b.column(1).to_pylist(), seen, rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], kind)], ["doc_id", "lang_pred", "score", "languages"])

    return run


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Languages | None = None) -> DataFrame:
    """docs without those that have no language: null texts and texts without a letter. All columns stay."""
    model = model or learnt(docs, doc_id, text, lang, 3, 1)
    name = uuid.uuid4().hex

    def run(batches):
        seen, rows = kept(name, lambda: ({}, []))
        for b in slices(batches, text, 2 << 20):
            got = predict(model, b.column(b.schema.get_field_index(text)).to_pylist(), seen, rows)
            yield b.filter(pa.array([g[0] != "und" for g in got]))

    return mapped(docs, run, docs.schema)
