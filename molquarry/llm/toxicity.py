"""Toxicity: a support vector machine on the gap-weighted subsequence string kernel, with Nystroem landmarks.

The kernel counts common subsequences of ORDER letters, each weighted DECAY ** (span in both strings), normalised and
raised to POWER. It tolerates gaps and inserted characters (`st*u*pid`, `sstuppid`), and letters set apart by spaces are
put together first. A sentence is the sum of its words' feature vectors k(word, landmarks) K^(-1/2), so its score is a
sum of word scores; distinct words are scored once in a batch. A document's score comes
from its worst sentence and from what all its sentences have together.

Learning is on the driver, from a bounded sample of labelled documents (SAMPLE rows a class, whole texts of up to
SAMPLE_CHARS characters; longer ones are only scored). Labels mark documents, so sentences are labelled through them:
all sentences of clean documents are negative, and in turns the sentence of each toxic document that scores highest is
its positive one. Landmarks are all words that are significantly bound to toxic documents,
a few of each family; SAMPLE and LEAST_DOCS bound their number. A logistic fit on document scores follows.

Defined cases: null and empty texts score as a text without any word. Words are never cut: those of over LONG characters
are scored by overlapping windows, of which the greatest counts. Without labels of both classes in the learning folds
every score is 0. A doc_id with several labels takes the highest; of several texts of a doc_id one is learnt from. Repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw, fold, kept, mapped, one_each, slices

ORDER, DECAY, POWER = 4, 0.7, 3
FALLBACK, LEAST_DOCS, LEAST_Z, FAMILY, MEMBERS = 24, 5, 5.0, 4, 2  # FALLBACK: words taken where none is significant
SAMPLE, SAMPLE_CHARS = 1_500, 20_000
LONG = 32
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
CHUNK = 8192
AT_ONCE = 1 << 18  # pairs of letters that a kernel holds at a time
HARD = 300
#: What a sentence of ordinary words may reach.
FAINT = 0.3
KEPT_WORDS = 200_000


#: Stands before each word as a letter of its own, so that where a word begins counts.
START = "{"


def clean(word: str) -> str:
    w = word if word.isalpha() else EDGES.sub("", word)
    return START + w if w else ""


def coded(words: list[str], width: int) -> np.ndarray:
    """Letter codes, padded with -1; all other characters are gaps (-1 as well, but they take room)."""
    raw = "".join(w.ljust(width, "\0") for w in words)
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width).astype(np.int32)
    return np.where(codes < 97, -1, codes)


def _apart(n: int, decay: float) -> np.ndarray:
    """decay ** (letters between) for each place and those before it, else 0."""
    gap = np.arange(n)[:, None] - np.arange(n)[None, :] - 1
    return np.where(gap >= 0, decay ** np.maximum(gap, 0), 0).astype(np.float32)


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of s with t (one string, or a row for each row of s).

    A step from common subsequences of one order to the next is two matrix products, over the places before in s and in t.
    """
    width, m = s.shape[1], t.shape[-1]
    over_s, over_t, square = _apart(width, decay), _apart(m, decay).T, np.float32(decay * decay)
    out = np.zeros(len(s), np.float64)
    step = max(1, AT_ONCE // (width * m))
    for lo in range(0, len(s), step):
        rows = s[lo : lo + step].T[:, :, None]
        t2 = t if t.ndim == 1 else t[lo : lo + step]
        same = np.where((rows == t2) & (rows >= 0), square, np.float32(0))  # [place in s, row, place in t]
        now = same
        for _ in range(order - 1):
            before = (over_s @ now.reshape(width, -1)).reshape(-1, m) @ over_t
            now = same * before.reshape(same.shape)
        out[lo : lo + step] = now.sum((0, 2), dtype=np.float64)
    return out


def common(codes: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row with the landmark, by bit-parallel steps."""
    m = len(landmark)
    places = np.zeros(1 << 16, np.uint64)
    for j, c in enumerate(landmark.tolist()):
        places[c & 0xFFFF] |= np.uint64(1 << j)
    full = np.uint64((1 << m) - 1)
    v = np.full(len(codes), full)
    for a in range(codes.shape[1]):
        u = v & np.where(codes[:, a] >= 0, places[codes[:, a] & 0xFFFF], np.uint64(0))
        v = ((v + u) | (v - u)) & full
    return m - np.bitwise_count(v).astype(np.int64)


class Similarity:
    """Kernel of words with landmarks, normalised and raised to POWER."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = [coded([w], len(w))[0] for w in landmarks]
        self.own = np.array([kernel(c[None, :], c)[0] for c in self.codes])

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        pieces, owner = [], []
        for i, w in enumerate(words):
            if len(w) <= LONG:
                if len(w) >= ORDER:
                    pieces.append(w)
                    owner.append(i)
            else:
                for k in range(0, len(w) - LONG // 2, LONG // 2):
                    pieces.append(w[k : k + LONG])
                    owner.append(i)
        owner_ = np.array(owner, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        for lo in range(0, len(order), CHUNK):
            at = order[lo : lo + CHUNK]
            codes = coded([pieces[i] for i in at.tolist()], int(sizes[at].max()))
            own = np.full(len(at), np.nan)
            for j, t in enumerate(self.codes):
                rows = np.flatnonzero(common(codes, t) >= ORDER)  # all others have no subsequence of ORDER letters in common: 0
                if len(rows):
                    new = rows[np.isnan(own[rows])]
                    if len(new):
                        own[new] = kernel(codes[new], codes[new])
                    k = kernel(codes[rows], t) / np.sqrt(np.maximum(own[rows] * self.own[j], 1e-30))
                    np.maximum.at(out[:, j], owner_[at[rows]], (k**POWER).astype(np.float32))
        return out


class Scorer:
    """Word scores, sentence sums and the worst sentence; weights act on kernel values with the landmarks."""

    def __init__(self, similarity: Similarity):
        self.similarity = similarity
        k = similarity(similarity.landmarks).astype(float)
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T  # K^(-1/2)
        self.weights, self.bias, self.scale, self.shift = np.zeros(len(k)), 0.0, np.array([1.0, 0.0]), 0.0

    def word_scores(self, words: list[str], kept: dict[str, float] | None = None) -> np.ndarray:
        """kept: scores of this scorer from earlier batches."""
        v = (self.root @ self.weights).astype(np.float32)
        cleaned = [clean(w) for w in words]  # a word and the same with marks around it are one
        kept = {} if kept is None else kept
        new = [w for w in dict.fromkeys(cleaned) if w not in kept]
        fresh = dict(zip(new, (self.similarity(new) @ v).tolist(), strict=True))
        if len(kept) < KEPT_WORDS:
            kept.update(fresh)
            fresh = kept
        return np.array([fresh[w] if w in fresh else kept[w] for w in cleaned])

    def document(self, texts: pa.Array, kept: dict[str, float] | None = None) -> np.ndarray:
        """Two numbers for each text: the highest sentence score, and what all sentences have over FAINT together."""
        words, codes, first = split(texts)
        ends, single = marks(words)
        score = self.word_scores(words, kept).astype(float)[codes]
        apart = spaced(words, codes, single, first)
        if apart:
            extra = self.word_scores([w for w, _ in apart], kept)
            np.add.at(score, [i for _, i in apart], extra)
        cut = np.zeros(len(codes), bool)
        cut[first[:-1]] = True
        cut[1:] |= ends[codes[:-1]]
        starts = np.flatnonzero(cut)
        sums = np.add.reduceat(score, starts)
        at = np.searchsorted(starts, first[:-1])
        return np.stack((np.maximum.reduceat(sums, at), np.log1p(np.add.reduceat(np.maximum(sums - FAINT, 0), at))), 1)

    def probability(self, texts: pa.Array, kept: dict[str, float] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.document(texts, kept) @ self.scale + self.shift, -40, 40)))


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case parts, the part of each place, and the first place of each text (with the end)."""
    t = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern(pc.replace_substring(t, "\n", " . "), " ")
    flat = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets)
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


def marks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.array([w[-1:] in (".", "!", "?") and not (len(w) == 2 and w[0].isalpha()) for w in words], bool)
    single = np.array([len(w.strip(".,-*_!?")) == 1 and w.strip(".,-*_!?").isalpha() for w in words], bool)
    return ends, single


def spaced(words: list[str], codes: np.ndarray, single: np.ndarray, first: np.ndarray) -> list[tuple[str, int]]:
    """Runs of ORDER or more single letters inside a text, put together: (word, place)."""
    on = np.concatenate((single[codes], [False]))
    run = np.flatnonzero(np.diff(np.concatenate(([False], on)).view(np.int8)))
    out = []
    for a, b in zip(run[::2].tolist(), run[1::2].tolist(), strict=True):
        if b - a >= ORDER:
            inner = [a, *first[(first > a) & (first < b)].tolist(), b]
            for x, y in zip(inner, inner[1:], strict=False):
                if y - x >= ORDER:
                    out.append(("".join(words[c].strip(".,-*_!?") for c in codes[x:y].tolist()), x))
    return out


SENTENCE = re.compile(r"[^.!?\n]+")


def landmarks_of(toxic: list[str], fine: list[str]) -> list[str]:
    """Words by how much more of the toxic documents' sentences have them, as a z-score of the two shares.

    Equal sentences count once, so that copies of a document do not speak for its words.
    """

    def shares(texts):
        n: dict[str, int] = {}
        whole = {x.strip() for t in texts for x in SENTENCE.findall(t.lower())}
        for x in whole:
            for w in {clean(y) for y in x.split()}:
                if ORDER <= len(w) <= LONG:
                    n[w] = n.get(w, 0) + 1
        return n, max(1, len(whole))

    (a, n), (b, m) = shares(toxic), shares(fine)
    z = {}
    for w, k in a.items():
        p = (k + b.get(w, 0)) / (n + m)
        if k >= LEAST_DOCS:
            z[w] = (k / n - b.get(w, 0) / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
    best = sorted(z, key=lambda w: (-z[w], w))
    strong = [w for w in best if z[w] > LEAST_Z] or best[:FALLBACK]
    # words that begin alike are one landmark: their longest common beginning that FAMILY of them have
    begins: dict[str, int] = {}
    for w in strong:
        for k in range(ORDER + 2, len(w) + 1):
            begins[w[:k]] = begins.get(w[:k], 0) + 1
    stem = {w: max((w[:k] for k in range(ORDER + 2, len(w) + 1) if begins[w[:k]] >= FAMILY), key=len, default=w) for w in strong}
    shown: dict[str, int] = {}
    chosen: dict[str, None] = {}
    for w in strong:  # the beginning and MEMBERS words of each family
        shown[stem[w]] = shown.get(stem[w], 0) + 1
        if shown[stem[w]] <= MEMBERS:
            chosen |= {stem[w]: None, w: None}
    return list(chosen)


def fit(rows: list[tuple[str, bool]], seed: int = 5) -> Scorer | None:
    """rows: (text, toxic)."""
    toxic, fine = [t for t, y in rows if y], [t for t, y in rows if not y]
    marks_ = landmarks_of(toxic, fine) if toxic and fine else []
    if not marks_:
        return None
    scorer = Scorer(Similarity(marks_))

    def sentences(texts):
        words, codes, first = split(pa.array(texts, pa.string()))
        ends, _ = marks(words)
        cut = np.zeros(len(codes), bool)
        cut[first[:-1]] = True
        cut[1:] |= ends[codes[:-1]]
        starts = np.flatnonzero(cut)
        cleaned = {w: None for w in map(clean, words)}
        found = dict(zip(cleaned, range(len(cleaned)), strict=True))
        place = np.array([found[clean(w)] for w in words], np.int64)
        x = np.add.reduceat((scorer.similarity(list(cleaned)) @ scorer.root)[place[codes]], starts, axis=0)
        return x, np.searchsorted(first[:-1], starts, "right") - 1

    xp, bag = sentences(toxic)
    xn, _ = sentences(fine)
    power, hard = xp.sum(1), xn
    rng = np.random.default_rng(seed)
    for _ in range(4):
        top = np.array([np.flatnonzero(bag == d)[np.argmax(power[bag == d])] for d in range(len(toxic))])
        # a toxic document whose best sentence has no likeness to any landmark teaches nothing
        top = top[np.abs(xp[top]).sum(1) > 0.3]
        if not len(top):
            return None
        scorer.weights, scorer.bias = hinge(xp[top], xn, hard, rng)
        power = xp @ scorer.weights
        hard = xn[np.argsort(-(xn @ scorer.weights), kind="stable")[:HARD]]
    texts = pa.array([t for t, _ in rows], pa.string())
    y, z = np.array([t for _, t in rows], float), scorer.document(texts)
    a, w = np.column_stack((np.minimum(z, 8), np.ones(len(z)))), np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w = w + np.clip(np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(3), a.T @ (y - p) - 1e-2 * w), -1, 1)
    scorer.scale, scorer.shift = w[:2], float(w[2])
    return scorer


def hinge(pos: np.ndarray, neg: np.ndarray, hard: np.ndarray, rng: np.random.Generator, steps: int = 3000, reg: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear support vector machine by averaged stochastic subgradients, both classes of equal weight; half of the negatives are hard ones."""
    w, b, mean_w, mean_b = np.zeros(pos.shape[1]), 0.0, np.zeros(pos.shape[1]), 0.0
    for t in range(1, steps + 1):
        i = pos[rng.integers(0, len(pos), 32)]
        j = np.concatenate((neg[rng.integers(0, len(neg), 48)], hard[rng.integers(0, len(hard), 48)]))
        p, q = (i @ w + b) < 1, (j @ w + b) > -1
        rate = 1 / (reg * (t + 500))
        gw = reg * w - i[p].sum(0) / 32 + j[q].sum(0) / 96
        w, b = w - 0.1 * rate * gw, b - 0.01 * rate * (-p.sum() / 32 + q.sum() / 96)
        if t > steps // 2:
            mean_w, mean_b = mean_w + w, mean_b + b
    return mean_w / (steps - steps // 2), mean_b / (steps - steps // 2)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, one row a document; labels are learnt only outside the held-out fold."""
    known = labels.filter(F.col(label).isNotNull() & (fold(doc_id, parts) != held)).groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).alias("y"))
    ids = F.broadcast(draw(known, "id", SAMPLE, "y"))  # about 2 * SAMPLE ids
    texts = docs.filter(F.length(text) <= SAMPLE_CHARS).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = one_each(texts.join(ids, "id"), ["id", "y"], "text").collect()
    scorer = fit([(r["text"], bool(r["y"])) for r in sorted(rows, key=lambda r: r["id"])])
    key = docs.schema[doc_id].dataType.simpleString()

    name = uuid.uuid4().hex

    def run(batches):
        scores = kept(name, dict)
        for b in slices(batches, most=4 << 20):
            s = scorer.probability(b.column(1), scores) if scorer else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {key}, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score")
