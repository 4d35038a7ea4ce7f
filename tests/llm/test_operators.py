"""Each operator on small tables: brute force, and nulls, empty and long texts, ties, repeated rows, clashing columns."""

import bisect
import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from molquarry.llm import components as comps
from molquarry.llm import decontaminate, language_id, ngram_join, packing, quality_classifier, quality_rules, secrets, shards, substring_dedup, toxicity
from molquarry.llm.common import WordHashes, drop_written, fold
from molquarry.llm.queries import QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside.
CLASH = ["tree", "label", "spans", "base_spans", "seed", "start", "length", "_part", "score", "n_words", "slot"]
WORDS = [f"w{i}" for i in range(40)]


def table(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, l, "s", None if t is None else len(t)) for i, t, l in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (5, "One", "fr"), (6, long, "en"), (7, long, "en"), (7, long, "en"), (8, "12 34 $$ ##", "en"), (None, "no id here at all", "en"), (9, "a b c d e f g h i j k l m n o p q r s t u v", "en")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [], clash=True)


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, rng.randrange(2), rng.randrange(2)) for i in range(400)] + [(3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")


def sets_of(rows, n):
    out = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def brute_components(sets, num, den):
    at = {d: d for d in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def variants(n, edits, seed=3, base=6):
    rng = random.Random(seed)
    texts = [[rng.choice(WORDS) for _ in range(rng.randint(1, 45))] for _ in range(base)]
    out = []
    for i in range(n):
        w = list(rng.choice(texts))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("n", "num", "block"), [(3, 90, 768), (2, 60, 16), (5, 80, 16)])
def test_ngram_join_is_exact(spark, monkeypatch, n, num, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [*variants(220, 3), (900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "one")]
    sets = sets_of(rows, n)
    want = brute_components(sets, num, 100)
    got = ngram_join.join_ngrams(table(spark, [(i, t, "en") for i, t in rows]), n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(sets[d]), want[d]) for d in sets}


def test_ngram_join_odd_rows(spark, odd, empty):
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.join_ngrams(odd).collect())
    assert got[7, 6] == 2 and got[6, 6] == 1 and got[1, 1] == 1 and got[5, 4] == 1 and got[None, None] == 1
    assert ngram_join.join_ngrams(empty).count() == 0
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]


def test_signature_bound_never_loses_a_link():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        sets = [np.unique(np.concatenate((base[rng.random(len(base)) > 0.04], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)))) for _ in range(14)]
        sets = [s for s in sets if len(s)]
        group = ngram_join.ExactGroup(sets, np.arange(len(sets)), 90, 100)
        group.run()
        want = brute_components({i: set(s.tolist()) for i, s in enumerate(sets)}, 90, 100)
        parts = collections.defaultdict(set)
        for i in range(len(sets)):
            parts[group.label[i]].add(want[i])
        assert all(len(p) == 1 for p in parts.values()) and len(parts) == len(set(want.values()))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(500, 560)]
    at = {x: x for e in edges for x in e}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in comps.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


LETTERS = {"en": "th er on an re he in ed nd".split(), "de": "ch sch ein und keit lich ü ß ver".split(), "fr": "eau eux é è que ou ment".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_mixture(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, prose(rng, l := rng.choice(list(LETTERS)), 60), l) for i in range(300)]
    docs = table(spark, [*rows, (300, None, "en"), (301, "12 ##", "de"), (302, prose(rng, "en", 80) + " " + prose(rng, "de", 80), None)])
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert held and all(got[d].held_out for d in held)
    right = sum(got[d].lang_pred == l for d, _, l in rows)
    assert right >= 0.98 * len(rows)
    assert got[300].lang_pred == got[301].lang_pred == "und" and got[300].score == 0
    assert set(got[302].languages) == {"de", "en"} and abs(got[302].languages["de"] - 0.5) < 0.15
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(odd).collect()} <= {"en", "fr", "und"}
    assert language_id.identify(empty).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _, _ in rows} | {302}


def test_expectation_maximisation_raises_the_likelihood():
    rng = np.random.default_rng(1)
    like = rng.random((200, 4))
    last = -np.inf
    for rounds in (1, 2, 4, 8):
        pi, log = language_id.expectation_maximisation(like, rounds)
        assert abs(pi.sum() - 1) < 1e-9 and log >= last - 1e-9
        last = log


def test_chains_against_brute_force():
    rng = random.Random(4)
    k = substring_dedup.K
    for _ in range(60):
        m = [(rng.randrange(44), rng.randrange(44)) for _ in range(rng.randint(1, 12))]
        x, y = np.array([a for a, _ in m]), np.array([b for _, b in m])
        value = {}
        for i in sorted(range(len(m)), key=lambda i: m[i]):
            before = [value[j] - substring_dedup.GAP_COST * ((m[i][0] - m[j][0]) + (m[i][1] - m[j][1])) for j in value if m[j][0] < m[i][0] and m[j][1] < m[i][1]]
            value[i] = k + max([0, *before])
        best = substring_dedup.chains(x, y)[0]
        got = k * len(best) - substring_dedup.GAP_COST * sum((m[b][0] - m[a][0]) + (m[b][1] - m[a][1]) for a, b in zip(best, best[1:], strict=False))
        # the places lie within the greatest gap of each other, so the first chain is the best one, whole
        assert got == pytest.approx(max(value.values()))
        assert all(m[a][0] < m[b][0] and m[a][1] < m[b][1] for a, b in zip(best, best[1:], strict=False))


def test_shared_passages(spark, odd, empty):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(30):
        w = [word() for _ in range(80)]
        if i % 3 == 0:
            p = list(passage)
            p[20] = word()  # a replaced word, and one left out
            del p[40]
            w[30:30] = p
        rows.append((i, " ".join(w)))
    rows.append((40, rows[1][1]))  # a copy
    got = substring_dedup.shared_passages(table(spark, [(i, t, "en") for i, t in rows])).collect()
    hit = collections.defaultdict(dict)
    for r in got:
        hit[r.doc_id][r.source_doc_id] = r
    assert set(hit) == {*range(3, 30, 3), 40}
    for d in range(3, 30, 3):
        assert 0 in hit[d] and all(s < d and s % 3 == 0 for s in hit[d])
        for x in hit[d].values():
            assert 26 <= x.start <= 34 and 85 <= x.end <= 93 and x.n_matched >= 0.85 * (x.end - x.start)
    assert list(hit[40]) == [1] and (hit[40][1].start, hit[40][1].end) == (0, 80)
    assert {r.doc_id for r in substring_dedup.shared_passages(odd).collect()} == {7}
    assert substring_dedup.shared_passages(empty).count() == 0


def reference_kernel(s, t, n=toxicity.ORDER, d=toxicity.DECAY):
    from itertools import combinations

    return sum(d ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1) for i in combinations(range(len(s)), n) for j in combinations(range(len(t)), n) if all(s[a] == t[b] for a, b in zip(i, j, strict=True)))


def test_string_kernel_is_exact():
    for s, t in [("stupid", "sttupid"), ("abcdabcd", "badcab"), ("aaaaaa", "aaaa"), ("abc", "abcd")]:
        assert toxicity.kernel(toxicity.coded([s], 10), toxicity.coded([t], len(t))[0])[0] == pytest.approx(reference_kernel(s, t), rel=1e-5)
    c = toxicity.coded(["banana", "xyz", "nab"], 8)
    assert toxicity.common(c, toxicity.coded(["banan"], 5)[0]).tolist() == [5, 0, 2]


def test_toxicity(spark, odd, empty):
    rng = random.Random(3)
    insults = ["blorkhead", "snivelist", "grotmouth"]
    rows, truth = [], []
    for i in range(400):
        w = [prose(rng, "en", rng.randint(6, 14)) for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(5)] += " " + rng.choice(insults) + " " + prose(rng, "en", 2)
        rows.append((i, ". ".join(w) + ".", "en"))
        truth.append((i, int(bad)))
    probes = [(500, "the blo*rkh*ead is here and there.", "en"), (501, "you s n i v e l i s t of the on.", "en"), (502, "ander onthe reed.", "en"), (503, None, "en"), (504, "", "en")]
    got = {r.doc_id: r for r in toxicity.score(table(spark, rows + probes), spark.createDataFrame(truth, "doc_id long, toxic int")).collect()}
    held = [(d, y) for d, y in truth if got[d].held_out]
    assert len(held) > 40 and sum((got[d].score >= 0.5) == bool(y) for d, y in held) >= 0.97 * len(held)
    assert got[500].score > 0.5 and got[501].score > 0.5 and max(got[502].score, got[503].score, got[504].score) < 0.5
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(empty, none).count() == 0


def brute_statistics(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_rule_statistics(spark, odd, empty, labels):
    rng = random.Random(6)
    texts = [None, "", " \n", "ü ß x", "a|b\na|b\n\na|b \n"] + ["\n".join(" ".join(rng.choice(WORDS[:5]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    for t in texts:
        assert quality_rules.statistics(t, WordHashes())[:5] == brute_statistics(t), t
    got = quality_rules.judge(odd, labels).collect()
    assert len(got) == 11 and all(not r.kept for r in got if r.base_failed) and any(r.base_failed for r in got)
    assert quality_rules.judge(empty, labels).count() == 0


def test_isolation_forest_finds_what_stands_apart():
    rng = np.random.default_rng(0)
    x = rng.normal(0.5, 0.02, (600, 4))
    out = np.full((10, 4), 0.9)
    low, high = np.zeros(4), np.ones(4)
    trees = quality_rules.grow(x, low, high, rng)
    a, b = quality_rules.anomaly(x, trees, 256), quality_rules.anomaly(out, trees, 256)
    assert b.min() > np.quantile(a, 0.99)
    assert quality_rules.calibrated({(10, True): 1000, (30, False): 50, (31, True): 1}) == 30


def test_quality_classifier(spark, odd, empty):
    rng = random.Random(8)
    rows, truth = [], []
    for i in range(500):
        good = i % 5 != 0
        t = ". ".join(prose(rng, "en", 12).capitalize() for _ in range(4)) + "." if good else " | ".join(prose(rng, "en", 1).upper() + "!!" for _ in range(40))
        rows.append((i, t, "en"))
        if i % 2:
            truth.append((i, int(good)))
    got = {r.doc_id: r for r in quality_classifier.classify(table(spark, rows), spark.createDataFrame(truth, "doc_id long, quality int")).collect()}
    held = [d for d in got if got[d].held_out]
    assert held and sum((got[d].score >= 0.7) == (d % 5 != 0) for d in held) >= 0.97 * len(held)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.classify(odd, none).collect()} == {0.5}
    assert quality_classifier.classify(empty, none).count() == 0


def spread(places):
    out = collections.defaultdict(list)
    for r in places:
        out[r.sequence_id].append((r.offset, r.length))
    return out


def best_fit_decreasing(lengths, capacity):
    gaps, made = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        made += at == len(gaps) and gap == capacity
        bisect.insort(gaps, gap - n)
    return made


@pytest.mark.parametrize("draw", [lambda r: min(4096, max(1, round(r.lognormvariate(6.2, 1)))), lambda r: r.randint(1, 4096), lambda r: r.randint(1200, 1500), lambda r: r.choice([4096, 2049, 1366, 1000, 700, 3])])
def test_packing_rounds_are_near_best_fit_decreasing(draw):
    """The rounds over ranges as Spark runs them, with the parts of a round one after another."""
    rng = random.Random(2)
    lengths = [draw(rng) for _ in range(4000)]
    state, made, places = [(1, n, 0, k) for n, k in collections.Counter(lengths).items()], 0, []
    wide = -(-4097 // packing.RANGES)
    while any(x[0] == 1 for x in state):
        parts = collections.defaultdict(list)
        least = packing.lower_end(max(x[1] for x in state if x[0] == 1), 4096)
        wait = [x for x in state if x[0] == 1 and x[1] < least]
        for x in state:
            if x not in wait:
                parts[x[1] // wide].append(x)
        near = [y for k, x in parts.items() for y in packing.sweep(x, 4096, k * wide)]
        far = packing.sweep([x[:4] for x in near if x[0] < 2], 4096, None, made)
        places += [x for x in near + far if x[0] == 2]
        state = [x[:4] for x in far if x[0] < 2] + wait
        made = max([made, *(x[4] - (-x[3] // x[6]) for x in places)])
    filled, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for _, n, at, k, first, offset, per in places:
        ranks[n] += range(at, at + k)
        for i in range(k):
            filled[first + i // per].append((offset + i % per * n, n))
    assert all(sorted(ranks[n]) == list(range(k)) for n, k in collections.Counter(lengths).items())
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(filled) <= 1.01 * best_fit_decreasing(lengths, 4096)


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(9)
    docs = table(spark, [(i, prose(rng, rng.choice(list(LETTERS)), rng.randint(0, 90)) + rng.choice(["", " it's I'LL", " ΑΣ ½ 日本", " <|endoftext|>", " a\x1cb\r\n!! x?"]), "en") for i in range(120)])
    got = packing.pack(packing.pieces_of(docs, tokenizer_path(), 64), 64).collect()
    for r in docs.collect():
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((p for p in got if p.doc_id == r.doc_id), key=lambda p: p.piece)
        assert [(p.start, p.length, p.ids_crc32) for p in mine] == [(s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for s in range(0, len(ids), 64)]
    for parts in spread(got).values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(spread(got)) <= 1.01 * best_fit_decreasing([p.length for p in got], 64) + 1
    one = packing.pack(packing.pieces_of(odd, tokenizer_path())).collect()
    assert sum(r.doc_id == 1 and r.length == 1 for r in one) == 1 and sum(r.doc_id == 7 and r.piece == 0 for r in one) == 2
    assert packing.pack(packing.pieces_of(empty, tokenizer_path())).count() == 0


SECRET = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(t):
    t = t or ""
    s = [(m.start(), 0, m.end()) for m in SECRET.finditer(t) if len(m[2]) >= 8]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))


def test_secrets(spark, odd, empty):
    rng = random.Random(10)
    bits = ["password=", "token: ", "API_KEY = \"", "secret:", "abcdefgh1", "short", "AKIA" + "A1" * 8, "AKIA12", "0123456789abcdef" * 2, "ab" * 20, " ", "\n", "é", "🙂", "=", "token=secret: abcdefghijk", "passwdx"]
    texts = [None, "", "token=secret: abcdefghijk"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(200)]
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = secrets.scan(docs.drop("spans", "base_spans")).select("doc_id", secrets.named(F.col("base_spans")).alias("b"), secrets.named(F.col("spans")).alias("s"), "text").collect()
    for r in got:
        assert r.b == brute_secrets(r.text), r.text
        assert not r.b or set(r.b.split(",")) <= set(r.s.split(","))
    key = "ZXk3vQ9mX7pL2nB8sT4rW6yUa0"
    more = table(spark, [(1, f"see {key} here", "en"), (2, "a9a9a9a9a9a9a9a9a9a9a9a9", "en"), (3, "123e4567-e89b-12d3-a456-426614174000", "en"), (4, "a_long_name_of_some_function_v2", "en")])
    s = {r.doc_id: r.s for r in secrets.scan(more.drop("spans", "base_spans")).select("doc_id", secrets.named(F.col("spans")).alias("s")).collect()}
    assert s == {1: "entropy:4:30", 2: "", 3: "", 4: ""}
    masked = secrets.mask(more)
    assert masked.columns == more.columns and {r.doc_id: r.text for r in masked.collect()}[1] == "see [SECRET] here"
    assert secrets.scan(odd).count() == 11 and secrets.mask(empty).count() == 0


def test_entropy_by_counts_is_the_entropy(spark):
    def direct(s):
        return max(-sum(v / len(w) * math.log2(v / len(w)) for v in collections.Counter(w).values()) for w in (s[i : i + 20] for i in range(max(1, len(s) - 19))))

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh0123") for _ in range(n)) for n in (1, 5, 19, 20, 21, 60)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.best_entropy(F.col("t")).alias("h")).collect():
        assert r.h == pytest.approx(direct(r.t), abs=1e-9)


def test_feistel_is_a_bijection_and_depends_on_the_key():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(shards.feistel(np.arange(n), n, 7).tolist()) == list(range(n))
    assert (shards.feistel(np.arange(1000), 1000, 7) != shards.feistel(np.arange(1000), 1000, 8)).any()


def test_shards_round_trip(spark, tmp_path, odd, empty):
    from molquarry.llm.tokens import WordIds

    rng = random.Random(11)
    docs = table(spark, [(i, prose(rng, "en", rng.randint(0, 80)), "en") for i in range(60)] + [(60, None, "en"), (61, prose(rng, "en", 400), "en"), (62, "", "en"), (62, "", "en")])
    how = {"per_shard": 16, "sequence": 32}
    path = str(tmp_path / "a")
    n = shards.write_shards(docs, path, tokenizer_path(), buckets=4, **how)
    rows = sorted(shards.read_from(spark, path, **how).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(n)) and all((r.shard, r.row) == divmod(r.slot, 16) for r in rows)
    # the bytes at byte_offset of the one file of a shard are the record
    for r in rows:
        (file,) = (tmp_path / "a" / f"shard={r.shard}").glob("part-*")
        with file.open("rb") as f:
            f.seek(r.byte_offset)
            raw = f.read(shards.stride_of(32))
        assert struct.unpack_from(shards.HEADER, raw) == (r.doc_id, r.start, r.n_ids) and raw[-1:] == b"\n"
        assert raw[struct.calcsize(shards.HEADER) : -1] == r.ids + bytes(64 - len(r.ids))
    # in the order of the index the ids are those of all documents
    slot = shards.feistel(np.arange(n), n, 2024)
    stream = np.concatenate([np.frombuffer(rows[k].ids, "<u2") for k in slot.tolist()]).tolist()
    ends = [i + 1 for i, x in enumerate(stream) if x == 1]
    got = sorted(tuple(stream[a:b]) for a, b in zip([0, *ends], ends, strict=False))
    enc = WordIds(tokenizer_path())
    assert got == sorted((*np.frombuffer(enc.packed(r.text), "<u4").tolist(), 1) for r in docs.collect())
    assert sum(len(r.ids) < 64 for r in rows) <= 4  # only a bucket's last sequence is padded
    # any split of the input gives the same files
    again = str(tmp_path / "again")
    shards.write_shards(docs.repartition(7, "n_chars"), again, tokenizer_path(), buckets=4, **how)
    assert [tuple(r) for r in rows] == [tuple(r) for r in sorted(shards.read_from(spark, again, **how).collect(), key=lambda r: r.slot)]
    assert sorted(r.slot for r in shards.read_from(spark, path, 20, 40, **how).collect()) == list(range(20, 40))
    assert shards.write_shards(empty, str(tmp_path / "b"), tokenizer_path()) == 0
    assert shards.write_shards(odd, str(tmp_path / "c"), tokenizer_path()) > 11


def brute_items(items, docs, window):
    out = {}
    for d, t in docs:
        w, hit, found = decontaminate.words_of(t), set(), set()
        for i, text in items:
            s = decontaminate.words_of(text)
            k = min(window, len(s))
            for a in range(len(s) - k + 1) if s else []:
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == s[a : a + k]:
                        hit |= set(range(b, b + k))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("shard", [500_000, 12])
def test_decontamination(spark, monkeypatch, odd, empty, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    rng = random.Random(12)
    v = ["a", "b", "c", "D", "e1", "ü"]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 9)))) for i in range(7)] + [(7, None)]
    items.append((8, items[0][1]))
    docs = [(i, " ".join(rng.choice([*v, "z"]) for _ in range(rng.randint(0, 70)))) for i in range(60)] + [(60, None), (61, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.match_items(table(spark, [(i, t, "en") for i, t in docs]), bench, window=4).collect()
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), list(r.items)) for r in got} == brute_items(items, docs, 4)
    assert decontaminate.match_items(odd, bench).count() == 11 and decontaminate.match_items(empty, bench).count() == 0
    assert all(not r.spans for r in decontaminate.match_items(odd, bench.limit(0)).collect())


def test_removal_cuts_only_what_is_hit(spark):
    item = "the quick brown fox jumps over the lazy dog again today"
    docs = table(spark, [(1, f"Before this, {item.upper()}! and after that comes more text of this kind, on and on", "en"), (2, "nothing here", "en"), (3, item, "en"), (4, None, "en")])
    out = decontaminate.remove_items(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and set(got) == {1, 2, 4}
    assert got[1].text == "Before this, ! and after that comes more text of this kind, on and on" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "nothing here"


def test_fold_is_the_crc(spark):
    got = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_registered():
    assert len(QUERIES) == 13 and {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_queries_give_the_asked_columns(spark, sf_dir):
    first = {
        "op1": ["doc_id", "n_shingles", "component_id"],
        "op2": ["doc_id", "held_out", "lang_pred", "score"],
        "op4": ["doc_id", "held_out", "score", "predicted"],
        "op5": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op6": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op7": ["doc_id", "held_out", "score", "predicted"],
        "op8": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op10": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    }
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, run in QUERIES.items():
        if columns := first.get(name.split("_")[0]):
            out = run(spark, sf_dir)
            assert out.columns[: len(columns)] == columns, name
            assert out.count() == n or name.startswith("op6")
    empty_hash = hashlib.sha256(b"").hexdigest()
    assert QUERIES["op8_secret_scans"](spark, sf_dir).filter(F.col("base_sha256") == empty_hash).count() > 0


def test_written_tables_can_be_dropped(spark):
    drop_written(spark)
    assert pa.__version__


def test_long_runs_and_many_spans(spark):
    """A run of a million characters, and thousands of secrets in one text: linear in both."""
    rng = random.Random(5)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000))
    many = " ".join(f"token=abcdefgh{i:07d}" for i in range(5_000))
    docs = table(spark, [(1, run, "en"), (2, many, "en")], clash=False)
    got = {r.doc_id: r.s for r in secrets.scan(docs).select("doc_id", secrets.named(F.col("spans")).alias("s")).collect()}
    assert got[1] == "entropy:0:1000000" and got[2] == ",".join(f"assign:{22 * i}:{22 * i + 21}" for i in range(5_000))
    assert secrets.mask(docs.filter("doc_id = 2")).first().text == " ".join(["[SECRET]"] * 5_000)


def test_overlapping_spans_are_masked_once(spark):
    texts = ["token=" + "0123456789abcdef" * 3 + " x", "AKIA" + "A1" * 9 + "password=abcdefgh9 secret:" + "ab12" * 9, "no secret"]
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)], clash=False)
    spans = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in secrets.scan(docs).collect()}
    assert any(b > c for s in spans.values() for (_, b), (c, _) in zip(s, s[1:], strict=False))
    for r in secrets.mask(docs).collect():
        want, at = "", 0
        for a, b in spans[r.doc_id]:
            want += texts[r.doc_id][at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        assert r.text == want + texts[r.doc_id][at:] and r.n_chars == len(r.text)


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        pos = rng.normal(1.5, 1, (2000, 5))
        unl = np.concatenate((rng.normal(1.5, 1, (int(3000 * share), 5)), rng.normal(-1.5, 1, (int(3000 * (1 - share)), 5))))
        assert abs(quality_classifier.class_prior(pos, unl) - share) < 0.08


def test_path_lengths_by_walking_the_trees():
    rng = np.random.default_rng(4)
    x = rng.random((60, 3))
    trees = quality_rules.grow(x, np.zeros(3), np.ones(3), rng, trees=8, sub=32)
    for row, got in zip(x, quality_rules.anomaly(x, trees, 32), strict=True):
        paths = []
        for feature, value, left, path in trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] + int(row[feature[at]] >= value[at])
            paths.append(path[at])
        assert got == pytest.approx(2 ** (-np.mean(paths) / quality_rules.usual_path(32)))


def test_mixture_against_all_sets():
    """The chosen set has the greatest penalised likelihood of all prefixes by proportion, each fitted by brute force."""
    rng = np.random.default_rng(6)
    for _ in range(5):
        like = np.maximum(rng.random((80, 3)) ** 4, 1e-6)
        like[:50, 0] += 1
        order = np.argsort(-language_id.expectation_maximisation(like)[0], kind="stable")
        values = []
        for k in (1, 2, 3):
            part = like[:, order[:k]]
            grid = [np.array(p) / 40 for p in np.ndindex(*[41] * k) if sum(p) == 40]
            values.append(max(np.log(np.maximum(part @ g, 1e-300)).sum() for g in grid) - language_id.PENALTY * k * np.log(81))
        assert len(language_id.mixture(like)) == 1 + int(np.argmax(values)) or max(values) - values[len(language_id.mixture(like)) - 1] < 0.5
