"""Whitening, source divergence and license scans against brute force, and their defined cases."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.llm import divergence, licenses, whitening
from molquarry.llm.queries import QUERIES


def rows_of(df):
    return collections.Counter(map(repr, df.collect()))


# licenses


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def scanned(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES):
    """Places, and labels with the best score: n-gram by n-gram."""
    words = re.findall(licenses.WORD, lowered(text))
    places, base, spans = [], set(), []
    for label, line in phrases:
        p = re.findall(licenses.WORD, lowered(line))
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    for t_id, (label, line) in enumerate(templates):
        p = re.findall(licenses.WORD, lowered(line))
        n = min(3, len(p))
        hits = [(i - t, t) for i in range(len(words) - n + 1) for t in range(len(p) - n + 1) if words[i : i + n] == p[t : t + n]]
        drift = max(len(p) // 8, 1)
        groups = collections.defaultdict(list)
        for d, t in hits:
            for key in ((0, d), (1, d // (2 * drift)), (2, (d + drift) // (2 * drift))):
                groups[key].append((d, t))
        for hit in groups.values():
            inside = {t + j for _, t in hit for j in range(n)}
            at = {d + t + j for d, t in hit for j in range(n)}
            a, b = min(at), max(at) + 1
            if len(inside) >= 0.7 * len(p) and len(at) >= 0.7 * (b - a):
                spans.append((len(inside) / len(p), len(inside), -t_id, -a, -b, label))
    spans = list(set(spans))
    good = [s for s in spans if not any(o[:5] > s[:5] and 2 * (min(-o[4], -s[4]) - max(-o[3], -s[3])) >= s[3] - s[4] for o in spans)]
    labels = base | {s[5] for s in good}
    return len(words), sorted(places), sorted(base), sorted(labels), 1.0 if base else max((s[0] for s in good), default=0.0)


def licensed(rng):
    out = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(rng.randint(0, 30))]
    for _ in range(rng.randint(0, 4)):
        line = rng.choice([*licenses.TEMPLATES, *licenses.PHRASES])[1].split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(line))
            line[at : at + rng.randint(0, 1)] = rng.choice([[], ["other"], ["two", "more"]])
            line = line or ["none"]
        out[(at := rng.randrange(len(out) + 1)) : at] = line
    return " ".join(out)


def test_diagonal_votes_against_brute_force(spark):
    rng = random.Random(5)
    texts = [licensed(rng) for _ in range(150)]
    texts += ["All rights reserved. ALL RIGHTS RESERVED", "cc by", "CC-BY cc\nby", "under the mit license " * 30, "released under the mit license " * 20, "general public", "Äll rights reserved", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["places"], r["base_labels"], r["labels"], r["score"]) for r in licenses.scan(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == scanned(text), text


def test_lesser_license_is_not_the_greater_one(spark):
    line = dict(licenses.TEMPLATES[::-1])["lgpl-notice"]
    df = spark.createDataFrame([(1, "x y " + line + " z")], "doc_id long, text string")
    assert licenses.scan(df).first()["labels"] == ["gpl", "lgpl-notice"]  # the phrase itself is there


def test_license_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "all rights reserved"), (1, "all rights reserved"), (1, "other"), (None, "cc by"), (None, None)], "doc_id long, text string")
    odd = df.withColumns({c: F.lit("mine") for c in ("key", "text_hash", "hash", "t", "gram", "size", "label", "start", "labels", "score", "_w", "n_words")})
    got = licenses.scan(odd)
    assert got.columns == ["doc_id", "text", "key", "text_hash", "hash", "t", "gram", "size", "label", "start", "_w", *licenses.RESULTS]
    assert rows_of(got.select("doc_id", "text", *licenses.RESULTS)) == rows_of(licenses.scan(df))
    assert sorted((r["doc_id"] or 0, r["n_words"], len(r["places"])) for r in got.collect()) == [(0, 0, 0), (0, 2, 1), (1, 1, 0), (1, 3, 1), (1, 3, 1)]
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, phrases=(), templates=()).agg(F.max("score")).first()[0] == 0.0


def test_long_license_text(spark):
    text = "word " * 300_000 + "released under the MIT license " + "w" * 1_000_000 + " all rights reserved"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["places"], r["labels"], r["spans"][0]["start"]) == ([300_006], ["mit", "reserved"], 300_000)


def test_license_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "Arrow" not in plan


# divergence


def audited(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), re.findall(divergence.TERM, lowered(text))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = collections.Counter(t for x, _, w in docs if x == lang for t in set(w))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = collections.defaultdict(collections.Counter)
        for x, s, w in docs:
            if x == lang:
                counts[s].update(t for t in w if seen[t] >= least)
        whole = sum(counts.values(), collections.Counter())
        v = len(kept)
        weights = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: weights(c) for s, c in counts.items()}, weights(whole)
        order = lambda items: sorted(items, key=lambda x: (-x[1], x[0].encode()))
        for s in counts:
            pairs = order([(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s])
            terms = order([(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]])[:top]
            out |= {(lang, s, "pair", i, x, k + 1) for k, (i, x) in enumerate(pairs)}
            out |= {(lang, s, "term", i, x, k + 1) for k, (i, x) in enumerate(terms)}
    return out


@pytest.mark.parametrize("top", [3, 200])
def test_audit_against_brute_force(spark, monkeypatch, top):
    monkeypatch.setattr(divergence, "WAITING", 7)
    monkeypatch.setattr(divergence, "COUNTED", 50)
    monkeypatch.setattr(divergence, "PART", 9)
    monkeypatch.setattr(divergence, "HELD", 60)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abABéÉ") for _ in range(rng.choice([1, 2, 2, 3])))
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None]), " ".join(word() for _ in range(rng.randint(0, 40)))) for _ in range(120)]
    rows += [("xx", "a", "one two"), ("xx", "b", None), ("xx", "c", "1 2 3"), ("yy", "alone", "t t t"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, n long").withColumns({c: F.lit("x") for c in ("term", "docs", "total", "terms", "item", "value", "rank")})
    got = [tuple(r) for r in divergence.audit(df, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, top=top)
    assert divergence.audit(df.limit(0)).count() == 0


def test_bands_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    n, m = rng.integers(1, 9, 400), rng.integers(1, 30, 400)
    terms = np.array([b"%03d" % i for i in rng.permutation(400)], dtype=object)
    for k, block in ((1, 512), (4, 512), (40, 512), (1, 20), (4, 45), (40, 70), (4, 5)):
        monkeypatch.setattr(divergence, "BLOCK", block)
        dominated = [sum(n[j] >= n[i] and m[j] <= m[i] and terms[j] < terms[i] for j in range(400)) for i in range(400)]
        assert sorted(divergence.band_of(n, m, terms, k)) == [i for i in range(400) if dominated[i] < k]


def test_lower_ranks_before():
    rng = np.random.default_rng(6)
    for size in (0, 1, 2, 3, 17, 64, 200):
        m, r = rng.integers(0, 9, size), rng.permutation(size * 3)[:size]
        assert divergence.smaller_before(m, r).tolist() == [sum(m[j] <= m[i] and r[j] < r[i] for j in range(size)) for i in range(size)]


def test_weights_do_not_overflow(spark):
    df = spark.createDataFrame([(90_000_000_000, 91_000_000_000, 5)], "n long, total long, terms long")
    got = df.select(divergence.weight(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * 90_000_000_001 // 91_000_000_005


# whitening


def table(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def whitened(vectors):
    """x of the usable rows, n, sums, eigenvalues (falling), components (columns) by a plain decomposition."""
    good = [v for v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v] for v in good])
    fit = np.unique(x, axis=0)
    y = fit - fit.mean(0)
    values, vectors_ = np.linalg.eigh(y.T @ y / len(fit))
    return x, len(fit), fit.sum(0), values[::-1], vectors_[:, ::-1]


def test_whitening_against_a_plain_decomposition(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(400, 20)) * np.linspace(2, 0.5, 20)) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    vectors = [*data.astype(np.float32).tolist(), *data[:50].astype(np.float32).tolist(), None, [], [float("nan")] * 20, [1.0] * 19 + [None], [float("inf")] + [0.0] * 19, [0.5] * 7]
    df = table(spark, vectors)
    out, model = whitening.whiten(df.withColumns({c: F.lit("x") for c in ("x", "n", "d", "i", "v", "_k", "whitened")}))
    rows = sorted(out.collect(), key=lambda r: r["vec_id"])
    x, n, sums, values, components = whitened(vectors[:-1])
    assert [r["vec_id"] for r in rows] == list(range(450)) and (model.n, model.sums) == (n, sums.tolist()) and model.identity_error < 1e-9
    assert [r["deviation"] for r in rows] == [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    got, want = np.array([r["whitened"] for r in rows]), ((x - sums / n) @ components / np.sqrt(values))[:, :16]
    got *= np.sign((got * want).sum(0))
    assert np.abs(got - want).max() < 1e-9
    assert np.abs(model.explained - values[:16] / values.sum()).max() < 1e-12
    long = whitening.long_form(out, model)
    assert long.count() == 450 * 16 and long.filter("component between 1 and 16 and n = 400").count() == 450 * 16


def test_near_and_equal_eigenvalues():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0].astype(np.longdouble)
    q = q @ (np.eye(30) * 1.5 - q.T @ q / 2)
    for values in ([9, 9 - 1e-9, 9 - 2e-9, 9 - 5e-9, *np.linspace(4, 1, 26)], [5.0] * 10 + [1.0] * 20, [1e6, 1e6 - 1e-5, *np.geomspace(1e3, 1e-6, 28)], [3.0] * 30):
        v = (q * np.array(values, np.longdouble)) @ q.T
        v = (v + v.T) / 2
        got, x = whitening.refined(v)
        scale = max(values)
        assert np.abs(x.T @ x - np.eye(30)).max() < 1e-14
        assert np.abs(v @ x.astype(np.longdouble) - x * got).max() < 4e-15 * scale
        assert np.abs(np.sort(got)[::-1] - np.array(sorted(values, reverse=True), float)).max() < 4e-15 * scale
    values = [9, 9 - 1e-6, *np.linspace(4, 1, 28)]
    v = (q * np.array(values, np.longdouble)) @ q.T
    x = whitening.refined((v + v.T) / 2)[1]
    # float64 alone leaves errors of 1e-16 * 9 / 1e-6 in the first two
    assert np.abs(np.abs((q.T @ x).astype(float)) - np.eye(30)).max() < 1e-12


def test_whitening_of_odd_tables(spark):
    df = table(spark, [[1.0, 2.0]])
    for rows in (df, df.limit(0), df.unionByName(df)):
        out, model = whitening.whiten(rows)
        assert model is None and out.count() == 0 and whitening.long_form(out, model).count() == 0
    # a flat direction has no component; huge entries neither fail nor lose the sums
    out, model = whitening.whiten(table(spark, [[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]]))
    assert len(model.eigenvalues) == 1 and out.count() == 3
    out, model = whitening.whiten(table(spark, [[1e30, 1.0], [-1e30, 2.0], [0.0, 3.0], [1e12, 7.0]]))
    assert out.count() == 4 and model.n == 4 and np.isfinite(model.eigenvalues).all() and out.filter("deviation is null").count() >= 2


def test_queries_of_the_audits(spark, sf_dir):
    columns = {
        "op11_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        "op12_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
        "op13_license_scans": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    }
    for name, want in columns.items():
        got = QUERIES[name](spark, sf_dir)
        assert got.columns == want and got.count() > 0, name
