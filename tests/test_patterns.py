"""Similarity joins, mixed radii, multiway distance joins and large patterns against brute force."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from molquarry.operators.core import PID, Scope
from molquarry.operators.similarity import Multisets, expanded

ATOM = "scope_id long, atom_id int, element string, name string, record_name string, res_name string, chain string, res_seq int, ins_code string, x double, y double, z double"


def atom(scope, i, element="C", res="ALA", chain="A", seq=0, at=(0, 0, 0)):
    return (scope, i, element, f"{element}{i}", "ATOM", res, chain, seq, "", *map(float, at))


def multisets(spark, rows):
    flat = [(k, item, n) for k, bag in rows.items() for item, n in bag.items()]
    return Multisets(spark.createDataFrame(flat, "k long, item string, n long"), ["k"])


def jaccard(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def bags(rng, n):
    out = {}
    for i in range(n):
        size = rng.choice([1, 2, 5, 20, 60])
        out[i] = collections.Counter(rng.choices("ABCDEFGH", weights=[30, 20, 10, 5, 3, 2, 1, 1], k=size))
        if i and rng.random() < 0.4:  # copies and near copies
            out[i] = collections.Counter(out[rng.randrange(i)])
            out[i][rng.choice("ABH")] += rng.choice([0, 0, 1, 2])
            out[i] = +out[i]
    return out


@pytest.mark.parametrize("least", [1.0, 0.8, 0.5, 0.2])
def test_similarity_join_is_exact(spark, least):
    rng = random.Random(3)
    a, b = bags(rng, 120), bags(rng, 90)
    left, right = multisets(spark, a), multisets(spark, b)
    got = {(r["k"], r["other_k"]): r["value"] for r in expanded(left.join(right, least), left, right).collect()}
    assert got == {(i, j): jaccard(a[i], b[j]) for i in a for j in b if jaccard(a[i], b[j]) >= least}


def test_all_pairs_and_most_similar(spark):
    rng = random.Random(4)
    a, b = bags(rng, 60), bags(rng, 80)
    a[999], b[999] = collections.Counter("Z"), collections.Counter("YX")
    left, right = multisets(spark, a), multisets(spark, b)
    want = {(i, j): jaccard(a[i], b[j]) for i in a for j in b if a[i] & b[j]}
    assert {(r["k"], r["other_k"]): r["value"] for r in expanded(left.all_pairs(right), left, right).collect()} == want
    for k in (1, 7):
        got = collections.defaultdict(dict)
        for r in expanded(left.top(right, k), left, right).collect():
            got[r["k"]][r["other_k"]] = r["value"]
        for i in a:
            values = sorted((v for (x, _), v in want.items() if x == i), reverse=True)
            bound = values[k - 1] if len(values) >= k else 0
            assert got.get(i, {}) == {j: v for (x, j), v in want.items() if x == i and v >= bound}


def test_few_classes_meet(spark):
    """With a high limit the pairs that meet stay far below all pairs, where compositions and sizes differ."""
    rng = random.Random(5)
    kinds = [(rng.sample("ABCDEFGHIJKLMNOPQRST", 5), rng.randint(15, 120)) for _ in range(150)]
    a = {i: collections.Counter(rng.choices(kinds[i % 150][0], weights=[16, 8, 4, 2, 1], k=kinds[i % 150][1])) for i in range(1500)}
    left = multisets(spark, a)
    assert left.join(left, 0.85).count() >= left.classes.count()
    ranks = left.tokens.groupBy("item", "i").agg(F.count("*").alias("holders"))
    p = left._prefixes(ranks, 0.85)
    pairs = p.join(p.withColumnsRenamed({"_ca": "_oa", "_cb": "_ob", "size": "_m"}), ["item", "i"]).select("_ca", "_oa").distinct().count()
    assert pairs < 1500 * 1500 / 10


def test_similarity_of_patterns(spark):
    rng = random.Random(6)
    rows = [atom(s, i, rng.choice("CNO"), seq=i // rng.choice([3, 4, 4])) for s in (1, 2) for i in range(40)]
    seq = Scope(spark.createDataFrame(rows, ATOM)).residues_of()
    every = {(r["scope_id"], tuple(r["atom_ids"]), r["other_scope"], tuple(r["other_ids"])): r["value"] for r in seq.similarity(seq).collect()}
    some = {(r["scope_id"], tuple(r["atom_ids"]), r["other_scope"], tuple(r["other_ids"])): r["value"] for r in seq.similarity(seq, least=0.6).collect()}
    assert some == {k: v for k, v in every.items() if v >= 0.6}
    first = [r for r in seq.most_similar(seq, 1).collect()]
    assert len(first) == seq.df.count() and all(r["value"] == 1.0 and r["rank"] == 1 for r in first)


def test_filled_with_one_large_pattern(spark):
    rng = random.Random(7)
    rows = [atom(1, i, seq=i // 4, chain="A", at=[rng.uniform(0, 60) for _ in "xyz"] if i < 8 else [a + rng.uniform(0, 2) for a in (i // 4 % 20 * 3, i // 80 * 3, 0)]) for i in range(400)]
    scope = Scope(spark.createDataFrame(rows, ATOM))
    got = {tuple(r["atom_ids"]) for r in scope.residues_of().filled(0.75).df.collect()}
    at = {r[1]: r[9:] for r in rows}
    want = set()
    for seq in {r[7] for r in rows}:
        ids = [r[1] for r in rows if r[7] == seq]
        c = [sum(at[i][k] for i in ids) / len(ids) for k in range(3)]
        d = lambda i: sum((at[i][k] - c[k]) ** 2 for k in range(3)) ** 0.5
        r = 0.75 * max(map(d, ids))
        want.add(tuple(sorted({*ids, *(i for i in at if d(i) <= r)})))
    assert got == want


def test_four_sequences_at_distances(spark):
    rng = random.Random(8)
    rows = [atom(s, i, rng.choice(["C", "N", "O", "ZN"]), at=[rng.uniform(0, 12) for _ in "xyz"]) for s in (1, 2) for i in range(40)]
    scope = Scope(spark.createDataFrame(rows, ATOM))
    names = ["C", "N", "O", "ZN"]
    low, high = [[], [0], [0, 2], [0, 0, 1]], [[], [6], [7, 8], [9, 3, 4]]
    got = {(r["scope_id"], tuple(r["atom_ids"])) for r in scope.atoms_of("C").distance_cluster([scope.atoms_of(n) for n in names[1:]], low, high).df.collect()}
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[9:], b[9:], strict=True)) ** 0.5
    want = set()
    for s in (1, 2):
        of = [[r for r in rows if r[0] == s and r[2] == n] for n in names]
        for four in itertools.product(*of):
            if all(low[i][j] <= d(four[i], four[j]) <= high[i][j] for i in range(4) for j in range(i)):
                want.add((s, tuple(sorted(r[1] for r in four))))
    assert got == want and want


def test_residues_around_and_of_the_pattern(spark):
    rows = [atom(1, 0, "ZN", "ZN", seq=1), atom(1, 1, "O", "ZN", seq=1, at=(50, 0, 0)), atom(1, 2, "C", "ALA", seq=2, at=(1, 0, 0)), atom(1, 3, "C", "ALA", seq=2, at=(90, 0, 0)), atom(1, 4, "O", "HOH", seq=3, at=(0, 1, 0))]
    zinc = Scope(spark.createDataFrame(rows, ATOM)).atoms_of("ZN")
    ids = lambda seq: [r["atom_ids"] for r in seq.df.collect()]
    assert ids(zinc.ambient_residues(2)) == [[0, 1, 2, 3]]
    assert ids(zinc.ambient_residues(2, exclude_base=True)) == [[2, 3]]
    assert ids(zinc.ambient_residues(2, no_waters=False)) == [[0, 1, 2, 3, 4]]
    assert ids(zinc.ambient_atoms(2, no_waters=False, exclude_base=True)) == [[2, 4]]
    assert ids(zinc.ambient_atoms(0.5, exclude_base=True)) == []
    assert [r["atom_id"] for r in sorted(zinc.nearest_atoms(9).collect(), key=lambda r: r["rank"])] == [0, 2, 4, 1, 3]


def test_a_pattern_of_many_atoms_stays_linear(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("1L AS scope_id", "CAST(id AS INT) AS atom_id", "'C' AS element", "'C' AS name", "'ATOM' AS record_name", "'ALA' AS res_name", "'A' AS chain", "CAST(id DIV 8 AS INT) AS res_seq", "'' AS ins_code", "CAST(id % 50 AS DOUBLE) * 3 AS x", "CAST(id DIV 50 % 50 AS DOUBLE) * 3 AS y", "CAST(id DIV 2500 AS DOUBLE) * 3 AS z")
    bonds = spark.range(n - 1).selectExpr("1L AS scope_id", "CAST(id AS INT) AS a", "CAST(id + 1 AS INT) AS b", "1 AS bond_type")
    scope = Scope(rows, bonds)
    half = scope.seq(rows.filter("atom_id < 50000").groupBy("scope_id").agg(F.array_sort(F.collect_list("atom_id")).alias("atom_ids")), False)
    size = lambda seq: [len(r["atom_ids"]) for r in seq.df.collect()]
    assert size(half.ambient_atoms(3.1)) == [52500]
    assert size(half.connected_atoms(2)) == [50002]
    assert size(half.connected_residues(1)) == [50008]
    assert half.connected().collect()[0]["value"] is True
    assert half.count_of(scope.residues_of()).collect()[0]["count"] == 6250
    assert size(half.path(scope.atoms_of())) == [50001]
    assert half.connected_to(scope.atoms_of()).df.count() == 1
    wide = ("atom_ids", "array<int>")
    assert wide not in half.members.dtypes and wide not in half._points().dtypes and set(PID) < set(half.members.columns)
