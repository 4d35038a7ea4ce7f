"""Registered queries of operators that need tables besides atoms and bonds."""

from __future__ import annotations

from pyspark.sql import functions as F

from molquarry.operators import charges as Q
from molquarry.operators import service
from molquarry.operators import validation as V
from molquarry.operators.core import PatternSeq, Scope, group_graph
from molquarry.plans.analysis import GROUPS, LINE, MOTIFS, groups, motif_tables
from molquarry.plans.patterns import IDS, NEAR
from molquarry.sources import sinks
from molquarry.sources.fixtures import SQL_ATOMS, SQL_BONDS, scope, table

QUERIES, ORACLE = {}, {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def with_tables(s, d) -> Scope:
    """The fixture's scope with modified residues, secondary elements, catalogue sites and atom properties."""
    c = scope(s, d)
    res = c.residues
    modified = res.filter("res_seq % 13 = 0").select("scope_id", "chain", "res_seq", "ins_code", F.when(F.col("res_seq") % 2 == 0, "MET").otherwise("CYS").alias("modified_from"))
    first = res.filter("chain in ('A', 'B')").groupBy("scope_id", "chain").agg(F.min("res_seq").alias("r"))
    secondary = first.select("scope_id", F.explode(F.array(F.struct(F.lit("helix").alias("kind"), F.lit(2).alias("o"), F.lit(6).alias("e")), F.struct(F.lit("sheet").alias("kind"), F.lit(8).alias("o"), F.lit(9).alias("e")))).alias("k"), "chain", "r").select("scope_id", "k.kind", F.when(F.col("chain") == "A", 1).otherwise(2).alias("elem_no"), "chain", (F.col("r") + F.col("k.o")).alias("start_seq"), (F.col("r") + F.col("k.e")).alias("end_seq"))
    sites = c.atoms.select("scope_id").distinct().select(F.col("scope_id").cast("string").alias("pdb_id"), F.explode(F.expr("array(named_struct('site_number', 1, 'ordinal', 0L, 'chain', 'A', 'res_seq', 3), named_struct('site_number', 1, 'ordinal', 1L, 'chain', 'A', 'res_seq', 5), named_struct('site_number', 2, 'ordinal', 2L, 'chain', 'Z', 'res_seq', 3), named_struct('site_number', 2, 'ordinal', 3L, 'chain', 'A', 'res_seq', 7))")).alias("s")).select("pdb_id", "s.*")
    props = c.atoms.select("scope_id", F.lit("charge").alias("prop"), "atom_id", (F.col("atom_id") / 4.0).alias("value")).filter("atom_id % 2 = 0")
    return Scope(c.atoms, c.bonds, modified=modified, secondary=secondary, csa=sites, props=props)


def patterns(name: str, make, sql: str) -> None:
    add(name, lambda s, d: make(with_tables(s, d)).text().select("scope_id", "atoms"), f"WITH {SQL_ATOMS} {sql}")


patterns("gen10_modified", lambda c: c.modified_residues("met"), f"SELECT scope_id, {IDS} FROM a WHERE res_seq % 26 = 0 GROUP BY scope_id, chain, res_seq")
patterns("gen20_helices", lambda c: c.secondary("helix"), f", f AS (SELECT scope_id, chain, min(res_seq) AS r FROM a WHERE chain IN ('A', 'B') GROUP BY ALL) SELECT scope_id, {IDS} FROM a JOIN f USING (scope_id, chain) WHERE res_seq BETWEEN r + 2 AND r + 6 GROUP BY scope_id, chain")
patterns("gen20_sheets", lambda c: c.secondary("sheet"), f", f AS (SELECT scope_id, chain, min(res_seq) AS r FROM a WHERE chain IN ('A', 'B') GROUP BY ALL) SELECT scope_id, {IDS} FROM a JOIN f USING (scope_id, chain) WHERE res_seq BETWEEN r + 8 AND r + 9 GROUP BY scope_id, chain")
patterns("gen22_catalytic_sites", lambda c: c.catalytic_sites(), f"SELECT scope_id, {IDS} FROM a WHERE chain = 'A' AND res_seq IN (3, 5) GROUP BY scope_id HAVING max(CASE WHEN res_seq = 3 THEN 1 ELSE 0 END) = 1")
add("fun10_property", lambda s, d: with_tables(s, d).atoms_of("S").atom_property("charge").select("scope_id", F.get("atom_ids", F.lit(0)).alias("atom_id"), "value"), f"WITH {SQL_ATOMS} SELECT scope_id, atom_id, CASE WHEN atom_id % 2 = 0 THEN atom_id / 4.0 END AS value FROM a WHERE element = 'S'")
add("fun5_find", lambda s, d: scope(s, d).chains().find(lambda i: i.residues_of("HIS")).groupBy("scope_id").agg(F.count("*").alias("n"), F.sum(F.size("atom_ids")).alias("atoms")), f"WITH {SQL_ATOMS} SELECT scope_id, count(DISTINCT (chain, res_seq)) AS n, count(*) AS atoms FROM a WHERE res_name = 'HIS' GROUP BY 1")
add("fun11_descriptor", lambda s, d: scope(s, d).residues_of("HIS").descriptor(table(s, d, "supplier").select(F.col("s_suppkey").alias("scope_id"), F.create_map(F.lit("nation"), F.col("s_nationkey")).alias("descriptors")), "nation").groupBy(F.col("value").alias("nation")).agg(F.count("*").alias("n")), f"WITH {SQL_ATOMS} SELECT s_nationkey AS nation, count(DISTINCT (scope_id, chain, res_seq)) AS n FROM a JOIN supplier ON s_suppkey = scope_id WHERE res_name = 'HIS' GROUP BY 1")


def ends(c: Scope) -> PatternSeq:
    """Atoms 2 and 7 of each whole residue: bonded by the ring closure, but for water."""
    pairs = c.atoms.filter("pos in (2, 7)").groupBy("scope_id", "chain", "res_seq").agg(F.array_sort(F.collect_set("atom_id")).alias("atom_ids")).filter("size(atom_ids) = 2")
    return c.seq(pairs)


add("top7_connected", lambda s, d: (lambda c: ends(c).connected().select("scope_id", F.array_join("atom_ids", "-").alias("atoms"), "value"))(scope(s, d)), f"WITH {SQL_ATOMS} SELECT scope_id, array_to_string(list_sort(list(atom_id)), '-') AS atoms, min(res_name) <> 'HOH' AS value FROM a WHERE pos IN (2, 7) GROUP BY scope_id, chain, res_seq HAVING count(*) = 2")
add("top9_group_graph", lambda s, d: (lambda c: group_graph(c.residues_of("HIS", "CYS", "GLY", "SER")).select("scope_id", F.array_min("first").alias("first"), F.array_min("second").alias("second")))(scope(s, d)), f"""WITH RECURSIVE {SQL_ATOMS}, q AS (SELECT scope_id, chain, res_seq, min(atom_id) AS f, min(res_name) IN ('HIS', 'CYS', 'GLY', 'SER') AS g FROM a GROUP BY ALL),
  h AS (SELECT *, row_number() OVER (PARTITION BY scope_id, chain ORDER BY res_seq) AS k FROM q WHERE g) SELECT x.scope_id, x.f AS first, y.f AS second FROM h x JOIN h y ON x.scope_id = y.scope_id AND x.chain = y.chain AND y.k = x.k + 1""")
add(
    "geo6_near",
    lambda s, d: (lambda c: c.atoms_of("ZN").near(5, c.residues_of("CYS")).text().select("scope_id", "atoms"))(scope(s, d)),
    f"""WITH {SQL_ATOMS}, s0 AS (SELECT scope_id, 0 AS q, CAST(atom_id AS VARCHAR) AS pid, atom_id, x, y, z FROM a WHERE element = 'ZN'), s1 AS (SELECT scope_id, 1 AS q, chain || res_seq AS pid, atom_id, x, y, z FROM a WHERE res_name = 'CYS'),
    s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1), k AS (SELECT scope_id, q, count(DISTINCT pid) AS n FROM s GROUP BY ALL), v AS (SELECT scope_id, arg_min(q, n * 10 + q) AS q FROM k GROUP BY scope_id HAVING count(*) = 2),
    p0 AS (SELECT s.* FROM s JOIN v USING (scope_id, q)), m AS (SELECT p.scope_id, p.pid, q.q, q.pid AS other FROM p0 p JOIN s q ON p.scope_id = q.scope_id AND {NEAR} < 25 GROUP BY ALL),
    ok AS (SELECT scope_id, pid FROM m GROUP BY ALL HAVING count(DISTINCT q) = 2), z AS (SELECT m.scope_id, m.pid, s.atom_id FROM m JOIN ok USING (scope_id, pid) JOIN s ON s.scope_id = m.scope_id AND s.q = m.q AND s.pid = m.other),
    w AS (SELECT DISTINCT scope_id, ids FROM (SELECT scope_id, pid, list_sort(list(DISTINCT atom_id)) AS ids FROM z GROUP BY scope_id, pid)), c AS (SELECT scope_id, q, pid, list(atom_id) AS ids FROM s GROUP BY ALL),
    n AS (SELECT w.scope_id, w.ids, count(*) FILTER (c.q = 0) AS n0, count(*) FILTER (c.q = 1) AS n1 FROM w JOIN c ON c.scope_id = w.scope_id AND list_has_all(w.ids, c.ids) GROUP BY ALL) SELECT scope_id, array_to_string(ids, '-') AS atoms FROM n WHERE n0 = 1 AND n1 = 1""",
)
add("geo7_distance_cluster", lambda s, d: (lambda c: c.atoms_of("ZN").distance_cluster([c.atoms_of("S")], [[], [3.0]], [[], [8.0]]).text().select("scope_id", "atoms"))(scope(s, d)), f"WITH {SQL_ATOMS} SELECT DISTINCT p.scope_id, least(p.atom_id, q.atom_id) || '-' || greatest(p.atom_id, q.atom_id) AS atoms FROM a p JOIN a q ON p.scope_id = q.scope_id AND p.element = 'ZN' AND q.element = 'S' AND sqrt({NEAR}) BETWEEN 3 AND 8")
add("chg12_inverse_lines", lambda s, d: Q.all_correlations(groups(s, d)[1].withColumn("charge", F.round("charge", 6)), ["scope_id"], ["atom_ids"]).filter("set_x > set_y").select("scope_id", "set_x", "set_y", "n", F.round("slope", 5).alias("slope")), f"{GROUPS}, p AS (SELECT x.scope_id, x.set_id AS sx, y.set_id AS sy, round(x.charge, 6) AS x, round(y.charge, 6) AS y FROM g x JOIN g y USING (scope_id, chain, res_seq) WHERE x.set_id < y.set_id) SELECT scope_id, sy AS set_x, sx AS set_y, count(*) AS n, round(1 / regr_slope(y, x), 5) AS slope FROM p GROUP BY ALL")
add("win3_order", lambda s, d: service.run({"his": lambda c: c.residues_of("HIS")}, scope(s, d)).orderBy("scope_id", "serial").select("scope_id", F.col("serial").cast("long").alias("serial"), F.col("atom_count").cast("long").alias("atom_count")), f"WITH {SQL_ATOMS}, h AS (SELECT scope_id, count(*) AS atom_count, list_sort(list(atom_id)) AS ids FROM a WHERE res_name = 'HIS' GROUP BY scope_id, chain, res_seq) SELECT scope_id, row_number() OVER (PARTITION BY scope_id ORDER BY ids) - 1 AS serial, atom_count FROM h ORDER BY 1, 2")
CHARGED = f"{LINE} || ' ' || lpad(printf('%.4f', atom_id / 100.0), 8, ' ')"
add("snk4_charge_lines", lambda s, d: (lambda c: sinks.pattern_texts(c.residues_of("HIS").long.drop("name").join(c.atoms, ["scope_id", "atom_id"]).withColumn("occupancy", F.lit(1.0)).withColumn("temperature_factor", F.lit(0.0)), ["scope_id", "chain", "res_seq"], F.col("atom_id") / 100))(scope(s, d)), f"WITH {SQL_ATOMS} SELECT scope_id, chain, res_seq, string_agg({CHARGED}, chr(10) ORDER BY atom_id) || chr(10) || 'END' AS value FROM a WHERE res_name = 'HIS' GROUP BY ALL")


def bonds_of(s, d):
    motifs, models, atoms, pairing = motif_tables(s, d)
    c = scope(s, d)
    ends_ = atoms.select("motif_id", "atom_id", F.split("motif_id", ":")[0].cast("long").alias("scope_id"), "res_seq")
    b = c.bonds.join(ends_.select("scope_id", F.col("atom_id").alias("a"), "motif_id", "res_seq"), ["scope_id", "a"]).join(ends_.select(F.col("atom_id").alias("b"), F.col("motif_id").alias("m2"), F.col("scope_id").alias("s2")), "b").filter("motif_id = m2")
    b = b.filter("not (res_seq % 3 = 0 and bond_type = 2)").select("motif_id", "a", "b", "bond_type")
    model = s.createDataFrame([(m, x, x + 1, 2 if x == 2 else 1) for m in ("HIS", "NAG") for x in range(7)] + [(m, 2, 7, 1) for m in ("HIS", "NAG")], "model string, a int, b int, bond_type int")
    return pairing, b, model, atoms, models


add("val11_wrong_bonds", lambda s, d: (lambda t: V.wrong_bonds(t[0], t[1], t[2]).groupBy("motif_id", "kind").agg(F.count("*").alias("n")))(bonds_of(s, d)), f"{MOTIFS}, k AS (SELECT motif_id, max(res_seq) AS r, list(pos) AS ps FROM m WHERE pos <> 7 OR res_seq % 2 = 0 GROUP BY 1) SELECT motif_id, 'Missing' AS kind, count(*) AS n FROM k WHERE r % 3 = 0 AND list_contains(ps, 2) AND list_contains(ps, 3) GROUP BY ALL")
add("val12_warnings", lambda s, d: (lambda t: V.warnings(t[3].withColumn("alt_loc", F.when(F.col("atom_id") % 10 == 0, "A")), t[1], s.createDataFrame([("C", 2), ("N", 1)], "most_bonds_element string, most int")))(bonds_of(s, d)), f"{MOTIFS}, {SQL_BONDS}, i AS (SELECT x.motif_id, b.a, b.b FROM b JOIN m x ON x.scope_id = b.scope_id AND x.atom_id = b.a JOIN m y ON y.scope_id = b.scope_id AND y.atom_id = b.b AND y.motif_id = x.motif_id WHERE NOT (x.res_seq % 3 = 0 AND bond_type = 2)), e2 AS (SELECT motif_id, a AS atom_id FROM i UNION ALL SELECT motif_id, b FROM i), c AS (SELECT motif_id, atom_id, count(*) AS n FROM e2 GROUP BY ALL) SELECT m.motif_id, count(*) FILTER ((element = 'C' AND n > 2) OR (element = 'N' AND n > 1)) AS too_many_bonds, count(*) FILTER (m.atom_id % 10 = 0) AS alternate_locations FROM m LEFT JOIN c ON c.motif_id = m.motif_id AND c.atom_id = m.atom_id GROUP BY 1")
add("val5_missing_rings", lambda s, d: (lambda c: V.missing_rings(c.rings.join(c.residues.filter("res_name = 'HIS'").select("scope_id", F.array_min("atom_ids").alias("first"), F.array_max("atom_ids").alias("last")), "scope_id").filter("array_min(atom_ids) between first and last").select(F.concat_ws(":", F.col("scope_id").cast("string"), F.col("first").cast("string")).alias("motif_id"), "fingerprint"), s.createDataFrame([("HIS", "C-C-C-C-C-O")], "model string, fingerprint string"), c.residues.filter("res_name = 'HIS'").select(F.concat_ws(":", F.col("scope_id").cast("string"), F.array_min("atom_ids").cast("string")).alias("motif_id"), F.lit("HIS").alias("model"))))(scope(s, d)), f"WITH {SQL_ATOMS}, g AS (SELECT scope_id, min(atom_id) AS f, count(*) AS n, list(element ORDER BY pos)[3:8] AS els FROM a WHERE res_name = 'HIS' GROUP BY scope_id, chain, res_seq) SELECT scope_id || ':' || f AS motif_id, CAST(CASE WHEN n = 8 AND list_sort(els) = ['C', 'C', 'C', 'C', 'C', 'O'] THEN 0 ELSE 1 END AS BIGINT) AS missing_rings, CAST(CASE WHEN n = 8 AND list_sort(els) <> ['C', 'C', 'C', 'C', 'C', 'O'] THEN 1 ELSE 0 END AS BIGINT) AS extra_rings FROM g")
add("val3_pairing", lambda s, d: (lambda t: V.pair_by_name(t[2], t[1]).select("motif_id", "model_atom", "motif_atom"))(motif_tables(s, d)), f"{MOTIFS} SELECT motif_id, pos AS model_atom, atom_id AS motif_atom FROM m JOIN md USING (pos) WHERE element = el")
