"""Registered queries of the pattern operators, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from molquarry.operators import core
from molquarry.sources.fixtures import SQL_ATOMS, SQL_BONDS, scope

AMINO = ", ".join(f"'{x}'" for x in core.AMINO)
RES = "scope_id, chain, res_seq"
IDS = "array_to_string(list_sort(list(DISTINCT atom_id)), '-') AS atoms"

QUERIES, ORACLE = {}, {}


def add(name: str, run, sql: str | None, bonds: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(scope(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = f"WITH {SQL_ATOMS}{',' + SQL_BONDS if bonds else ''} {sql}"


def patterns(name: str, make, sql: str | None, bonds: bool = False) -> None:
    """A query that gives scope_id and the atoms of each pattern."""
    add(name, lambda s: make(s).text().select("scope_id", "atoms"), sql, bonds)


def single(where: str) -> str:
    return f"SELECT scope_id, CAST(atom_id AS VARCHAR) AS atoms FROM a WHERE {where}"


def residue(having: str) -> str:
    return f"SELECT scope_id, {IDS} FROM a GROUP BY {RES} HAVING {having}"


patterns("gen1_atoms", lambda s: s.atoms_of("zn", "S"), single("element IN ('ZN', 'S')"))
patterns("gen2_not_atoms", lambda s: s.not_atoms("C", "n"), single("element NOT IN ('C', 'N')"))
patterns("gen3_atom_names", lambda s: s.atom_names("n0", "O3"), single("name IN ('N0', 'O3')"))
patterns("gen4_not_atom_names", lambda s: s.not_atom_names("N0", "C1", "C2"), single("name NOT IN ('N0', 'C1', 'C2')"))
patterns("gen5_atom_ids", lambda s: s.atom_ids(3, 5, 100000), single("atom_id IN (3, 5, 100000)"))
patterns("gen6_not_atom_ids", lambda s: s.not_atom_ids(3, 5), single("atom_id NOT IN (3, 5)"))
patterns("gen7_atom_id_range", lambda s: s.atom_id_range(20, 8), single("atom_id BETWEEN 8 AND 20"))
patterns("gen8_residues", lambda s: s.residues_of("his", "CYS"), residue("min(res_name) IN ('HIS', 'CYS')"))
patterns("gen9_not_residues", lambda s: s.not_residues("HOH", "GLY"), residue("min(res_name) NOT IN ('HOH', 'GLY')"))
patterns("gen11_residue_id_range", lambda s: s.residue_id_range("A", 20, 5), residue("chain = 'A' AND res_seq BETWEEN 5 AND 20"))
patterns("gen12_residue_ids", lambda s: s.residue_ids("7 A", "30 B"), residue("(chain = 'A' AND res_seq = 7) OR (chain = 'B' AND res_seq = 30)"))
patterns("gen13_amino_acids", lambda s: s.amino_acids("Positive"), residue("min(res_name) IN ('LYS', 'ARG', 'HIS')"))
patterns("gen13_all_amino_acids", lambda s: s.amino_acids(), residue(f"min(res_name) IN ({AMINO})"))
patterns("gen14_not_amino_acids", lambda s: s.not_amino_acids(), residue(f"min(res_name) NOT IN ({AMINO}, 'HOH')"))
patterns("gen15_het_residues", lambda s: s.het_residues(), residue("arg_min(record_name, atom_id) = 'HETATM' AND min(res_name) <> 'HOH'"))
patterns("gen19_chains", lambda s: s.chains("A", "C"), f"SELECT scope_id, {IDS} FROM a WHERE chain IN ('A', 'C') GROUP BY scope_id, chain")
patterns("gen21_grouped_atoms", lambda s: s.grouped_atoms("ZN", "S"), f"SELECT scope_id, {IDS} FROM a WHERE element IN ('ZN', 'S') GROUP BY scope_id, element")
patterns("gen23_whole", lambda s: s.whole(), f"SELECT scope_id, {IDS} FROM a GROUP BY scope_id")
patterns("gen24_common_atoms", lambda s: s.common_atoms(s.atoms.filter("scope_id = 1 and pos < 2")), f"SELECT scope_id, coalesce(array_to_string(list_sort(list(DISTINCT atom_id) FILTER (hit)), '-'), '') AS atoms FROM (SELECT *, (atom_id, element, chain, res_seq) IN (SELECT atom_id, element, chain, res_seq FROM a WHERE scope_id = 1 AND pos < 2) AS hit FROM a) GROUP BY scope_id")

RING = """
r2 AS (SELECT scope_id, chain, res_seq, any_value(res_name) AS rn, count(*) AS n, list(atom_id ORDER BY pos) AS ids, list(element ORDER BY pos) AS els FROM a GROUP BY scope_id, chain, res_seq),
rg AS (SELECT scope_id, list_slice(ids, 3, 8) AS ids, list_slice(els, 3, 8) AS els FROM r2 WHERE n = 8 AND rn <> 'HOH'),
rf AS (SELECT scope_id, array_to_string(ids, '-') AS atoms, ids, list_min(list_concat(
  list_transform(range(1, 7), lambda i: array_to_string(list_concat(list_slice(els, i, 6), list_slice(els, 1, i - 1)), '-')),
  list_transform(range(1, 7), lambda i: array_to_string(list_concat(list_slice(list_reverse(els), i, 6), list_slice(list_reverse(els), 1, i - 1)), '-')))) AS fingerprint FROM rg)"""

add("str10_ring_fingerprints", lambda s: s.rings.select("scope_id", "fingerprint", F.array_join("atom_ids", "-").alias("atoms")), None)
ORACLE["str10_ring_fingerprints"] = f"WITH {SQL_ATOMS}, {RING} SELECT scope_id, fingerprint, atoms FROM rf"
patterns("gen16_rings", lambda s: s.rings_of("C", "O", "C", "C", "S", "C"), None)
ORACLE["gen16_rings"] = f"WITH {SQL_ATOMS}, {RING} SELECT scope_id, atoms FROM rf WHERE fingerprint = '{core.least_rotation(['C', 'O', 'C', 'C', 'S', 'C'])}'"
patterns("gen17_ring_atoms", lambda s: s.ring_atoms(["O", "S"]), None)
ORACLE["gen17_ring_atoms"] = f"WITH {SQL_ATOMS}, {RING} SELECT rf.scope_id, CAST(a.atom_id AS VARCHAR) AS atoms FROM rf JOIN a ON a.scope_id = rf.scope_id AND list_contains(rf.ids, a.atom_id) AND a.element IN ('O', 'S')"

LETTER = "CASE min(res_name) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in core.AMINO.items()) + " END"
add(
    "gen18_regular_motifs",
    lambda s: s.regular_motifs("H.[YW]").df.select("scope_id", F.size("atom_ids").cast("long").alias("n_atoms")).groupBy("scope_id").agg(F.count("*").alias("n_motifs"), F.sum("n_atoms").alias("n_atoms")),
    f""", q AS (SELECT scope_id, chain, res_seq, {LETTER} AS l, count(*) AS n FROM a GROUP BY {RES}),
    c AS (SELECT scope_id, chain, string_agg(l, '' ORDER BY res_seq) AS t, list(n ORDER BY res_seq) AS ns FROM q WHERE l IS NOT NULL GROUP BY scope_id, chain),
    m AS (SELECT scope_id, chain, ns, t, regexp_extract_all(t, 'H.[YW]') AS f, string_split_regex(t, 'H.[YW]') AS g FROM c),
    h AS (SELECT scope_id, ns, f, g, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0),
    k AS (SELECT scope_id, list_sum(list_slice(ns, s + 1, s + 3)) AS n FROM (SELECT scope_id, ns, list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + 3 * (i - 1) AS s FROM h))
    SELECT scope_id, count(*) AS n_motifs, CAST(sum(n) AS BIGINT) AS n_atoms FROM k GROUP BY scope_id""",
)

# structure tables
add("str1_residues", lambda s: s.residues.select("scope_id", "chain", "res_seq", "res_name", F.size("atom_ids").cast("long").alias("n_atoms")), f"SELECT {RES}, arg_min(res_name, atom_id) AS res_name, count(*) AS n_atoms FROM a GROUP BY {RES}")
add("str2_residue_ids", lambda s: s.residues.select("scope_id", core.parse_residue_id(F.concat_ws(" ", F.col("res_seq").cast("string"), "chain")).alias("r")).select("scope_id", F.col("r.chain").alias("chain"), F.col("r.res_seq").alias("res_seq")), f"SELECT DISTINCT {RES} FROM a")
add("str3_classes", lambda s: s.residues.groupBy("scope_id").agg(*[F.count_if(core.upper_in("res_name", list(n))).alias(k) for k, n in (("n_amino", core.AMINO), ("n_nucleotide", core.NUCLEOTIDE))], F.count_if(F.col("res_name") == "HOH").alias("n_water"), F.count_if(F.col("record_name") == "HETATM").alias("n_het")), f", q AS (SELECT {RES}, min(res_name) AS rn, arg_min(record_name, atom_id) AS rec FROM a GROUP BY {RES}) SELECT scope_id, count(*) FILTER (rn IN ({AMINO})) AS n_amino, count(*) FILTER (rn IN ('A','C','G','I','U','DA','DC','DG','DI','DT')) AS n_nucleotide, count(*) FILTER (rn = 'HOH') AS n_water, count(*) FILTER (rec = 'HETATM') AS n_het FROM q GROUP BY scope_id")
add("str4_charge_class", lambda s: s.residues.groupBy("scope_id", core.charge_class(F.col("res_name")).alias("charge_class")).agg(F.count("*").alias("n")), f", q AS (SELECT {RES}, min(res_name) AS rn FROM a GROUP BY {RES}) SELECT scope_id, CASE WHEN rn IN ('LYS','ARG','HIS') THEN 'Positive' WHEN rn IN ('ASP','GLU') THEN 'Negative' WHEN rn IN ('PHE','TYR','TRP') THEN 'Aromatic' WHEN rn IN ('CYS','SER','THR','ASN','GLN') THEN 'Polar' WHEN rn IN ({AMINO}) THEN 'NonPolar' ELSE 'Unknown' END AS charge_class, count(*) AS n FROM q GROUP BY ALL")
add("str5_one_letter", lambda s: s.whole().amino_string().select("scope_id", "sequence"), f", q AS (SELECT {RES}, {LETTER} AS l FROM a GROUP BY {RES}) SELECT scope_id, string_agg(l, '' ORDER BY chain, res_seq) AS sequence FROM q WHERE l IS NOT NULL GROUP BY scope_id")
add("str11_centers", lambda s: s.residues_of("HIS").centers.select("scope_id", F.array_join("atom_ids", "-").alias("atoms"), *[F.round(f"p{c}", 6).alias(f"c{c}") for c in "xyz"], F.round("radius", 6).alias("radius")), f", c AS (SELECT {RES}, {IDS}, avg(x) AS px, avg(y) AS py, avg(z) AS pz FROM a WHERE res_name = 'HIS' GROUP BY {RES}) SELECT scope_id, atoms, round(px, 6) AS cx, round(py, 6) AS cy, round(pz, 6) AS cz, round(max(sqrt((x - px)**2 + (y - py)**2 + (z - pz)**2)), 6) AS radius FROM c JOIN a USING ({RES}) GROUP BY scope_id, atoms, px, py, pz")
add("str12_signatures", lambda s: s.chains().signature().select("scope_id", "signature", "with_counts", "residue_ids"), f""", q AS (SELECT {RES}, arg_min(res_name, atom_id) AS rn FROM a GROUP BY {RES}), i AS (SELECT scope_id, chain, string_agg(res_seq || ' ' || chain, '-' ORDER BY res_seq) AS residue_ids FROM q GROUP BY scope_id, chain), k AS (SELECT scope_id, chain, rn, count(*) AS n FROM q GROUP BY ALL)
  SELECT k.scope_id, string_agg(CASE WHEN n > 1 THEN n || rn ELSE rn END, '-' ORDER BY rn) AS signature, string_agg(rn || '*' || n, '-' ORDER BY rn) AS with_counts, any_value(residue_ids) AS residue_ids FROM k JOIN i USING (scope_id, chain) GROUP BY k.scope_id, k.chain""")
add("str13_counts", lambda s: s.atoms.groupBy("scope_id").agg(F.count("*").alias("n_atoms"), F.count_distinct("element").alias("n_elements"), F.count_distinct("chain", "res_seq").alias("n_residues"), F.array_join(F.array_sort(F.collect_set("element")), ",").alias("elements")), "SELECT scope_id, count(*) AS n_atoms, count(DISTINCT element) AS n_elements, count(DISTINCT (chain, res_seq)) AS n_residues, array_to_string(list_sort(list(DISTINCT element)), ',') AS elements FROM a GROUP BY scope_id")
add("str9_induced_bonds", lambda s: s.residues_of("PHE").induced()[0].bonds.groupBy("bond_type").agg(F.count("*").alias("n")), f", q AS (SELECT {RES}, atom_id FROM a WHERE res_name = 'PHE') SELECT bond_type, count(*) AS n FROM b JOIN q p ON b.scope_id = p.scope_id AND b.a = p.atom_id JOIN q r ON b.scope_id = r.scope_id AND b.b = r.atom_id AND p.chain = r.chain AND p.res_seq = r.res_seq GROUP BY bond_type", bonds=True)

# sets, functions
patterns("set1_or", lambda s: s.residues_of("HIS").either(s.residues_of("HIS", "CYS"), s.atoms_of("ZN")), residue("min(res_name) IN ('HIS', 'CYS')") + " UNION " + single("element = 'ZN'"))
patterns("set2_union", lambda s: s.residues_of("HIS").union(), f"SELECT scope_id, {IDS} FROM a WHERE res_name = 'HIS' GROUP BY scope_id")
patterns("set3_to_atoms", lambda s: s.residues_of("HIS").either(s.atoms_of("N")).to_atoms(), single("res_name = 'HIS' OR element = 'N'"))
patterns("set4_to_residues", lambda s: s.atoms_of("N", "O").to_residues(), f"SELECT scope_id, {IDS} FROM a WHERE element IN ('N', 'O') GROUP BY {RES}")
add("fun6_named", lambda s: s.residues_of("HIS").named().text(), f"SELECT scope_id, {IDS}, min(atom_id) AS name FROM a WHERE res_name = 'HIS' GROUP BY {RES}")
patterns("fun1_filter", lambda s: s.residues_of().filter(lambda q: q.count_atoms(F.col("element") == "S").select(*core.KEY, (F.col("count") >= 1).alias("value"))), residue("count(*) FILTER (element = 'S') >= 1"))
patterns("fun2_execute_if", lambda s: s.residues_of("HIS").execute_if(s.atoms_of("ZN").seq_count().filter("count > 12")), f"SELECT scope_id, {IDS} FROM a WHERE res_name = 'HIS' AND scope_id IN (SELECT scope_id FROM a WHERE element = 'ZN' GROUP BY scope_id HAVING count(*) > 12) GROUP BY {RES}")
patterns("fun3_flatten", lambda s: s.residues_of("HIS").flatten(lambda i: i.atoms_of("N", "S")), single("res_name = 'HIS' AND element IN ('N', 'S')"))
patterns("fun4_inside", lambda s: core.PatternSeq.inside(lambda i: i.grouped_atoms("C"), s.residues_of("CYS")), f"SELECT scope_id, {IDS} FROM a WHERE res_name = 'CYS' AND element = 'C' GROUP BY {RES}")

# counts
add("agg1_count_residues", lambda s: s.chains().count_residues(core.upper_in("res_name", ["HIS"])).select("scope_id", F.size("atom_ids").cast("long").alias("n_atoms"), "count"), "SELECT scope_id, count(*) AS n_atoms, count(DISTINCT res_seq) FILTER (res_name = 'HIS') AS count FROM a GROUP BY scope_id, chain")
add("agg1_count_rings", lambda s: s.chains().count_of(s.rings_of()).select("scope_id", F.size("atom_ids").cast("long").alias("n_atoms"), "count"), None)
ORACLE["agg1_count_rings"] = f"WITH {SQL_ATOMS}, q AS (SELECT scope_id, chain, res_seq, count(*) AS n, min(res_name) AS rn FROM a GROUP BY ALL) SELECT scope_id, CAST(sum(n) AS BIGINT) AS n_atoms, count(*) FILTER (n = 8 AND rn <> 'HOH') AS count FROM q GROUP BY scope_id, chain"
add("agg2_seq_count", lambda s: s.residues_of("HIS").seq_count(), "SELECT scope_id, count(DISTINCT (chain, res_seq)) AS count FROM a WHERE res_name = 'HIS' GROUP BY scope_id")
patterns("agg3_contains", lambda s: s.chains().filter(lambda q: q.count_atoms(F.col("element") == "ZN").select(*core.KEY, (F.col("count") > 0).alias("value"))), f"SELECT scope_id, {IDS} FROM a GROUP BY scope_id, chain HAVING count(*) FILTER (element = 'ZN') > 0")
add("agg4_least_chain", lambda s: s.residues_of("HIS").least_chain().select("scope_id", "least_id", "chain"), f"SELECT scope_id, min(atom_id) AS least_id, chain FROM a WHERE res_name = 'HIS' GROUP BY {RES}")
add("agg5_amino_string", lambda s: s.chains().amino_string().select("scope_id", "sequence"), f", q AS (SELECT {RES}, {LETTER} AS l FROM a GROUP BY {RES}) SELECT scope_id, string_agg(l, '' ORDER BY res_seq) AS sequence FROM q WHERE l IS NOT NULL GROUP BY scope_id, chain")
add("agg6_similarity", lambda s: s.chains("A").similarity(s.chains("B"), "res_name", digits=9).select("scope_id", "other_scope", "value"), f"""
  , q AS (SELECT scope_id, chain, res_seq, res_name FROM a GROUP BY ALL), k AS (SELECT scope_id, chain, res_name, count(*) AS n FROM q GROUP BY ALL), t AS (SELECT scope_id, chain, sum(n) AS t FROM k GROUP BY ALL),
  m AS (SELECT p.scope_id, r.scope_id AS other_scope, sum(least(p.n, r.n)) AS i FROM k p JOIN k r ON p.res_name = r.res_name WHERE p.chain = 'A' AND r.chain = 'B' GROUP BY ALL)
  SELECT m.scope_id, other_scope, round(i / (x.t + y.t - i), 9) AS value FROM m JOIN t x ON x.scope_id = m.scope_id AND x.chain = 'A' JOIN t y ON y.scope_id = other_scope AND y.chain = 'B'""")

# distance family
NEAR = "(p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2"
HIS = f"h AS (SELECT *, scope_id || ':' || chain || ':' || res_seq AS pid FROM a WHERE res_name = 'HIS')"
patterns("geo1_ambient_atoms", lambda s: s.residues_of("HIS").ambient_atoms(6), f", {HIS}, n AS (SELECT p.scope_id, p.pid, q.atom_id FROM h p JOIN a q ON p.scope_id = q.scope_id AND {NEAR} <= 36 WHERE q.res_name <> 'HOH' UNION SELECT scope_id, pid, atom_id FROM h) SELECT DISTINCT scope_id, atoms FROM (SELECT scope_id, pid, {IDS} FROM n GROUP BY scope_id, pid)")
patterns("geo1_ambient_atoms_only", lambda s: s.residues_of("HIS").ambient_atoms(6, exclude_base=True), f", {HIS}, n AS (SELECT p.scope_id, p.pid, q.atom_id FROM h p JOIN a q ON p.scope_id = q.scope_id AND {NEAR} <= 36 WHERE q.res_name <> 'HOH' EXCEPT SELECT scope_id, pid, atom_id FROM h) SELECT DISTINCT scope_id, atoms FROM (SELECT scope_id, pid, {IDS} FROM n GROUP BY scope_id, pid)")
patterns("geo2_his_ambient_residues", lambda s: s.residues_of("HIS").ambient_residues(5), f", {HIS}, n AS (SELECT DISTINCT p.scope_id, p.pid, q.chain, q.res_seq FROM h p JOIN a q ON p.scope_id = q.scope_id AND {NEAR} <= 25 WHERE q.res_name <> 'HOH'), m AS (SELECT n.scope_id, pid, atom_id FROM n JOIN a USING ({RES}) UNION SELECT scope_id, pid, atom_id FROM h) SELECT DISTINCT scope_id, atoms FROM (SELECT scope_id, pid, {IDS} FROM m GROUP BY scope_id, pid)")
CENTER = f"c AS (SELECT scope_id, pid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM h GROUP BY ALL)"
patterns("geo3_spherify", lambda s: s.residues_of("HIS").spherify(8), f", {HIS}, {CENTER}, n AS (SELECT p.scope_id, p.pid, q.atom_id FROM c p JOIN a q ON p.scope_id = q.scope_id AND {NEAR} <= 64 WHERE q.res_name <> 'HOH' UNION SELECT scope_id, pid, atom_id FROM h) SELECT DISTINCT scope_id, atoms FROM (SELECT scope_id, pid, {IDS} FROM n GROUP BY scope_id, pid)")
patterns("geo4_filled", lambda s: s.residues_of("HIS").filled(0.75), f", {HIS}, {CENTER}, d AS (SELECT p.scope_id, p.pid, 0.75 * max(sqrt({NEAR})) AS r FROM c p JOIN h q USING (scope_id, pid) GROUP BY ALL), n AS (SELECT p.scope_id, p.pid, q.atom_id FROM c p JOIN d USING (scope_id, pid) JOIN a q ON p.scope_id = q.scope_id AND sqrt({NEAR}) <= d.r WHERE q.res_name <> 'HOH' UNION SELECT scope_id, pid, atom_id FROM h) SELECT DISTINCT scope_id, atoms FROM (SELECT scope_id, pid, {IDS} FROM n GROUP BY scope_id, pid)")
patterns(
    "geo5_cluster",
    lambda s: s.atoms_of("ZN").cluster(12, s.residues_of("CYS")),
    f""", s0 AS (SELECT scope_id, 0 AS q, CAST(atom_id AS VARCHAR) AS pid, atom_id, x, y, z FROM a WHERE element = 'ZN'), s1 AS (SELECT scope_id, 1 AS q, chain || res_seq AS pid, atom_id, x, y, z FROM a WHERE res_name = 'CYS'),
    s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1), k AS (SELECT scope_id, q, count(DISTINCT pid) AS n FROM s GROUP BY ALL), v AS (SELECT scope_id, arg_min(q, n * 10 + q) AS q FROM k GROUP BY scope_id HAVING count(*) = 2),
    p0 AS (SELECT s.* FROM s JOIN v USING (scope_id, q)), m AS (SELECT p.scope_id, p.pid, q.q, q.pid AS other FROM p0 p JOIN s q ON p.scope_id = q.scope_id AND {NEAR} < 144 GROUP BY ALL),
    ok AS (SELECT scope_id, pid FROM m GROUP BY ALL HAVING count(DISTINCT q) = 2), z AS (SELECT m.scope_id, m.pid, s.atom_id FROM m JOIN ok USING (scope_id, pid) JOIN s ON s.scope_id = m.scope_id AND s.q = m.q AND s.pid = m.other)
    SELECT DISTINCT scope_id, atoms FROM (SELECT scope_id, pid, {IDS} FROM z GROUP BY scope_id, pid)""",
)
add("geo9_nearest_distance", lambda s: s.residues_of("HIS").nearest_distance_to(s.atoms_of("ZN")).select("scope_id", F.array_join("atom_ids", "-").alias("atoms"), F.round("distance", 6).alias("distance")), f""", {HIS}, {CENTER}, w AS (SELECT p.scope_id, p.pid, arg_min(q.atom_id, ({NEAR}, q.atom_id)) AS o FROM c p JOIN a q ON p.scope_id = q.scope_id AND q.element = 'ZN' GROUP BY ALL),
  g AS (SELECT scope_id, pid, {IDS} FROM h GROUP BY scope_id, pid) SELECT p.scope_id, any_value(g.atoms) AS atoms, round(sqrt(min({NEAR})), 6) AS distance FROM h p JOIN w USING (scope_id, pid) JOIN g USING (scope_id, pid) JOIN a q ON q.scope_id = p.scope_id AND q.atom_id = w.o GROUP BY p.scope_id, p.pid""")
add("geo10_distance", lambda s: s.atoms_of("ZN").distance_to(s.residues_of("CYS")).select("scope_id", F.array_join("atom_ids", "-").alias("atoms"), F.array_join("other_ids", "-").alias("others"), F.round("distance", 6).alias("distance")), f", o AS (SELECT {RES}, array_to_string(list_sort(list(atom_id)), '-') AS others FROM a WHERE res_name = 'CYS' GROUP BY {RES}) SELECT p.scope_id, CAST(p.atom_id AS VARCHAR) AS atoms, o.others, round(sqrt(min({NEAR})), 6) AS distance FROM a p JOIN a q ON p.scope_id = q.scope_id AND p.element = 'ZN' AND q.res_name = 'CYS' JOIN o ON o.scope_id = q.scope_id AND o.chain = q.chain AND o.res_seq = q.res_seq GROUP BY p.scope_id, p.atom_id, o.others")
add("geo11_nearest_atoms", lambda s: s.atoms_of("ZN").nearest_atoms(4, 10).select("scope_id", F.get("atom_ids", F.lit(0)).alias("zn"), "atom_id", F.col("rank").cast("long").alias("rank")), f"SELECT scope_id, zn, atom_id, rank FROM (SELECT p.scope_id, p.atom_id AS zn, q.atom_id, row_number() OVER (PARTITION BY p.scope_id, p.atom_id ORDER BY {NEAR}, q.atom_id) AS rank FROM a p JOIN a q ON p.scope_id = q.scope_id AND p.element = 'ZN' AND {NEAR} <= 100) WHERE rank <= 4")

# bond family
G = "SELECT DISTINCT scope_id, atoms FROM (SELECT scope_id, pid, {} FROM {} GROUP BY scope_id, pid)"
patterns("top1_connected_atoms", lambda s: s.atoms_of("S").connected_atoms(2), f", g0 AS (SELECT scope_id, atom_id AS pid, atom_id FROM a WHERE element = 'S'), g1 AS (SELECT * FROM g0 UNION SELECT g0.scope_id, pid, b FROM g0 JOIN bb ON bb.scope_id = g0.scope_id AND bb.a = g0.atom_id), g2 AS (SELECT * FROM g1 UNION SELECT g1.scope_id, pid, b FROM g1 JOIN bb ON bb.scope_id = g1.scope_id AND bb.a = g1.atom_id) {G.format(IDS, 'g2')}", bonds=True)
patterns("top2_connected_residues", lambda s: s.atoms_of("S").connected_residues(1), f", rb AS (SELECT DISTINCT bb.scope_id, p.chain, p.res_seq, q.chain AS c2, q.res_seq AS r2 FROM bb JOIN a p ON p.scope_id = bb.scope_id AND p.atom_id = bb.a JOIN a q ON q.scope_id = bb.scope_id AND q.atom_id = bb.b), g0 AS (SELECT scope_id, atom_id AS pid, chain, res_seq FROM a WHERE element = 'S'), g1 AS (SELECT * FROM g0 UNION SELECT g0.scope_id, pid, c2, r2 FROM g0 JOIN rb USING ({RES})), g2 AS (SELECT g1.scope_id, pid, a.atom_id FROM g1 JOIN a USING ({RES})) {G.format(IDS, 'g2')}", bonds=True)
patterns("top3_path", lambda s: s.atoms_of("S").path(s.atoms_of("C"), s.atoms_of("C")), ", t AS (SELECT p.scope_id, list_sort([p.a, p.b, q.b]) AS ids FROM bb p JOIN bb q ON p.scope_id = q.scope_id AND p.b = q.a AND q.b <> p.a JOIN a s ON s.scope_id = p.scope_id AND s.atom_id = p.a AND s.element = 'S' JOIN a c ON c.scope_id = p.scope_id AND c.atom_id = p.b AND c.element = 'C' JOIN a d ON d.scope_id = p.scope_id AND d.atom_id = q.b AND d.element = 'C') SELECT DISTINCT scope_id, array_to_string(ids, '-') AS atoms FROM t", bonds=True)
patterns("top4_star", lambda s: s.atoms_of("O").star(s.atoms_of("C"), s.atoms_of("C")), ", t AS (SELECT p.scope_id, list_sort([p.a, p.b, q.b]) AS ids FROM bb p JOIN bb q ON p.scope_id = q.scope_id AND p.a = q.a AND q.b <> p.b JOIN a s ON s.scope_id = p.scope_id AND s.atom_id = p.a AND s.element = 'O' JOIN a c ON c.scope_id = p.scope_id AND c.atom_id = p.b AND c.element = 'C' JOIN a d ON d.scope_id = p.scope_id AND d.atom_id = q.b AND d.element = 'C') SELECT DISTINCT scope_id, array_to_string(ids, '-') AS atoms FROM t", bonds=True)
BONDED = f", h AS (SELECT * FROM a WHERE res_name = 'HIS'), t AS (SELECT DISTINCT h.scope_id, h.chain, h.res_seq FROM h JOIN bb ON bb.scope_id = h.scope_id AND bb.a = h.atom_id JOIN a q ON q.scope_id = bb.scope_id AND q.atom_id = bb.b AND (q.chain <> h.chain OR q.res_seq <> h.res_seq)) SELECT scope_id, {IDS} FROM h WHERE ({RES}) {{}} (SELECT {RES} FROM t) GROUP BY {RES}"
patterns("top5_connected_to", lambda s: s.residues_of("HIS").connected_to(s.residues_of()), BONDED.format("IN"), bonds=True)
patterns("top6_not_connected_to", lambda s: s.residues_of("HIS").not_connected_to(s.residues_of("ARG")), BONDED.format("NOT IN").replace("q.res_seq <> h.res_seq)", "q.res_seq <> h.res_seq) AND q.res_name = 'ARG'"), bonds=True)
add("top8_bonded_by_type", lambda s: s.residues_of("HIS").bonded_with(s.residues_of(), [1], exclusive=True).select("scope_id", F.array_join("atom_ids", "-").alias("atoms"), F.array_join("other_ids", "-").alias("others")), f", g AS (SELECT {RES}, any_value(res_name) AS rn, {IDS} FROM a GROUP BY {RES}) SELECT DISTINCT g.scope_id, g.atoms, k.atoms AS others FROM g JOIN a p USING ({RES}) JOIN bb ON bb.scope_id = p.scope_id AND bb.a = p.atom_id AND bond_type = 1 JOIN a q ON q.scope_id = bb.scope_id AND q.atom_id = bb.b JOIN g k ON k.scope_id = q.scope_id AND k.chain = q.chain AND k.res_seq = q.res_seq WHERE g.rn = 'HIS' AND (g.chain, g.res_seq) <> (k.chain, k.res_seq)", bonds=True)
