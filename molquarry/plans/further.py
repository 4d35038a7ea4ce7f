"""Registered queries of the index export, snapshots, isolated and limited runs, models, entries and partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from molquarry.functions import values
from molquarry.operators import channels, charges, index, service, structure
from molquarry.operators import charges as Q
from molquarry.operators import validation as V
from molquarry.operators.core import Scope
from molquarry.operators.tables import cut, shared_dir
from molquarry.plans.analysis import MOTIFS, flagged, motif_tables, parametrised
from molquarry.plans.database import HIS, TWO, _structures
from molquarry.plans.more import bonds_of
from molquarry.sources import readers
from molquarry.sources.fixtures import SQL_ATOMS, SQL_BONDS, scope, table

QUERIES, ORACLE = {}, {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def folder(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# models of the first structure: the first residue of each name in chain A
def models(s, d):
    c = scope(s, d)
    first = c.atoms.filter("chain = 'A'").join(c.atoms.agg(F.min("scope_id").alias("scope_id")), "scope_id")
    one = first.groupBy("res_name").agg(F.min("res_seq").alias("res_seq"))
    at = first.join(one, ["res_name", "res_seq"])
    atoms = at.select(F.col("res_name").alias("model"), F.col("pos").alias("atom_id"), "name", "element", "x", "y", "z", F.col("pos").isin(2, 4).alias("is_chiral"))
    inside = c.bonds.join(at.select("scope_id", F.col("atom_id").alias("a"), F.col("res_name").alias("model"), F.col("pos").alias("p")), ["scope_id", "a"]).join(at.select("scope_id", F.col("atom_id").alias("b"), F.col("res_name").alias("_m"), F.col("pos").alias("q")), ["scope_id", "b"]).filter("model = _m")
    return readers.model_tables(atoms, inside.select("model", F.col("p").alias("a"), F.col("q").alias("b"), "bond_type"), ["ZN"])


MODELS = f"WITH {SQL_ATOMS}, f0 AS (SELECT * FROM a WHERE chain = 'A' AND scope_id = (SELECT min(scope_id) FROM a)), f1 AS (SELECT res_name, min(res_seq) AS res_seq FROM f0 GROUP BY 1), f AS (SELECT f0.* FROM f0 JOIN f1 USING (res_name, res_seq))"
text = lambda c: F.array_join(c, ",").alias(c)
add("src6_model_rings", lambda s, d: models(s, d)["rings"].groupBy("model").agg(F.sum("n").alias("n")), f"{MODELS} SELECT res_name AS model, CAST(1 AS BIGINT) AS n FROM f WHERE res_name <> 'HOH' GROUP BY 1 HAVING count(*) = 8")
add("src6_model_classes", lambda s, d: models(s, d)["classes"].select("model", text("carbon"), text("metal"), text("not_single")), f"{MODELS}, c AS (SELECT * FROM f WHERE pos IN (2, 4)), n AS (SELECT res_name, count(*) AS k FROM f GROUP BY 1) SELECT c.res_name AS model, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (element = 'C'), '') AS carbon, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (element = 'ZN'), '') AS metal, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (pos = 2 AND k > 3), '') AS not_single FROM c JOIN n USING (res_name) GROUP BY 1")


def in_order(s, d):
    a = scope(s, d).atoms.withColumnRenamed("scope_id", "structure_id")
    given = a.filter("not (structure_id % 7 = 0 and atom_id = 10)").select("structure_id", F.col("atom_id").alias("position"), F.when((F.col("structure_id") % 5 == 0) & (F.col("atom_id") == 3), "X").otherwise(F.col("element")).alias("element"), (F.col("atom_id") / 4).alias("charge"))
    good, bad = readers.attach_charges_in_order(a, given)
    return good.groupBy("structure_id").agg(F.count("*").alias("n"), F.sum("charge").alias("total")).withColumn("error", F.lit("none")).unionByName(bad.withColumns({"n": F.lit(0).cast("long"), "total": F.lit(0.0)}))


add("src7_in_order", in_order, f"WITH {SQL_ATOMS} SELECT scope_id AS structure_id, CASE WHEN scope_id % 7 = 0 OR scope_id % 5 = 0 THEN 0 ELSE count(*) END AS n, CASE WHEN scope_id % 7 = 0 OR scope_id % 5 = 0 THEN 0.0 ELSE sum(atom_id / 4.0) END AS total, CASE WHEN scope_id % 7 = 0 THEN 'count' WHEN scope_id % 5 = 0 THEN 'element' ELSE 'none' END AS error FROM a GROUP BY scope_id")

# the entry database
entries = lambda s, d: index.build_index(Scope(scope(s, d).atoms)).withColumns({"size_in_bytes": F.col("atom_count") * 80, "released": F.expr("date_add(date'2000-01-01', cast(scope_id * 37 as int))")})
add("exp1_export", lambda s, d: index.export_rows(entries(s, d)).select("Id", "SizeInBytes", "AtomCount", "ResidueCount", "ReleaseDate", "Authors", "AtomTypes", "ResidueTypes"), f"WITH {SQL_ATOMS} SELECT CAST(scope_id AS VARCHAR) AS Id, count(*) * 80 AS SizeInBytes, count(*) AS AtomCount, count(DISTINCT (chain, res_seq)) AS ResidueCount, strftime(DATE '2000-01-01' + CAST(scope_id * 37 AS INT), '%Y-%-m-%-d') AS ReleaseDate, CAST(NULL AS VARCHAR) AS Authors, array_to_string(list_sort(list(DISTINCT element)), '¦') AS AtomTypes, array_to_string(list_sort(list(DISTINCT res_name)), '¦') AS ResidueTypes FROM a GROUP BY scope_id")
add("dbx3_reindex", lambda s, d: (lambda r: r[0].join(r[1], "scope_id").select("scope_id", "action", "atom_count"))(index.reindex(Scope(scope(s, d).atoms))), f"WITH {SQL_ATOMS} SELECT scope_id, 'Updated' AS action, count(*) AS atom_count FROM a GROUP BY 1")


def frozen(s, d):
    """A snapshot of small parts stays as it was, though the index has lost half of them."""
    path, parts = folder(s, "snapshot"), table(s, d, "part")
    index.freeze(index.select_entries(parts, [values.int_filter(F.col("p_size"), "<", 20)]), path)
    later = parts.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("_k"))
    old = index.frozen(s, path)
    return old.join(later, F.col("p_partkey") == F.col("_k"), "left").select("p_partkey", "p_name", F.col("_k").isNotNull().alias("still_there"))


add("view2_snapshot", frozen, "SELECT p_partkey, p_name, p_partkey % 2 = 0 AS still_there FROM part WHERE p_size < 20")


def versions(s, d):
    path, kept, parts = folder(s, "versions"), folder(s, "views"), table(s, d, "part").withColumn("atom_count", F.col("p_size"))
    view = lambda: index.view_of_version(s, path, "economy", [values.contains_word(F.array("p_type"), "economy")], kept)
    index.write_version(parts.filter("p_size < 30"), path)
    first = view()
    index.write_version(parts, path)
    return first.unionByName(view()).unionByName(view()).distinct()


add("view1_versions", versions, "SELECT CAST(1 AS INT) AS of_version, count(*) AS n_entries, CAST(ceil(avg(p_size)) AS BIGINT) AS average_atoms FROM part WHERE p_type = 'ECONOMY' AND p_size < 30 UNION ALL SELECT 2, count(*), CAST(ceil(avg(p_size)) AS BIGINT) FROM part WHERE p_type = 'ECONOMY'")
add("meta2_revisions", lambda s, d: table(s, d, "supplier").select(values.year_of(F.expr("date_add(date'2001-05-05', cast(s_suppkey * 41 as int))")).alias("latest_revision_year")).groupBy("latest_revision_year").agg(F.count("*").alias("n")), "SELECT CAST(year(DATE '2001-05-05' + CAST(s_suppkey * 41 AS INT)) AS INT) AS latest_revision_year, count(*) AS n FROM supplier GROUP BY 1")


# the batch service
def apart(s, d):
    rows, errors = service.run_apart({"his": TWO["his"], "broken": lambda c: c.atoms_of("C").filter(F.col("no_such_column") > 0), "zinc": lambda c: c.atoms_of("ZN")}, scope(s, d))
    return rows.groupBy("query_id").agg(F.count("*").alias("patterns"), F.lit("None").alias("error_type")).unionByName(errors.select("query_id", F.lit(0).cast("long").alias("patterns"), "error_type"))


add("svc1_apart", apart, f"WITH {SQL_ATOMS}, h AS ({HIS}) SELECT 'his' AS query_id, count(*) AS patterns, 'None' AS error_type FROM h UNION ALL SELECT 'zinc', count(*), 'None' FROM a WHERE element = 'ZN' UNION ALL SELECT 'broken', 0, 'Computation'")


def warned(s, d):
    c = scope(s, d)
    w = c.atoms.filter("atom_id = 0").select("scope_id", F.explode(F.array(F.struct(F.lit(None).cast("string").alias("query_id"), F.when(F.col("scope_id") % 3 == 0, "Reader").alias("kind")), F.struct(F.lit("his").alias("query_id"), F.when(F.col("scope_id") % 4 == 0, "Computation").alias("kind")))).alias("w")).select("scope_id", "w.query_id", "w.kind", F.lit("said").alias("message")).filter("kind is not null")
    return service.structure_rows(service.run(TWO, c), _structures(s, d), warnings=w)


PER2 = f"h AS ({HIS}), n AS (SELECT 'his' AS query_id, scope_id, count(*) AS pattern_count FROM h GROUP BY scope_id), z AS (SELECT 'zinc' AS query_id, scope_id FROM a WHERE element = 'ZN' GROUP BY scope_id), r AS (SELECT query_id, scope_id FROM n UNION ALL SELECT query_id, scope_id FROM z)"
add("svc3_warnings", lambda s, d: warned(s, d).select("query_id", "scope_id", "reader_warnings", "computation_warnings"), f"WITH {SQL_ATOMS}, {PER2} SELECT query_id, scope_id, CAST(scope_id % 3 = 0 AS BIGINT) AS reader_warnings, CAST(scope_id % 4 = 0 AND query_id = 'his' AS BIGINT) AS computation_warnings FROM r")
add("svc5_warnings", lambda s, d: service.query_summary(warned(s, d)).select("query_id", "structures", "with_warnings", "with_reader_warnings", "with_computation_warnings"), f"WITH {SQL_ATOMS}, {PER2} SELECT query_id, count(*) AS structures, count(*) FILTER (scope_id % 3 = 0 OR (scope_id % 4 = 0 AND query_id = 'his')) AS with_warnings, count(*) FILTER (scope_id % 3 = 0) AS with_reader_warnings, count(*) FILTER (scope_id % 4 = 0 AND query_id = 'his') AS with_computation_warnings FROM r GROUP BY 1")
add("svc6_limited", lambda s, d: (lambda r: r[0].groupBy("query_id").agg(F.sum("atom_count").alias("atoms")).join(r[1], "query_id"))(service.run_limited({"his": TWO["his"], "few": lambda c: c.residues_of("HIS").execute_if(c.atoms.filter("scope_id = 1"))}, scope(s, d), 40, 1_000_000)), f"WITH {SQL_ATOMS}, h AS ({HIS}), w AS (SELECT *, row_number() OVER (ORDER BY scope_id, ids) AS k FROM h) SELECT 'his' AS query_id, CAST(sum(n) FILTER (k <= 40) AS BIGINT) AS atoms, count(*) AS patterns, least(40, count(*)) AS shown, CASE WHEN count(*) > 40 THEN 'patterns' END AS warning FROM w UNION ALL SELECT 'few', CAST(sum(n) AS BIGINT), count(*), count(*), NULL FROM h WHERE scope_id = 1")

# validation
LAYERED = f"""WITH {SQL_ATOMS}, {SQL_BONDS}, m AS (SELECT *, min(atom_id) OVER (PARTITION BY scope_id, chain, res_seq) AS motif FROM a WHERE res_name IN ('HIS', 'NAG')),
g0 AS (SELECT scope_id, res_name, motif, atom_id FROM m), g1 AS (SELECT * FROM g0 UNION SELECT g0.scope_id, res_name, motif, bb.b FROM g0 JOIN bb ON bb.scope_id = g0.scope_id AND bb.a = g0.atom_id),
g AS (SELECT * FROM g1 UNION SELECT g1.scope_id, res_name, motif, bb.b FROM g1 JOIN bb ON bb.scope_id = g1.scope_id AND bb.a = g1.atom_id)"""
# each residue of a model's name and all within two bonds, named by the residue's least atom
add("val2_motifs", lambda s, d: V.extract_motifs(scope(s, d), s.createDataFrame([("HIS", 8), ("NAG", 8), ("GLY", 2), ("CYS", 9)], "model string, n_atoms int"), ["cys"], 3).select("scope_id", "model", "motif", F.array_join("atom_ids", "-").alias("atoms")), f"{LAYERED} SELECT scope_id, res_name AS model, motif, string_agg(CAST(atom_id AS VARCHAR), '-' ORDER BY atom_id) AS atoms FROM g GROUP BY ALL")


def grown_motifs(s, d):
    """Motifs of several residues: motif_id, model and the atoms' columns."""
    c = scope(s, d)
    motifs = V.extract_motifs(c, s.createDataFrame([("HIS", 8), ("NAG", 8)], "model string, n_atoms int"), [])
    atoms = motifs.select("scope_id", "model", F.concat_ws(":", F.col("scope_id").cast("string"), F.col("motif").cast("string")).alias("motif_id"), F.explode("atom_ids").alias("atom_id"))
    return atoms.join(c.atoms, ["scope_id", "atom_id"])


# the neighbours' atoms bear the model's names too, and are no partners
add("val3_several_residues", lambda s, d: V.pair_by_name(grown_motifs(s, d), motif_tables(s, d)[1]).select("motif_id", "model", "model_atom", "motif_atom"), f"{LAYERED}, md AS (SELECT unnest(range(8)) AS pos, unnest(['N','C','C','O','C','C','C','C']) AS el) SELECT scope_id || ':' || motif AS motif_id, res_name AS model, pos AS model_atom, atom_id AS motif_atom FROM m JOIN md USING (pos) WHERE element = el")
add("val23_outputs", lambda s, d: (lambda t, f: V.outputs(f, t[2], t[3]).groupBy("model", "output").agg(F.count_distinct("motif_id").alias("motifs"), F.count("*").alias("atoms"), F.sum("place").cast("long").alias("places")))(motif_tables(s, d), flagged(s, d)[0]), f"{MOTIFS}, k AS (SELECT m.*, CASE WHEN NOT dg THEN 'Validated' END AS st, pos <> 7 OR res_seq % 2 = 0 AS paired FROM m JOIN e USING (motif_id)), o AS (SELECT model_, 'matched' AS output, motif_id, pos AS place FROM (SELECT *, res_name AS model_ FROM k) WHERE st = 'Validated' AND paired UNION ALL SELECT res_name, CASE WHEN st = 'Validated' THEN 'motives' ELSE 'notvalidated' END, motif_id, NULL FROM k) SELECT model_ AS model, output, count(DISTINCT motif_id) AS motifs, count(*) AS atoms, CAST(sum(place) AS BIGINT) AS places FROM o GROUP BY ALL")
add("val18_atom_counts", lambda s, d: V.custom_aggregate(flagged(s, d)[0], [], ["HIS"], ["Missing"], scope(s, d).atoms.filter("scope_id % 3 <> 0").groupBy(F.col("scope_id").cast("string").alias("structure_id")).agg(F.count("*").alias("atom_count")))[0].select("structure_id", "analyzed", "atom_count"), f"{MOTIFS}, h AS (SELECT structure_id, count(*) AS analyzed FROM e WHERE model = 'HIS' GROUP BY 1), n AS (SELECT CAST(scope_id AS VARCHAR) AS structure_id, count(*) AS k FROM a WHERE scope_id % 3 <> 0 GROUP BY 1) SELECT structure_id, CAST(sum(analyzed) AS BIGINT) AS analyzed, CAST(sum(coalesce(k, 0)) AS BIGINT) AS atom_count FROM h LEFT JOIN n USING (structure_id) GROUP BY ROLLUP (structure_id)")


def renamed(s, d):
    """The motifs, in which atom 5 of every fourth residue is named like atom 6."""
    motifs, models_, atoms, pairing = motif_tables(s, d)
    first = atoms.groupBy("motif_id").agg(F.min("atom_id").alias("_f"))
    atoms = atoms.join(first, "motif_id").withColumn("name", F.when((F.col("atom_id") - F.col("_f") == 5) & (F.col("res_seq") % 4 == 0), F.concat("element", F.lit("6"))).otherwise(F.col("name"))).drop("_f")
    return motifs, models_, atoms, pairing


CLASSES = [("HIS", "C5", "x"), ("HIS", "C6", "x"), ("NAG", "C5", "x"), ("NAG", "C6", "y")]
LOOSE = [("HIS", "C5", "x"), ("NAG", "C5", "x"), ("NAG", "C6", "x")]
classes = lambda s, rows: s.createDataFrame(rows, "model string, name string, class string")
add("val8_names", lambda s, d: (lambda t: V.name_mismatches(t[3], t[2], t[1], classes(s, CLASSES), classes(s, LOOSE)).select("motif_id", "model_atom", "motif_name", "equivalent", "equivalent_ignoring_bonds"))(renamed(s, d)), f"{MOTIFS} SELECT motif_id, pos AS model_atom, element || '6' AS motif_name, res_name = 'HIS' AS equivalent, res_name = 'NAG' AS equivalent_ignoring_bonds FROM m WHERE pos = 5 AND res_seq % 4 = 0 AND element = 'C'")
add("val9_duplicates", lambda s, d: (lambda t: V.naming(V.main_atoms(t[3], t[2]), t[1], t[0]).select("motif_id", F.col("duplicate_names").cast("long").alias("duplicate_names")))(renamed(s, d)), f"{MOTIFS}, r AS (SELECT motif_id, CASE WHEN pos = 5 AND res_seq % 4 = 0 THEN element || '6' ELSE name END AS name FROM m), g AS (SELECT motif_id, name, count(*) AS n FROM r GROUP BY ALL) SELECT motif_id, count(*) FILTER (n > 1) AS duplicate_names FROM g GROUP BY 1")
add("val9_non_isomorphic", lambda s, d: (lambda t: V.non_isomorphic(t[0], t[3], t[1], t[4], t[2]))(bonds_of(s, d)), f"{MOTIFS} SELECT motif_id FROM m WHERE res_seq % 3 = 0 AND ((pos = 2 AND element = 'C') OR (pos = 3 AND element = 'O')) GROUP BY motif_id HAVING count(*) = 2 UNION SELECT motif_id FROM m WHERE 1 = 0")


def borrowed(s, d):
    """Pairs of which model atom 7 lies in the next residue's atom 0, where there is one: a foreign atom with its own bonds."""
    motifs, models_, atoms, pairing = motif_tables(s, d)
    c = scope(s, d)
    ends = atoms.filter("name like '%1'").select("motif_id", "model", F.split("motif_id", ":")[0].cast("long").alias("scope_id"), F.col("atom_id").alias("a"))
    out = ends.join(c.both_ways, ["scope_id", "a"]).select("motif_id", "model", F.col("scope_id"), F.col("b").alias("atom_id")).join(c.atoms.filter("pos = 0").select("scope_id", "atom_id", "name", "element", "chain", "res_seq", "res_name"), ["scope_id", "atom_id"]).join(atoms.select("motif_id", "atom_id"), ["motif_id", "atom_id"], "left_anti")
    extra = out.select("motif_id", "model", F.lit(7).alias("model_atom"), F.col("atom_id").alias("motif_atom"))
    pairing = pairing.filter("model_atom <> 7").unionByName(extra)
    atoms = atoms.unionByName(out.select(*atoms.columns))
    bonds = s.createDataFrame([], "motif_id string, a int, b int, bond_type int").unionByName(out.select("motif_id", F.col("atom_id").alias("a"), (F.col("atom_id") - 7).alias("b"), F.lit(1).alias("bond_type"))).unionByName(out.select("motif_id", F.col("atom_id").alias("a"), (F.col("atom_id") - 6).alias("b"), F.lit(1).alias("bond_type")).filter("a % 3 = 0"))
    return pairing, atoms, bonds


add("val9_non_boundary", lambda s, d: V.non_boundary(*borrowed(s, d)), f"{MOTIFS}, x AS (SELECT DISTINCT m.motif_id, n.atom_id AS motif_atom FROM m JOIN a n ON n.scope_id = m.scope_id AND n.chain = m.chain AND n.res_seq = m.res_seq + 1 AND n.pos = 0 WHERE m.pos = 1) SELECT x.motif_id, motif_atom FROM x WHERE motif_atom % 3 = 0")


def turned(s, d):
    """Chirality of atom 2 with its neighbours 1, 3 and 7, against a model with fixed places."""
    motifs, models_, atoms, pairing = motif_tables(s, d)
    c = scope(s, d)
    xyz = c.atoms.select(F.col("scope_id").alias("_s"), "atom_id", "x", "y", "z")
    atoms = atoms.withColumn("_s", F.split("motif_id", ":")[0].cast("long")).join(xyz, ["_s", "atom_id"]).drop("_s")
    places = [(m, i, f"{e}{i}", e, i == 2, *p) for m in ("HIS", "NAG") for i, (e, p) in enumerate(zip("NCCOCCCC", [(9, 9, 9), (1, 0, 0), (0, 0, 0), (0, 1, 0), (9, 0, 0), (0, 9, 0), (0, 0, 9), (0, 0, 1)], strict=True))]
    model = s.createDataFrame([(*r[:5], *map(float, r[5:])) for r in places], "model string, atom_id int, name string, element string, is_chiral boolean, x double, y double, z double")
    bonds = s.createDataFrame([(m, 2, k) for m in ("HIS", "NAG") for k in (1, 3, 7)], "model string, a int, b int")
    return V.chirality_mismatches(pairing, atoms, model, bonds)


AT = ", ".join(f"max(CASE WHEN pos = {k} THEN {c} END) AS {c}{k}" for k in (1, 2, 3, 7) for c in "xyz")
DET = "((x1 - x2) * ((y3 - y2) * (z7 - z2) - (z3 - z2) * (y7 - y2)) - (y1 - y2) * ((x3 - x2) * (z7 - z2) - (z3 - z2) * (x7 - x2)) + (z1 - z2) * ((x3 - x2) * (y7 - y2) - (y3 - y2) * (x7 - x2)))"
add("val10_chirality", turned, f"{MOTIFS}, t AS (SELECT motif_id, {AT} FROM m WHERE pos <> 7 OR res_seq % 2 = 0 GROUP BY motif_id) SELECT motif_id, 2 AS model_atom FROM t WHERE {DET} <= 0")
add("val11_alike", lambda s, d: (lambda t: V.wrong_bonds(t[0], t[1], t[2], V.alike_atoms(t[0], t[3], t[4], t[1], t[2])).groupBy("motif_id", "kind").agg(F.count("*").alias("n")))(bonds_of(s, d)), f"{MOTIFS}, k AS (SELECT motif_id, max(res_seq) AS r, list(pos) AS ps FROM m WHERE pos <> 7 OR res_seq % 2 = 0 GROUP BY 1) SELECT motif_id, 'Missing' AS kind, count(*) AS n FROM k WHERE r % 3 = 0 AND list_contains(ps, 2) AND list_contains(ps, 3) GROUP BY ALL")
add("val13_entries", lambda s, d: flagged(s, d)[0].select("motif_id", "state", "analyzed", "missing", "substitutions", "unmatched_names"), f"{MOTIFS}, w AS (SELECT motif_id, pos, el || pos AS name FROM (SELECT DISTINCT motif_id FROM m), md), u AS (SELECT w.motif_id, count(*) FILTER (m.name IS NULL) AS n FROM w LEFT JOIN m USING (motif_id, name) GROUP BY 1) SELECT motif_id, CASE WHEN dg THEN 'Degenerate' ELSE 'Validated' END AS state, true AS analyzed, CASE WHEN dg THEN 0 ELSE missing END AS missing, CASE WHEN dg THEN 0 ELSE substitutions END AS substitutions, CASE WHEN dg THEN 0 ELSE u.n END AS unmatched_names FROM e JOIN u USING (motif_id)")
add("val17_names", lambda s, d: V.summaries(flagged(s, d)[0].withColumnRenamed("analyzed", "_a"), "model", ["Missing"], "structure_id"), f"{MOTIFS} SELECT model, count(*) AS analyzed, count(*) FILTER (dg OR missing > 0) AS \"Missing\", string_agg(DISTINCT structure_id, ',' ORDER BY structure_id) AS structure_id_names FROM e GROUP BY ROLLUP (model)")
said = lambda s, d, k: table(s, d, "supplier").select(F.col("s_suppkey").alias("structure_id"), F.when(F.col("s_suppkey") % k == 0, F.lit(f"m{k}")).alias("message"))
add("val20_messages", lambda s, d: V.merge_messages([said(s, d, 2), said(s, d, 3)]), "SELECT s_suppkey AS structure_id, CASE WHEN s_suppkey % 3 = 0 THEN 'm3' ELSE 'm2' END AS message FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
add("val22_errors", lambda s, d: V.report(motif_tables(s, d)[0], table(s, d, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").cast("string").alias("structure_id"), F.lit("reader").alias("error"))), f"{MOTIFS}, r AS (SELECT structure_id, model, 1 AS k, NULL AS error FROM e UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, 0, 'reader' FROM supplier WHERE s_suppkey % 4 = 0) SELECT structure_id, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models, CAST(sum(k) AS BIGINT) AS motifs, CASE WHEN grouping(structure_id) = 1 THEN CAST(count(DISTINCT CASE WHEN error IS NOT NULL THEN structure_id END) AS VARCHAR) ELSE min(error) END AS error FROM r GROUP BY ROLLUP (structure_id)")

# charges, channels, perception
add("chg7_partitions", lambda s, d: Q.partition(scope(s, d), lambda c: c.chains(), lambda c: c.residues_of("HIS")).select("scope_id", F.col("group_no").cast("long").alias("group_no"), F.array_join("atom_ids", "-").alias("atoms")), f"WITH {SQL_ATOMS}, g AS (SELECT scope_id, chain, min(atom_id) AS f, string_agg(CAST(atom_id AS VARCHAR), '-' ORDER BY atom_id) AS atoms FROM a WHERE res_name = 'HIS' GROUP BY ALL) SELECT scope_id, row_number() OVER (PARTITION BY scope_id ORDER BY f) - 1 AS group_no, atoms FROM g UNION ALL SELECT scope_id, 0, string_agg(CAST(atom_id AS VARCHAR), '-' ORDER BY atom_id) FROM a WHERE scope_id NOT IN (SELECT scope_id FROM g) GROUP BY scope_id")
MEANS = [("ARG", -4.5, -0.5, 52.0, -1.5, -2.0, 0.5), ("GLY", -0.4, 0.25, 0.0, 0.5, 0.25, 0.75), ("ASN", -3.5, -0.75, 3.5, -2.0, -2.5, 1.0), ("BACKBONE", 0.0, 0.0, 0.0, -0.75, -1.0, 0.25)]
COLUMNS = "res_name, hydropathy, hydrophobicity, polarity, log_p, log_d, log_s"
add("chn8_means", lambda s, d: (lambda p: channels.property_means(scope(s, d).residues.select("scope_id", "res_name", (F.col("res_seq") % 2 == 0).alias("side_chain")), p.filter("res_name <> 'BACKBONE'"), p, ["scope_id"]))(s.createDataFrame(MEANS, ", ".join(f"{c} {'string' if c == 'res_name' else 'double'}" for c in COLUMNS.split(", ")))), f"WITH {SQL_ATOMS}, v({COLUMNS}) AS (VALUES {', '.join(map(str, MEANS))}), g AS (SELECT DISTINCT scope_id, chain, res_seq, res_name FROM a), r AS (SELECT scope_id, v.* EXCLUDE (res_name) FROM g JOIN v USING (res_name) WHERE res_seq % 2 = 0 UNION ALL SELECT scope_id, -0.4, 0.25, 3.5, -0.75, -1.0, 0.25 FROM g WHERE res_seq % 2 = 1) SELECT scope_id, CAST(avg(hydropathy) AS DOUBLE) AS hydropathy, CAST(avg(hydrophobicity) AS DOUBLE) AS hydrophobicity, CAST(avg(polarity) AS DOUBLE) AS polarity, CAST(avg(log_p) AS DOUBLE) AS log_p, CAST(avg(log_d) AS DOUBLE) AS log_d, CAST(avg(log_s) AS DOUBLE) AS log_s FROM r GROUP BY 1")
LIMITS = [("C", "N", 20.0), ("C", None, 12.0), ("N", None, 30.0), ("O", None, 9.0)]
add("str7_bad_known", lambda s, d: structure.bad_known_bonds(scope(s, d), s.createDataFrame(LIMITS, "first string, second string, length double")).select("scope_id", "a", "b"), f"WITH {SQL_ATOMS}, {SQL_BONDS}, l AS (SELECT b.*, least(p.element, q.element) || greatest(p.element, q.element) AS e, p.element AS pe, q.element AS qe, sqrt((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2) AS d FROM b JOIN a p ON p.scope_id = b.scope_id AND p.atom_id = b.a JOIN a q ON q.scope_id = b.scope_id AND q.atom_id = b.b), k AS (SELECT *, CASE WHEN e = 'CN' THEN 20.0 ELSE greatest(CASE pe WHEN 'C' THEN 12.0 WHEN 'N' THEN 30.0 WHEN 'O' THEN 9.0 END, CASE qe WHEN 'C' THEN 12.0 WHEN 'N' THEN 30.0 WHEN 'O' THEN 9.0 END) END AS most FROM l) SELECT scope_id, a, b FROM k WHERE d > most")
add("str14_entities", lambda s, d: structure.polymer_entities(table(s, d, "customer").select((F.col("c_custkey") % 200).alias("scope_id"), F.when(F.col("c_custkey") % 9 < 7, "Protein").alias("polymer_type"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("organism")), ["organism"]).select("scope_id", F.array_join("organism", ",").alias("organisms")), "SELECT c_custkey % 200 AS scope_id, string_agg(DISTINCT 'N' || c_nationkey, ',' ORDER BY 'N' || c_nationkey) AS organisms FROM customer WHERE c_custkey % 9 < 7 GROUP BY 1")

# channels through the atoms of a structure: every seventh atom, half a unit aside, is a node
def bored(s, d):
    at = scope(s, d).atoms.filter("atom_id % 7 = 0")
    node = (F.col("atom_id") / 7).cast("int")
    return at.select(F.col("scope_id").alias("structure_id"), F.col("scope_id").alias("channel_id"), node.alias("node"), node.cast("double").alias("distance"), ((F.col("atom_id") % 13) / 4.0).cast("double").alias("radius"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.25).alias("y"), F.col("z").alias("z"))


on_backbone = lambda: F.col("pos").isin(0, 1, 3)
lined = lambda s, d: channels.channel_layers(channels.linings(bored(s, d), scope(s, d).atoms, on_backbone()))
LINED = f"""WITH {SQL_ATOMS}, nd AS (SELECT scope_id, CAST(atom_id / 7 AS INT) AS node, x + 0.5 AS px, y + 0.25 AS py, z AS pz, (atom_id % 13) / 4.0 AS radius FROM a WHERE atom_id % 7 = 0),
nn AS (SELECT nd.scope_id, node, a.*, row_number() OVER (PARTITION BY nd.scope_id, node ORDER BY (px - x)**2 + (py - y)**2 + (pz - z)**2, atom_id) AS k FROM nd JOIN a ON a.scope_id = nd.scope_id),
rs AS (SELECT scope_id, node, chain, res_seq, arg_min(res_name, atom_id) AS res_name, bool_and(pos IN (0, 1, 3)) AS bb FROM nn WHERE k <= 5 GROUP BY ALL),
ln AS (SELECT nd.scope_id, nd.node, any_value(radius) AS radius, coalesce(string_agg(res_seq || chain, ',' ORDER BY res_seq, chain) FILTER (NOT bb), '') AS sc, coalesce(string_agg(res_seq || chain, ',' ORDER BY res_seq, chain) FILTER (bb), '') AS bk FROM nd JOIN rs ON rs.scope_id = nd.scope_id AND rs.node = nd.node GROUP BY ALL),
l1 AS (SELECT *, CASE WHEN sc IS DISTINCT FROM lag(sc) OVER w OR bk IS DISTINCT FROM lag(bk) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS n FROM ln WINDOW w AS (PARTITION BY scope_id ORDER BY node)),
l2 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY scope_id ORDER BY node) AS BIGINT) AS layer FROM l1),
l3 AS (SELECT scope_id, layer, any_value(sc) AS sc, any_value(bk) AS bk, min(radius) AS radius, min(node) AS first, max(node) AS last FROM l2 GROUP BY ALL),
ly AS (SELECT scope_id AS channel_id, layer, sc, bk, CAST(radius AS DOUBLE) AS radius, CAST(first AS DOUBLE) AS start, CAST(coalesce(lead(first) OVER (PARTITION BY scope_id ORDER BY layer), last) AS DOUBLE) AS "end" FROM l3),
lr AS (SELECT DISTINCT l2.scope_id AS channel_id, layer, chain, res_seq, res_name, bb FROM l2 JOIN rs ON rs.scope_id = l2.scope_id AND rs.node = l2.node)"""
named_residues = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["res_seq"].cast("string"), r["chain"])), ",")
add("chn5_linings", lambda s, d: lined(s, d).select("channel_id", "layer", named_residues("side_chain").alias("sc"), named_residues("backbone").alias("bk"), "radius", "start", "end"), f"{LINED} SELECT * FROM ly")
add("chn6_flow_apart", lambda s, d: channels.channel_flow(lined(s, d)).select("channel_id", "chain", "res_seq", "on_backbone", "first_layer", F.col("position").cast("long").alias("position")), f"{LINED}, f AS (SELECT channel_id, chain, res_seq, bb AS on_backbone, min(layer) AS first_layer FROM lr GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY first_layer, chain, res_seq, on_backbone) AS position FROM f")
# Fixed values of the query: made-up properties of three names, and of the three rows that stand for backbones.
SIX = ["hydropathy", "hydrophobicity", "polarity", "log_p", "log_d", "log_s"]
NAMED = [("HIS", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), ("LYS", -3.5, 0.25, 8.0, 1.5, 2.5, 0.5), ("ALA", 7.0, 6.0, 5.0, 4.0, 3.0, 2.0)]
ASIDE = [("GLY", -0.5, 0.75, 9.0, 9.0, 9.0, 9.0), ("ASN", 9.0, 9.0, 2.25, 9.0, 9.0, 9.0), ("BACKBONE", 9.0, 9.0, 9.0, 1.25, 2.25, 3.25)]
SIX_TYPES = "res_name string, " + ", ".join(f"{c} double" for c in SIX)
means = lambda s, d: channels.channel_means(lined(s, d), s.createDataFrame(NAMED, SIX_TYPES), s.createDataFrame(ASIDE, SIX_TYPES)).select("channel_id", *(F.round(c, 6).alias(c) for c in SIX))
add("chn9_means_apart", means, f"{LINED}, v(res_name, {', '.join(SIX)}) AS (VALUES {', '.join(map(str, NAMED))}), q AS (SELECT channel_id, {', '.join('v.' + c for c in SIX)} FROM lr JOIN v USING (res_name) WHERE NOT bb UNION ALL SELECT channel_id, -0.5, 0.75, 2.25, 1.25, 2.25, 3.25 FROM lr WHERE bb) SELECT channel_id, {', '.join(f'round(avg({c}), 6) AS {c}' for c in SIX)} FROM q GROUP BY 1")

# neighbours and distances without a radius
add("geo11_nearest_unbounded", lambda s, d: scope(s, d).atoms_of("S").nearest_atoms(6).select("scope_id", F.get("atom_ids", F.lit(0)).alias("s"), "atom_id", F.col("rank").cast("long").alias("rank")), f"WITH {SQL_ATOMS} SELECT scope_id, s, atom_id, rank FROM (SELECT p.scope_id, p.atom_id AS s, q.atom_id, row_number() OVER (PARTITION BY p.scope_id, p.atom_id ORDER BY (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2, q.atom_id) AS rank FROM a p JOIN a q ON p.scope_id = q.scope_id AND p.element = 'S') WHERE rank <= 6")
add("geo10_distance_within", lambda s, d: (lambda c: c.residues_of("HIS").distance_to(c.residues_of("CYS"), 9.0).select("scope_id", F.array_min("atom_ids").alias("first"), F.array_min("other_ids").alias("other"), F.round("distance", 6).alias("distance")))(scope(s, d)), f"WITH {SQL_ATOMS}, p AS (SELECT *, min(atom_id) OVER (PARTITION BY scope_id, chain, res_seq) AS r FROM a WHERE res_name IN ('HIS', 'CYS')) SELECT x.scope_id, x.r AS first, y.r AS other, round(sqrt(min((x.x - y.x)**2 + (x.y - y.y)**2 + (x.z - y.z)**2)), 6) AS distance FROM p x JOIN p y ON x.scope_id = y.scope_id AND x.res_name = 'HIS' AND y.res_name = 'CYS' GROUP BY ALL HAVING min((x.x - y.x)**2 + (x.y - y.y)**2 + (x.z - y.z)**2) <= 81")
near_channels = lambda s, d: bored(s, d).withColumn("channel_id", F.concat_ws(":", F.col("structure_id").cast("string"), F.floor(F.col("node") / 30).cast("string")))
add("chn4_all_pairs", lambda s, d: channels.channel_distance(near_channels(s, d)).select("channel_id", "other", F.round("distance", 6).alias("distance")), f"WITH {SQL_ATOMS}, p AS (SELECT scope_id, scope_id || ':' || CAST(floor(atom_id / 7 / 30) AS INT) AS c, atom_id, x, y, z FROM a WHERE atom_id % 7 = 0), n AS (SELECT p.scope_id, p.c, q.c AS o, p.atom_id, min((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2) AS d FROM p JOIN p q ON p.scope_id = q.scope_id AND p.c <> q.c GROUP BY ALL), r AS (SELECT c, o, sqrt(avg(d)) AS d FROM n GROUP BY ALL) SELECT r.c AS channel_id, r.o AS other, round((r.d + b.d) / 2, 6) AS distance FROM r JOIN r b ON b.c = r.o AND b.o = r.c WHERE r.c < r.o")

# similarity over a limit, and the most similar
ALIKE = f"""WITH {SQL_ATOMS}, q AS (SELECT scope_id, chain, res_seq, any_value(res_name) AS res_name FROM a GROUP BY ALL), k AS (SELECT scope_id, chain, res_name, count(*) AS n FROM q GROUP BY ALL), t AS (SELECT scope_id, chain, sum(n) AS t FROM k GROUP BY ALL),
m AS (SELECT p.scope_id, r.scope_id AS other_scope, sum(least(p.n, r.n)) AS i FROM k p JOIN k r ON p.res_name = r.res_name WHERE p.chain = 'A' AND r.chain = 'B' GROUP BY ALL), v AS (SELECT m.scope_id, other_scope, i / (x.t + y.t - i) AS value FROM m JOIN t x ON x.scope_id = m.scope_id AND x.chain = 'A' JOIN t y ON y.scope_id = other_scope AND y.chain = 'B')"""
add("agg6_similar", lambda s, d: (lambda c: c.chains("A").similarity(c.chains("B"), "res_name", 0.9, 9).select("scope_id", "other_scope", "value"))(scope(s, d)), f"{ALIKE} SELECT scope_id, other_scope, round(value, 9) AS value FROM v WHERE value >= 0.9")
add("agg6_most_similar", lambda s, d: (lambda c: c.chains("A").most_similar(c.chains("B"), 3, "res_name").select("scope_id", "other_scope", F.round("value", 9).alias("value"), F.col("rank").cast("long").alias("rank")))(scope(s, d)), f"{ALIKE} SELECT scope_id, other_scope, round(value, 9) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY value DESC, other_scope) AS rank FROM v) WHERE rank <= 3")

# equalised to the last atom: the level of each atom is that of its structure
add("chg4_residuals", lambda s, d: (lambda a: charges.residuals(a, charges.equalise(a, 0.4, 1.0), 0.4).groupBy("scope_id").agg(F.count("*").alias("n"), F.abs(F.round(F.max(F.abs("residual")), 5)).alias("residual")))(cut(parametrised(s, d))), f"WITH {SQL_ATOMS} SELECT scope_id, count(*) AS n, CAST(0.0 AS DOUBLE) AS residual FROM a WHERE element <> 'ZN' GROUP BY 1")
