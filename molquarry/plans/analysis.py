"""Registered queries of charges, superposition, channels, validation and structure perception."""

from __future__ import annotations

from pyspark.sql import functions as F

from molquarry.operators import channels as C
from molquarry.operators import charges as Q
from molquarry.operators import structure as S
from molquarry.operators import superpose as P
from molquarry.operators import validation as V
from molquarry.sources import sinks
from molquarry.sources.fixtures import SQL_ATOMS, SQL_BONDS, scope, table

QUERIES, ORACLE = {}, {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def charges(s, d):
    a = scope(s, d).atoms.select("scope_id", "atom_id")
    return a.withColumn("set_id", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("charge", (F.col("atom_id") * (F.col("set_id") + 3) % 41 - 20) / 100.0)


SQL_CHARGES = "q AS (SELECT scope_id, atom_id, set_id, (atom_id * (set_id + 3) % 41 - 20) / 100.0 AS charge FROM a, (SELECT unnest([0, 1, 2]) AS set_id))"
GROUPS = f"WITH {SQL_ATOMS}, {SQL_CHARGES}, g AS (SELECT scope_id, chain, res_seq, min(res_name) AS rn, set_id, CAST(sum(charge) AS DOUBLE) AS charge, min(charge) AS least, max(charge) AS greatest FROM a JOIN q USING (scope_id, atom_id) GROUP BY ALL)"


def groups(s, d):
    c = scope(s, d)
    return c, Q.group_charges(c.residues_of(), charges(s, d))


add("chg1_multiplicity", lambda s, d: Q.multiplicity(scope(s, d)).groupBy("scope_id", "multiplicity").agg(F.count("*").alias("n")), f"WITH {SQL_ATOMS}, {SQL_BONDS}, m AS (SELECT a.scope_id, a.atom_id, coalesce(max(bond_type), 0) AS multiplicity FROM a LEFT JOIN bb ON bb.scope_id = a.scope_id AND bb.a = a.atom_id GROUP BY ALL) SELECT scope_id, multiplicity, count(*) AS n FROM m GROUP BY ALL")
PARAMS = [(0, "C", 1, 2.4, 0.8), (1, "C", 2, 2.5, 0.7), (2, "N", 1, 2.7, 1.1), (3, "O", 1, 3.0, 1.4), (4, "S", 1, 2.6, 0.9)]


def parametrised(s, d):
    c = scope(s, d)
    at = c.atoms.join(Q.multiplicity(c), ["scope_id", "atom_id"])
    p = s.createDataFrame(PARAMS, "ordinal int, element string, multiplicity int, a double, b double")
    return Q.parameters_of(at.select("scope_id", "atom_id", "element", "multiplicity", "x", "y", "z"), p)


add("chg2_parameters", lambda s, d: parametrised(s, d).groupBy("element", "multiplicity", "a", "b").agg(F.count("*").alias("n")), f"WITH {SQL_ATOMS}, {SQL_BONDS}, m AS (SELECT a.scope_id, a.atom_id, any_value(a.element) AS element, coalesce(max(bond_type), 0) AS multiplicity FROM a LEFT JOIN bb ON bb.scope_id = a.scope_id AND bb.a = a.atom_id GROUP BY ALL) SELECT element, multiplicity, CASE element WHEN 'C' THEN CASE WHEN multiplicity = 2 THEN 2.5 ELSE 2.4 END WHEN 'N' THEN 2.7 WHEN 'O' THEN 3.0 WHEN 'S' THEN 2.6 END AS a, CASE element WHEN 'C' THEN CASE WHEN multiplicity = 2 THEN 0.7 ELSE 0.8 END WHEN 'N' THEN 1.1 WHEN 'O' THEN 1.4 WHEN 'S' THEN 0.9 END AS b, count(*) AS n FROM m GROUP BY ALL")
add("chg3_groups", lambda s, d: (lambda c: Q.parameter_groups([c.atoms_of("ZN"), c.residues_of("HIS"), c.atoms_of()]).groupBy("scope_id", "group_no").agg(F.count("*").alias("n")))(scope(s, d)), f"WITH {SQL_ATOMS} SELECT scope_id, CASE WHEN element = 'ZN' THEN 0 WHEN res_name = 'HIS' THEN 1 ELSE 2 END AS group_no, count(*) AS n FROM a GROUP BY ALL")
add("chg4_equalised", lambda s, d: Q.equalise(parametrised(s, d), 0.4, 1.0).groupBy("scope_id").agg(F.count("*").alias("n"), F.round(F.sum("charge"), 6).alias("total")), f"WITH {SQL_ATOMS} SELECT scope_id, count(*) AS n, 1.0 AS total FROM a WHERE element <> 'ZN' GROUP BY 1")
add("chg5_cutoff", lambda s, d: Q.equalise_cutoff(parametrised(s, d), 0.4, 8.0, 1.0).groupBy("scope_id").agg(F.count("*").alias("n"), F.round(F.sum("charge"), 6).alias("total")), f"WITH {SQL_ATOMS} SELECT scope_id, count(*) AS n, 1.0 AS total FROM a WHERE element <> 'ZN' GROUP BY 1")
QUERIES["chg4_equalised_whole"], ORACLE["chg4_equalised_whole"] = QUERIES["chg4_equalised"], ORACLE["chg4_equalised"]
QUERIES["chg5_cutoff_whole"], ORACLE["chg5_cutoff_whole"] = QUERIES["chg5_cutoff"], ORACLE["chg5_cutoff"]
add("chg6_corrected", lambda s, d: Q.corrected(charges(s, d).filter("set_id = 1"), 2.0).select("scope_id", "atom_id", F.round("charge", 9).alias("charge")), f"WITH {SQL_ATOMS}, {SQL_CHARGES}, t AS (SELECT scope_id, CAST(sum(charge) AS DOUBLE) AS s, count(*) AS n FROM q WHERE set_id = 1 GROUP BY 1) SELECT scope_id, atom_id, round(charge + (2.0 - s) / n, 9) AS charge FROM q JOIN t USING (scope_id) WHERE set_id = 1")
add("chg8_group_charges", lambda s, d: groups(s, d)[1].select("scope_id", "set_id", F.array_min("atom_ids").alias("first"), (F.round("charge", 6) + 0.0).alias("charge"), "least", "greatest"), f"{GROUPS} SELECT g.scope_id, set_id, min(a.atom_id) AS first, round(any_value(charge), 6) + 0.0 AS charge, any_value(least) AS least, any_value(greatest) AS greatest FROM g JOIN a USING (scope_id, chain, res_seq) GROUP BY g.scope_id, g.chain, g.res_seq, set_id")

add("chg9_clusters", lambda s, d: Q.clusters(scope(s, d).residues_of()).groupBy("kind", "cluster").agg(F.count("*").alias("n")), f"WITH {SQL_ATOMS}, g AS (SELECT DISTINCT scope_id, chain, res_seq, res_name AS rn FROM a) SELECT 'Residues' AS kind, rn || '*1' AS cluster, count(*) AS n FROM g GROUP BY rn UNION ALL SELECT 'ChargeClass', CASE WHEN rn IN ('LYS','ARG','HIS') THEN 'Positive' WHEN rn IN ('ASP','GLU') THEN 'Negative' WHEN rn IN ('PHE','TYR','TRP') THEN 'Aromatic' WHEN rn IN ('CYS','SER','THR','ASN','GLN') THEN 'Polar' WHEN rn IN ('HOH','NAG','MAN','DA') THEN 'Unknown' ELSE 'NonPolar' END AS c, count(*) FROM g GROUP BY c UNION ALL SELECT 'Atoms', k, count(*) FROM (SELECT string_agg(element || n, ' ' ORDER BY element) AS k FROM (SELECT scope_id, chain, res_seq, element, count(*) AS n FROM a GROUP BY ALL) GROUP BY scope_id, chain, res_seq) GROUP BY k")
QUERIES["chg9_clusters_all"], ORACLE["chg9_clusters_all"] = QUERIES["chg9_clusters"], ORACLE["chg9_clusters"]

def statistics(s, d):
    c, g = groups(s, d)
    names = c.residues.select("scope_id", "atom_ids", "res_name")
    return Q.cluster_statistics(g.join(names, ["scope_id", "atom_ids"]).withColumn("charge", F.round("charge", 6)), ["res_name", "set_id"]).select("res_name", "set_id", "n", (F.col("least") + 0.0).alias("least"), (F.col("greatest") + 0.0).alias("greatest"), (F.round("median", 3) + 0.0).alias("median"))


add("chg10_statistics", statistics, f"{GROUPS} SELECT rn AS res_name, set_id, count(*) AS n, round(min(round(charge, 6)), 3) + 0.0 AS least, round(max(round(charge, 6)), 3) + 0.0 AS greatest, round(quantile_cont(round(charge, 6), 0.5), 3) + 0.0 AS median FROM g GROUP BY ALL")
add("chg11_correlation", lambda s, d: Q.all_correlations(groups(s, d)[1].withColumn("charge", F.round("charge", 6)), ["scope_id"], ["atom_ids"]).filter("set_x < set_y").select("scope_id", "set_x", "set_y", "n", F.round("rmsd", 6).alias("rmsd"), F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("pearson2", 6).alias("pearson2")), f"{GROUPS}, p AS (SELECT x.scope_id, x.set_id AS set_x, y.set_id AS set_y, round(x.charge, 6) AS x, round(y.charge, 6) AS y FROM g x JOIN g y USING (scope_id, chain, res_seq) WHERE x.set_id < y.set_id) SELECT scope_id, set_x, set_y, count(*) AS n, round(sqrt(avg((x - y)**2)), 6) AS rmsd, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y)**2, 6) AS pearson2 FROM p GROUP BY ALL")
add("chg13_wide", lambda s, d: Q.wide(charges(s, d).filter("not (set_id = 2 and atom_id = 3)"), ["scope_id", "atom_id"], [0, 1, 2]), f"WITH {SQL_ATOMS}, {SQL_CHARGES} SELECT scope_id, atom_id, CAST(CAST(max(charge) FILTER (set_id = 0) AS DOUBLE) AS VARCHAR) AS set_0, CAST(CAST(max(charge) FILTER (set_id = 1) AS DOUBLE) AS VARCHAR) AS set_1, coalesce(CAST(CAST(max(charge) FILTER (set_id = 2 AND atom_id <> 3) AS DOUBLE) AS VARCHAR), '-') AS set_2 FROM q GROUP BY ALL")
QUERIES["chg13_wide_whole"], ORACLE["chg13_wide_whole"] = QUERIES["chg13_wide"], ORACLE["chg13_wide"]
add("chg14_checks", lambda s, d: Q.input_checks(scope(s, d).atoms, ["C", "N", "O", "S"]), f"WITH {SQL_ATOMS} SELECT scope_id, true AS no_hydrogens, count(*) FILTER (element = 'ZN') AS unknown_elements, count(*) AS n_atoms, CAST(0 AS BIGINT) AS duplicate_ids FROM a GROUP BY 1")


def vectors(s, d):
    e = table(s, d, "embeddings")
    return e.select((F.col("vec_id") % 7).cast("int").alias("structure"), F.floor(F.col("vec_id") / 7).cast("int").alias("atom"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


def pairs(s, d):
    v = vectors(s, d)
    return v.filter("structure > 0").join(v.filter("structure = 0").select("atom", *[F.col(c).alias(f"p{c}") for c in "xyz"]), "atom")


add("sup1_fit", lambda s, d: P.fit(pairs(s, d), ["structure"]).select("structure", "n", F.round("rmsd", 6).alias("rmsd")))
add("sup2_moved", lambda s, d: P.moved(pairs(s, d), P.fit(pairs(s, d), ["structure"]), ["structure"]).groupBy("structure").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0)))), 6).alias("rmsd")))
add("sup3_common", lambda s, d: P.common_atoms(vectors(s, d).select("structure", F.col("atom").alias("pivot_atom"))), "WITH v AS (SELECT CAST(vec_id % 7 AS INT) AS s, CAST(vec_id // 7 AS INT) AS pivot_atom FROM embeddings) SELECT pivot_atom FROM v GROUP BY 1 HAVING count(DISTINCT s) = (SELECT count(DISTINCT s) FROM v)")
add("sup4_average", lambda s, d: P.average_structure(vectors(s, d))[1].select("structure", F.round("rmsd", 5).alias("rmsd")))
add("sup5_pairwise", lambda s, d: P.pairwise_rmsd(vectors(s, d)).select("structure", "other", "n", F.round("rmsd", 6).alias("rmsd")))
add("sup6_bands", lambda s, d: P.rmsd_statistics(table(s, d, "events").select(F.col("event_id").alias("structure"), F.col("value").alias("rmsd")))[1].groupBy("band").agg(F.count("*").alias("n")), "WITH t AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT CAST(CASE WHEN value > m + 3 * s THEN 3 WHEN value > m + 2 * s THEN 2 WHEN value > m + s THEN 1 ELSE 0 END AS INT) AS band, count(*) AS n FROM events, t GROUP BY 1")
add("geo8_stacked", lambda s, d: (lambda c: P.stacked(c.residues_of("PHE"), c.residues_of("TYR"), (0.0, 20.0), (0.0, 15.0), (0.0, 40.0)).groupBy("scope_id").agg(F.count("*").alias("n")))(scope(s, d)))


def profile(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("channel_id"), F.lit(1).alias("structure_id"), "ts", "event_id", F.col("value"))
    from pyspark.sql import Window

    node = F.row_number().over(Window.partitionBy("channel_id").orderBy("ts", "event_id")) - 1
    r = F.round(F.col("value") % 7, 2)
    return e.withColumn("node", node).select("structure_id", "channel_id", "node", F.col("node").cast("double").alias("distance"), r.alias("radius"), (F.col("channel_id") % 5).cast("double").alias("x"), F.col("node").cast("double").alias("y"), F.lit(0.0).alias("z"))


PROFILE = "p AS (SELECT user_id AS channel_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS node, round(value % 7, 2) AS radius FROM events)"
add("chn1_bottleneck", lambda s, d: C.bottleneck_filter(profile(s, d), 1.0, 3.0), f"WITH {PROFILE}, f AS (SELECT *, radius < 1.0 AS low FROM p WHERE node >= 1), i AS (SELECT *, node - row_number() OVER (PARTITION BY channel_id, low ORDER BY node) AS k FROM f), bad AS (SELECT channel_id FROM i WHERE low GROUP BY channel_id, k HAVING max(node) - min(node) >= 3) SELECT DISTINCT channel_id FROM p WHERE channel_id NOT IN (SELECT channel_id FROM bad)")
add("chn2_length", lambda s, d: C.length_filter(profile(s, d), 30.0), f"WITH {PROFILE} SELECT channel_id, CAST(max(node) AS DOUBLE) AS length FROM p GROUP BY 1 HAVING max(node) >= 30")
add("chn3_duplicates", lambda s, d: C.drop_duplicates(profile(s, d)))
add("chn4_distance", lambda s, d: C.distance_classes(profile(s, d), 6.0).select("part", "channel_id", "other", F.round("distance", 6).alias("distance")))


def layers(s, d):
    p = profile(s, d).withColumn("residues", F.array(F.concat(F.lit("R"), F.floor(F.col("radius")).cast("string"))))
    return C.lining_layers(p)


LAYERS = f"{PROFILE}, l0 AS (SELECT *, 'R' || CAST(floor(radius) AS INT) AS k FROM p), l1 AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER w OR node = 0 THEN 1 ELSE 0 END AS n FROM l0 WINDOW w AS (PARTITION BY channel_id ORDER BY node)), l2 AS (SELECT *, sum(n) OVER (PARTITION BY channel_id ORDER BY node) AS layer FROM l1), l3 AS (SELECT channel_id, CAST(layer AS BIGINT) AS layer, any_value(k) AS lining, min(radius) AS radius, CAST(min(node) AS DOUBLE) AS start, CAST(max(node) AS DOUBLE) AS last FROM l2 GROUP BY ALL), ly AS (SELECT channel_id, layer, lining, radius, start, coalesce(lead(start) OVER (PARTITION BY channel_id ORDER BY layer), last) AS \"end\" FROM l3)"
add("chn5_layers", layers, f"WITH {LAYERS} SELECT * FROM ly")
add("chn6_flow", lambda s, d: C.residue_flow(layers(s, d)).select("channel_id", "residue", "first_layer", F.col("position").cast("long").alias("position")), f"WITH {LAYERS}, r AS (SELECT channel_id, lining AS residue, min(layer) AS first_layer FROM ly GROUP BY ALL) SELECT *, dense_rank() OVER (PARTITION BY channel_id ORDER BY first_layer, residue) AS position FROM r")
add("chn7_bottleneck_layer", lambda s, d: C.bottleneck_layer(layers(s, d)), f"WITH {LAYERS}, o AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY CASE WHEN \"end\" >= 3 THEN 0 WHEN layer > 1 THEN 1 ELSE 2 END, radius, layer) AS k FROM ly) SELECT channel_id, layer, radius FROM o WHERE k = 1")
add("chn7_minima", lambda s, d: C.local_minima(layers(s, d), 0.0), f"WITH {LAYERS}, s1 AS (SELECT *, CASE WHEN radius IS DISTINCT FROM lag(radius) OVER w THEN 1 ELSE 0 END AS n FROM ly WINDOW w AS (PARTITION BY channel_id ORDER BY layer)), s2 AS (SELECT *, sum(n) OVER (PARTITION BY channel_id ORDER BY layer) AS i FROM s1), s3 AS (SELECT channel_id, i, min(radius) AS r FROM s2 GROUP BY ALL), s4 AS (SELECT *, coalesce(lag(r) OVER w > r, false) AND coalesce(lead(r) OVER w > r, true) AS low FROM s3 WINDOW w AS (PARTITION BY channel_id ORDER BY i)) SELECT s2.channel_id, layer FROM s2 JOIN s4 USING (channel_id, i) WHERE low")
PROPS = [("ARG", 1, 1, 83, -4.5), ("LYS", 1, 1, 72, -3.9), ("HIS", 1, 1, 91, -3.2), ("ASP", -1, 1, 86, -3.5), ("GLU", -1, 1, 77, -3.5), ("ALA", 0, 0, 100, 1.8), ("GLY", 0, 0, 50, -0.4)]
SQL_PROPS = "v(res_name, charge, ionizable, mutability, hydropathy) AS (VALUES " + ", ".join(map(str, PROPS)) + ")"
add("chn8_properties", lambda s, d: C.property_sums(scope(s, d).residues.select("scope_id", "res_name"), s.createDataFrame(PROPS, "res_name string, charge long, ionizable long, mutability long, hydropathy double"), ["scope_id"]).withColumn("hydropathy", F.round("hydropathy", 6)), f"WITH {SQL_ATOMS}, {SQL_PROPS}, g AS (SELECT DISTINCT scope_id, chain, res_seq, res_name FROM a) SELECT scope_id, CAST(sum(charge) AS BIGINT) AS charge, CAST(sum(ionizable) AS BIGINT) AS ionizable, count(*) FILTER (charge > 0) AS positives, count(*) FILTER (charge < 0) AS negatives, CAST(floor(avg(mutability)) AS BIGINT) AS mutability, round(avg(hydropathy), 6) AS hydropathy FROM g JOIN v USING (res_name) GROUP BY 1")
add("chn9_weighted", lambda s, d: C.layer_weighted(layers(s, d), s.createDataFrame([(f"R{i}", float(i * i)) for i in range(7)], "residue string, value double")).withColumn("value", F.round("value", 6)), f"WITH {LAYERS} SELECT channel_id, round(avg(CAST(substr(lining, 2) AS DOUBLE)**2), 6) AS value FROM ly GROUP BY 1")


# validation: every HIS is a motif; its model is that of structure 1, atom 7 of each residue is lost in the pairing
def motif_tables(s, d):
    at = scope(s, d).atoms.filter("res_name in ('HIS', 'NAG')").withColumn("motif_id", F.concat_ws(":", F.col("scope_id").cast("string"), "chain", F.col("res_seq").cast("string"))).withColumn("model", F.col("res_name"))
    motifs = at.select("motif_id", "model", F.col("scope_id").cast("string").alias("structure_id"), F.array(F.struct("chain", "res_seq")).alias("residues")).distinct()
    models = s.createDataFrame([(m, i, f"{e}{i}", e) for m in ("HIS", "NAG") for i, e in enumerate("NCCOCCCC")], "model string, atom_id int, name string, element string")
    atoms = at.select("motif_id", "model", "atom_id", "name", "element", "chain", "res_seq", "res_name")
    pairing = at.filter("pos <> 7 or res_seq % 2 = 0").select("motif_id", "model", F.col("pos").alias("model_atom"), F.col("atom_id").alias("motif_atom"))
    return motifs, models, atoms, pairing


def flagged(s, d):
    """Entries of all motifs with their flags; every eleventh residue number makes a degenerate motif. No bonds are compared."""
    motifs, models, atoms, pairing = motif_tables(s, d)
    none = s.createDataFrame([], "model string, motif_id string, a int, b int, bond_type int")
    degenerate = motifs.filter(F.get("residues", F.lit(0))["res_seq"] % 11 == 0)
    return V.flags_of(V.analyse(motifs, atoms, none.drop("model"), {"atoms": models, "bonds": none.drop("motif_id")}, pairing, degenerate=degenerate), V.rules()), list(V.rules())


MOTIFS = f"WITH {SQL_ATOMS}, m AS (SELECT *, scope_id || ':' || chain || ':' || res_seq AS motif_id FROM a WHERE res_name IN ('HIS', 'NAG')), md AS (SELECT unnest(range(8)) AS pos, unnest(['N','C','C','O','C','C','C','C']) AS el), e AS (SELECT motif_id, any_value(res_name) AS model, CAST(any_value(scope_id) AS VARCHAR) AS structure_id, max(res_seq) % 11 = 0 AS dg, 8 - count(*) FILTER (pos <> 7 OR res_seq % 2 = 0) AS missing, count(*) FILTER ((pos <> 7 OR res_seq % 2 = 0) AND element <> el) AS substitutions FROM m JOIN md USING (pos) GROUP BY motif_id)"
FLAGLIST = "list_sort(list_filter([CASE WHEN missing IS NOT NULL THEN 'Analyzed' END, CASE WHEN NOT dg AND missing = 0 THEN 'HasAll' END, CASE WHEN NOT dg AND missing = 0 THEN 'HasAll_GoodChirality' END, CASE WHEN NOT dg AND missing = 0 THEN 'HasAll_GoodChirality_IgnorePlanarAndNonSingleBondErrors' END, CASE WHEN NOT dg AND missing = 0 AND substitutions > 0 THEN 'HasAll_Substitutions' END, CASE WHEN dg OR missing > 0 THEN 'Missing' END, CASE WHEN NOT dg AND missing > 0 THEN 'Missing_Atoms' END, CASE WHEN dg THEN 'Missing_Degenerate' END], lambda v: v IS NOT NULL))"
FLAGTEXT = f"array_to_string({FLAGLIST}, ',')"
SUMMARY = f"SELECT f.flag, count(x.motif_id) AS n FROM (SELECT unnest([{', '.join(map(repr, V.RULES))}]) AS flag) f LEFT JOIN (SELECT motif_id, unnest({FLAGLIST}) AS flag FROM e) x ON x.flag = f.flag GROUP BY 1"
add("val4_missing", lambda s, d: (lambda t: V.missing_atoms(t[0], t[1], t[3]).select("motif_id", F.col("missing").cast("long").alias("missing"), F.array_join("missing_ids", ",").alias("ids")))(motif_tables(s, d)), f"{MOTIFS}, k AS (SELECT DISTINCT motif_id FROM m), w AS (SELECT motif_id, pos FROM k, md EXCEPT SELECT motif_id, pos FROM m WHERE pos <> 7 OR res_seq % 2 = 0) SELECT k.motif_id, count(w.pos) AS missing, coalesce(string_agg(CAST(w.pos AS VARCHAR), ',' ORDER BY w.pos), '') AS ids FROM k LEFT JOIN w USING (motif_id) GROUP BY 1")
add("val6_main_residue", lambda s, d: (lambda t: V.main_residue(t[3], t[2]).select("motif_id", "chain", "res_seq", "n"))(motif_tables(s, d)), f"{MOTIFS} SELECT motif_id, chain, res_seq, count(*) AS n FROM m WHERE pos <> 7 OR res_seq % 2 = 0 GROUP BY ALL")
add("val7_substitutions", lambda s, d: (lambda t: V.substitutions(t[3], t[2], t[1]).select("motif_id", F.col("model_atom").alias("pos"), "motif_element"))(motif_tables(s, d)), f"{MOTIFS} SELECT motif_id, pos, element AS motif_element FROM m JOIN md USING (pos) WHERE (pos <> 7 OR res_seq % 2 = 0) AND element <> el")
add("val9_naming", lambda s, d: (lambda t: V.naming(t[2], t[1], t[0]).select("motif_id", F.col("duplicate_names").cast("long").alias("duplicate_names"), F.col("unmatched_names").cast("long").alias("unmatched_names")))(motif_tables(s, d)), f"{MOTIFS}, k AS (SELECT DISTINCT motif_id FROM m), w AS (SELECT motif_id, el || pos AS n FROM k, md EXCEPT SELECT motif_id, name FROM m) SELECT k.motif_id, CAST(0 AS BIGINT) AS duplicate_names, count(w.n) AS unmatched_names FROM k LEFT JOIN w USING (motif_id) GROUP BY 1")
add("val14_flags", lambda s, d: flagged(s, d)[0].select("motif_id", F.array_join("flags", ",").alias("flags")), f"{MOTIFS} SELECT motif_id, {FLAGTEXT} AS flags FROM e")
add("val15_flag_summary", lambda s, d: V.flag_summary(*flagged(s, d)), f"{MOTIFS} {SUMMARY}")
add("val16_matrix", lambda s, d: V.pairing_matrix(motif_tables(s, d)[3], "HIS", [0, 6, 7]), f"{MOTIFS} SELECT motif_id, coalesce(CAST(min(atom_id) FILTER (pos = 0) AS VARCHAR), '-') AS atom_0, coalesce(CAST(min(atom_id) FILTER (pos = 6) AS VARCHAR), '-') AS atom_6, coalesce(CAST(min(atom_id) FILTER (pos = 7 AND res_seq % 2 = 0) AS VARCHAR), '-') AS atom_7 FROM m WHERE res_name = 'HIS' AND (pos <> 7 OR res_seq % 2 = 0) GROUP BY 1")
add("val17_by_model", lambda s, d: (lambda t: V.summaries(t[0], "model", ["Missing", "HasAll"]))(flagged(s, d)), f"{MOTIFS} SELECT model, count(*) AS analyzed, count(*) FILTER (dg OR missing > 0) AS \"Missing\", count(*) FILTER (NOT dg AND missing = 0) AS \"HasAll\" FROM e GROUP BY ROLLUP (model)")
add("val18_custom", lambda s, d: (lambda t: V.custom_aggregate(t[0], ["1", "2", "nowhere"], ["HIS"], ["Missing"])[0])(flagged(s, d)), f"{MOTIFS} SELECT structure_id, count(*) AS analyzed, count(*) FILTER (dg OR missing > 0) AS \"Missing\" FROM e WHERE model = 'HIS' AND structure_id IN ('1', '2') GROUP BY ROLLUP (structure_id)")
add("val19_search", lambda s, d: (lambda t: V.search(t[0], s.createDataFrame([("1", None, None), ("2", "A", 3), ("none", None, None)], "structure_id string, chain string, res_seq int"))[0].select("motif_id"))(flagged(s, d)), f"{MOTIFS} SELECT DISTINCT motif_id FROM m WHERE scope_id = 1 OR (scope_id = 2 AND chain = 'A' AND res_seq = 3)")
add("val20_merge", lambda s, d: (lambda t: V.merge([(t[0].select("motif_id"), V.flag_summary(*t))] * 2)[1])(flagged(s, d)), f"{MOTIFS} SELECT flag, CAST(2 * n AS BIGINT) AS n FROM ({SUMMARY})")
add("val21_residue_flags", lambda s, d: V.residue_flags(scope(s, d).residues.filter("res_name in ('HIS', 'GLY')").select(F.col("scope_id").cast("string").alias("structure_id"), "chain", "res_seq"), flagged(s, d)[0]).select("structure_id", "chain", "res_seq", F.array_join("flags", ",").alias("flags")), f"{MOTIFS}, g AS (SELECT DISTINCT CAST(scope_id AS VARCHAR) AS structure_id, chain, res_seq, scope_id || ':' || chain || ':' || res_seq AS motif_id FROM a WHERE res_name IN ('HIS', 'GLY')) SELECT g.structure_id, chain, res_seq, coalesce({FLAGTEXT}, '') AS flags FROM g LEFT JOIN e USING (motif_id)")
add("val22_report", lambda s, d: V.report(motif_tables(s, d)[0]), f"{MOTIFS} SELECT structure_id, array_to_string(list_sort(list(DISTINCT model)), ',') AS models, count(*) AS motifs FROM e GROUP BY ROLLUP (structure_id)")

# perception and export
add("str6_bonds", lambda s, d: (lambda c: S.perceive_bonds(type(c)(c.atoms), s.createDataFrame([("C", "N", 6.0, 1), ("C", "C", 5.0, 1), ("C", "O", 5.5, 2)], "first string, second string, length double, bond_type int"), 6.0).groupBy("scope_id", "bond_type").agg(F.count("*").alias("n")))(scope(s, d)), f"WITH {SQL_ATOMS}, p AS (SELECT p.scope_id, least(p.element, q.element) || greatest(p.element, q.element) AS e, (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 AS d FROM a p JOIN a q ON p.scope_id = q.scope_id AND p.atom_id < q.atom_id) SELECT scope_id, CASE WHEN e = 'CO' THEN 2 ELSE 1 END AS bond_type, count(*) AS n FROM p WHERE (e = 'CN' AND d <= 36) OR (e = 'CC' AND d <= 25) OR (e = 'CO' AND d <= 30.25) GROUP BY ALL")
add("str7_close", lambda s, d: S.close_contacts(scope(s, d), 8.0).select("scope_id", "a", "b", F.col("flagged").isNotNull().alias("flagged")), f"WITH {SQL_ATOMS}, {SQL_BONDS} SELECT b.scope_id, b.a, b.b, (p.res_seq <> q.res_seq) AS flagged FROM b JOIN a p ON p.scope_id = b.scope_id AND p.atom_id = b.a JOIN a q ON q.scope_id = b.scope_id AND q.atom_id = b.b WHERE (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 < 64")
add("str8_without", lambda s, d: S.without_hydrogens(type(scope(s, d))(scope(s, d).atoms.withColumn("element", F.when(F.col("element") == "O", "H").otherwise(F.col("element"))), scope(s, d).bonds)).bonds.groupBy("scope_id").agg(F.count("*").alias("n")), f"WITH {SQL_ATOMS}, {SQL_BONDS} SELECT b.scope_id, count(*) AS n FROM b JOIN a p ON p.scope_id = b.scope_id AND p.atom_id = b.a JOIN a q ON q.scope_id = b.scope_id AND q.atom_id = b.b WHERE p.element <> 'O' AND q.element <> 'O' GROUP BY 1")
add("str14_metadata", lambda s, d: S.derived_metadata(table(s, d, "customer").select((F.col("c_custkey") % 200).alias("scope_id"), F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 9 < 7, "Protein").when(F.col("c_custkey") % 9 == 7, "DNA").alias("polymer_type"), (F.col("c_nationkey") % 4 + 1).alias("n_chains"), F.lit(1.5).alias("weight"), (F.col("c_custkey") % 9 == 8).alias("is_water"))).select("scope_id", "weight", "polymer_type", "stoichiometry_string"), "WITH e AS (SELECT c_custkey % 200 AS scope_id, c_custkey AS id, CASE WHEN c_custkey % 9 < 7 THEN 'Protein' WHEN c_custkey % 9 = 7 THEN 'DNA' END AS t, c_nationkey % 4 + 1 AS n, c_custkey % 9 = 8 AS w FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY n DESC, id) AS k FROM e WHERE t = 'Protein'), s AS (SELECT scope_id, string_agg(chr(CAST(64 + k AS INT)) || n, '' ORDER BY k) AS stoichiometry_string FROM r GROUP BY 1), t AS (SELECT scope_id, list_sort(list(DISTINCT t)) AS ts FROM e WHERE t IS NOT NULL GROUP BY 1), x AS (SELECT scope_id, sum(1.5) FILTER (NOT w) AS weight FROM e GROUP BY 1) SELECT x.scope_id, CAST(weight AS DOUBLE) AS weight, CASE WHEN len(ts) = 1 THEN ts[1] WHEN len(ts) = 2 THEN 'ProteinDNA' END AS polymer_type, stoichiometry_string FROM x LEFT JOIN t USING (scope_id) LEFT JOIN s USING (scope_id)")
LINE = "rpad(record_name, 6, ' ') || lpad(CAST(atom_id AS VARCHAR), 5, ' ') || '  ' || rpad(name, 3, ' ') || ' ' || lpad(res_name, 3, ' ') || ' ' || chain || lpad(CAST(res_seq AS VARCHAR), 4, ' ') || '    ' || lpad(printf('%.3f', CAST(x AS DOUBLE)), 8, ' ') || lpad(printf('%.3f', CAST(y AS DOUBLE)), 8, ' ') || lpad(printf('%.3f', CAST(z AS DOUBLE)), 8, ' ') || '  1.00  0.00          ' || lpad(element, 2, ' ')"
add("snk3_pattern_texts", lambda s, d: (lambda c: sinks.pattern_texts(c.residues_of("HIS").long.drop("name").join(c.atoms, ["scope_id", "atom_id"]).withColumn("occupancy", F.lit(1.0)).withColumn("temperature_factor", F.lit(0.0)), ["scope_id", "chain", "res_seq"]))(scope(s, d)), f"WITH {SQL_ATOMS} SELECT scope_id, chain, res_seq, string_agg({LINE}, chr(10) ORDER BY atom_id) || chr(10) || 'END' AS value FROM a WHERE res_name = 'HIS' GROUP BY ALL")
