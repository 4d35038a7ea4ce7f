"""Registered queries of values, filters, the entry database and the batch service."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from molquarry.functions import values as V
from molquarry.operators import index, service
from molquarry.operators.core import AMINO, upper_in
from molquarry.sources.fixtures import SQL_ATOMS, scope, table

QUERIES, ORACLE = {}, {}


def add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def words(c: str):
    return F.split(F.col(c), " ")


# values
add("sca1_arithmetic", lambda s, d: table(s, d, "part").select("p_partkey", V.plus(F.col("p_size"), F.lit(7)).cast("long").alias("plus"), V.subtract(F.col("p_size"), F.lit(30)).cast("long").alias("minus"), V.times(F.col("p_size"), F.lit(3)).cast("long").alias("times"), V.divide(F.col("p_size") - 25, F.lit(4), integers=True).alias("ints"), F.round(V.divide(F.col("p_retailprice"), F.lit(3.0)), 6).alias("reals")),
    "SELECT p_partkey, CAST(p_size + 7 AS BIGINT) AS plus, CAST(p_size - 30 AS BIGINT) AS minus, CAST(p_size * 3 AS BIGINT) AS times, CAST((p_size - 25) // 4 AS BIGINT) AS ints, round(p_retailprice / 3.0, 6) AS reals FROM part")
add("sca2_power", lambda s, d: table(s, d, "part").select("p_partkey", V.power(F.col("p_size"), F.lit(3), integers=True).alias("cube"), F.round(V.power(F.col("p_retailprice"), F.lit(0.5)), 6).alias("root"), F.abs(F.col("p_size") - 25).cast("long").alias("abs")), "SELECT p_partkey, CAST(p_size AS BIGINT)**3 AS cube, round(sqrt(p_retailprice), 6) AS root, CAST(abs(p_size - 25) AS BIGINT) AS abs FROM part")
add("sca4_equal", lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").agg(F.count_if(V.equal(F.col("o_totalprice"), F.round("o_totalprice", 1), reals=True)).alias("n_equal"), F.count_if(V.not_equal(F.col("o_orderpriority"), F.lit("5-LOW"))).alias("n_other")), "SELECT o_orderstatus, count(*) FILTER (abs(o_totalprice - round(o_totalprice, 1)) <= 1e-9) AS n_equal, count(*) FILTER (o_orderpriority <> '5-LOW') AS n_other FROM orders GROUP BY 1")
NULLED = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END"
add("sca6_logic", lambda s, d: (lambda p, q: table(s, d, "orders").select(V.logical_and(p, q).alias("a"), V.logical_or(p, q).alias("o"), V.logical_xor(p, q).alias("x")).groupBy("a", "o", "x").agg(F.count("*").alias("n")))(F.expr(NULLED), F.expr("o_custkey % 2 = 0")), f"WITH t AS (SELECT {NULLED} AS p, o_custkey % 2 = 0 AS q FROM orders) SELECT CASE WHEN NOT q THEN false WHEN p IS NULL THEN NULL ELSE p END AS a, CASE WHEN q THEN true WHEN p IS NULL THEN NULL ELSE p END AS o, p <> q AS x, count(*) AS n FROM t GROUP BY ALL")
add("sca7_dates", lambda s, d: table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count_if(F.col("o_orderdate").cast("date") >= F.make_date(F.lit(1997), F.lit(3), F.lit(5))).alias("n")), "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (CAST(o_orderdate AS DATE) >= DATE '1997-03-05') AS n FROM orders GROUP BY 1")
WORD = "regexp_matches(lower(p_name), '^(.*[^a-z0-9])?{0}([^a-z0-9].*)?$')"
add("meta7_has_all", lambda s, d: table(s, d, "part").select("p_partkey", V.has_all(F.array("p_name", "p_type"), "widget", "ECONOMY").alias("hit")), "SELECT p_partkey, (p_name = 'widget' OR p_name LIKE '% widget' OR p_name LIKE 'widget %') AND p_type = 'ECONOMY' AS hit FROM part")
add("meta8_has_any", lambda s, d: table(s, d, "part").select("p_partkey", V.has_any(F.array("p_name", "p_type"), "ring", "STANDARD").alias("hit")), "SELECT p_partkey, (p_name = 'ring' OR p_name LIKE '% ring' OR p_name LIKE 'ring %') OR p_type = 'STANDARD' AS hit FROM part")
add("meta6_listed", lambda s, d: table(s, d, "part").select("p_partkey", V.listed(words("p_name")).alias("names")), "SELECT p_partkey, replace(p_name, ' ', '; ') AS names FROM part")
add("meta1_years", lambda s, d: table(s, d, "supplier").select(F.expr("year(date_add(date'2000-01-01', cast(s_suppkey * 37 as int)))").alias("release_year"), F.round(F.abs("s_acctbal") / 2000, 2).alias("resolution")).groupBy("release_year").agg(F.count("*").alias("n"), F.round(F.avg("resolution"), 6).alias("mean_resolution")), "SELECT CAST(year(DATE '2000-01-01' + CAST(s_suppkey * 37 AS INT)) AS INT) AS release_year, count(*) AS n, round(avg(round(abs(s_acctbal) / 2000, 2)), 6) AS mean_resolution FROM supplier GROUP BY 1")

# filters
add("flt1_int", lambda s, d: table(s, d, "part").filter(V.int_filter(F.col("p_size"), "<=", 10)).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size <= 10")
add("flt2_double", lambda s, d: table(s, d, "part").filter(V.double_filter(F.col("p_retailprice"), ">=", 950.0)).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_retailprice >= 950.0 - 1e-8")
add("flt3_date", lambda s, d: table(s, d, "orders").filter(V.date_filter(F.col("o_orderdate"), ">", "1998-3-5")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-03-05'")
add("flt4_exact", lambda s, d: table(s, d, "part").filter(V.is_value(words("p_name"), "Ring")).select("p_partkey"), "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'ring')")
add("flt5_word", lambda s, d: table(s, d, "part").filter(V.contains_word(F.array("p_name", "p_brand"), "brand")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#%' OR p_name = 'brand'")
add("flt6_regex", lambda s, d: table(s, d, "part").filter(V.matches(words("p_name"), "^W.*T$")).select("p_partkey"), "SELECT p_partkey FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda v: regexp_matches(v, '^w.*t$'))) > 0")
add("flt7_boolean", lambda s, d: table(s, d, "part").filter(V.all_of(V.any_of(V.is_value(words("p_name"), "red"), V.is_value(words("p_name"), "small")), V.none_of(V.is_value(words("p_name"), "ring")))).select("p_partkey"), "SELECT p_partkey FROM part WHERE (list_contains(string_split(p_name, ' '), 'red') OR list_contains(string_split(p_name, ' '), 'small')) AND NOT list_contains(string_split(p_name, ' '), 'ring')")
add("flt8_conjunction", lambda s, d: index.select_entries(table(s, d, "part"), [V.int_filter(F.col("p_size"), ">", 20), V.contains_word(F.array("p_type"), "economy")], table(s, d, "lineitem").filter("l_quantity < 10").select(F.col("l_partkey").alias("id")), "p_partkey").select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size > 20 AND p_type = 'ECONOMY' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 10)")
add("set7_missing", lambda s, d: index.missing_entries(table(s, d, "orders").filter("o_orderstatus = 'F'"), table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct(), "o_orderkey"), "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
OLD, NEW = "o_orderkey % 7 <> 0", "o_orderkey % 5 <> 0"


def _snapshots(s, d):
    o = table(s, d, "orders").withColumn("size", F.length("o_orderpriority"))
    return o.filter(OLD), o.filter(NEW).withColumn("size", F.when(F.col("o_orderkey") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))


add("dbx2_changes", lambda s, d: index.changes(*_snapshots(s, d), "o_orderkey", "size"), f"SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN NOT ({OLD}) THEN 'New' WHEN NOT ({NEW}) THEN 'Removed' WHEN o_orderkey % 11 = 0 THEN 'Modified' ELSE 'AlreadyPresent' END AS action FROM orders WHERE {OLD} OR {NEW}")
add("dbx2_counts", lambda s, d: index.change_counts(index.changes(*_snapshots(s, d), "o_orderkey", "size")), f"SELECT CASE WHEN NOT ({OLD}) THEN 'New' WHEN NOT ({NEW}) THEN 'Removed' WHEN o_orderkey % 11 = 0 THEN 'Modified' ELSE 'AlreadyPresent' END AS action, count(*) AS n FROM orders WHERE {OLD} OR {NEW} GROUP BY 1")
RINGS = "(SELECT scope_id, count(*) AS k, min(res_name) AS rn FROM a GROUP BY scope_id, chain, res_seq)"


def _index(s, d):
    return index.build_index(scope(s, d)).withColumn("size_in_bytes", F.col("atom_count") * 80)


add("dbx1_index", lambda s, d: _index(s, d).select("scope_id", "atom_count", F.array_join("atom_types", ",").alias("atom_types"), "residue_count", F.size("residue_types").cast("long").alias("n_residue_types"), (F.size("ring_fingerprints") > 0).alias("has_rings")), f"WITH {SQL_ATOMS} SELECT a.scope_id, count(*) AS atom_count, array_to_string(list_sort(list(DISTINCT element)), ',') AS atom_types, count(DISTINCT (chain, res_seq)) AS residue_count, count(DISTINCT res_name) AS n_residue_types, true AS has_rings FROM a GROUP BY a.scope_id")
add("dbx4_statistics", lambda s, d: index.statistics(scope(s, d).atoms.groupBy("scope_id").agg(F.count("*").alias("atom_count")).withColumn("size_in_bytes", F.col("atom_count") * 80)), f"WITH {SQL_ATOMS}, g AS (SELECT scope_id, count(*) AS n FROM a GROUP BY 1) SELECT count(*) AS n_entries, CAST(ceil(avg(n)) AS BIGINT) AS average_atoms, CAST(sum(n * 80) AS BIGINT) AS total_size FROM g")
add("set6_snapshot_union", lambda s, d: index.snapshot_union({"small": table(s, d, "part").filter("p_size < 20"), "cheap": table(s, d, "part").filter("p_retailprice < 950")}, "p_partkey", "p_size")[1], "SELECT 'small' AS view, count(*) AS n_entries, CAST(sum(p_size) AS BIGINT) AS n_atoms FROM part WHERE p_size < 20 UNION ALL SELECT 'cheap', count(*), CAST(sum(p_size) AS BIGINT) FROM part WHERE p_retailprice < 950 UNION ALL SELECT 'total', count(*), CAST(sum(p_size) AS BIGINT) FROM part WHERE p_size < 20 OR p_retailprice < 950")
add("view1_statistics", lambda s, d: index.view(table(s, d, "part").withColumn("atom_count", F.col("p_size")), "economy_parts", [V.contains_word(F.array("p_type"), "economy")]), "SELECT count(*) AS n_entries, CAST(ceil(avg(p_size)) AS BIGINT) AS average_atoms FROM part WHERE p_type = 'ECONOMY'")

# batch service
TWO = {"his": lambda c: c.residues_of("HIS"), "zinc": lambda c: c.atoms_of("ZN").ambient_residues(3)}
HIS = "SELECT scope_id, chain, res_seq, count(*) AS n, min(atom_id) AS first, list_sort(list(atom_id)) AS ids FROM a WHERE res_name = 'HIS' GROUP BY ALL"
add("svc2_pattern_rows", lambda s, d: service.entries(scope(s, d).residues_of("HIS").named()).select("scope_id", F.col("serial").cast("long").alias("serial"), "pattern_id", F.col("atom_count").cast("long").alias("atom_count"), "residue_count", "signature", "residue_ids"), f"WITH {SQL_ATOMS}, h AS ({HIS}), w AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY ids) - 1 AS serial FROM h) SELECT scope_id, serial, scope_id || '_' || serial || '_' || first AS pattern_id, n AS atom_count, CAST(1 AS BIGINT) AS residue_count, 'HIS' AS signature, res_seq || ' ' || chain AS residue_ids FROM w")
ZN = "z AS (SELECT DISTINCT scope_id, pid, atom_id FROM (SELECT p.scope_id, p.atom_id AS pid, r.atom_id FROM a p JOIN a q ON p.scope_id = q.scope_id AND p.element = 'ZN' AND q.res_name <> 'HOH' AND (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 <= 9 JOIN a r ON r.scope_id = q.scope_id AND r.chain = q.chain AND r.res_seq = q.res_seq UNION ALL SELECT scope_id, atom_id, atom_id FROM a WHERE element = 'ZN')), zz AS (SELECT DISTINCT scope_id, ids FROM (SELECT scope_id, pid, list_sort(list(atom_id)) AS ids FROM z GROUP BY ALL))"
IDS_MD5 = "md5(string_agg(array_to_string(ids, '-'), ',' ORDER BY array_to_string(ids, '-')))"
add("svc1_run", lambda s, d: service.run(TWO, scope(s, d)).groupBy("query_id", "scope_id").agg(F.count("*").alias("patterns"), F.sum("atom_count").alias("atoms"), F.md5(F.array_join(F.array_sort(F.collect_list(F.array_join("atom_ids", "-"))), ",")).alias("ids_md5")), f"WITH {SQL_ATOMS}, h AS ({HIS}), {ZN} SELECT 'his' AS query_id, scope_id, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS atoms, {IDS_MD5} AS ids_md5 FROM h GROUP BY scope_id UNION ALL SELECT 'zinc', scope_id, count(*), CAST(sum(len(ids)) AS BIGINT), {IDS_MD5} FROM zz GROUP BY scope_id")


def _structures(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("scope_id"), F.round(F.abs("s_acctbal") / 2000, 2).alias("resolution"), F.array(F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("organisms"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("X-RAY").alias("experiment_method"))


def _rows(s, d):
    return service.structure_rows(service.run({"his": TWO["his"]}, scope(s, d)), _structures(s, d))


PER = f"h AS ({HIS}), n AS (SELECT scope_id, count(*) AS pattern_count, CAST(sum(n) AS BIGINT) AS atom_count FROM h GROUP BY 1)"
add("svc3_structure_rows", lambda s, d: _rows(s, d).select("query_id", "scope_id", "pattern_count", "atom_count", "error_type", "resolution", "experiment_method"), f"WITH {SQL_ATOMS}, {PER} SELECT 'his' AS query_id, scope_id, pattern_count, atom_count, 'None' AS error_type, round(abs(s_acctbal) / 2000, 2) AS resolution, CASE WHEN s_suppkey % 3 = 0 THEN 'Not Assigned' ELSE 'X-RAY' END AS experiment_method FROM n JOIN supplier ON s_suppkey = scope_id")
add("svc4_metadata_summary", lambda s, d: service.metadata_summary(_rows(s, d), {"OriginOrganism": F.col("organisms"), "ExperimentMethod": F.array("experiment_method")}), f"WITH {SQL_ATOMS}, {PER}, m AS (SELECT n.*, 'n' || s_nationkey AS o, CASE WHEN s_suppkey % 3 = 0 THEN 'not assigned' ELSE 'x-ray' END AS e FROM n JOIN supplier ON s_suppkey = scope_id) SELECT 'his' AS query_id, 'OriginOrganism' AS property, o AS value, count(*) AS structures, CAST(sum(pattern_count) AS BIGINT) AS patterns FROM m GROUP BY o UNION ALL SELECT 'his', 'ExperimentMethod', e, count(*), CAST(sum(pattern_count) AS BIGINT) FROM m GROUP BY e")
add("svc5_query_summary", lambda s, d: service.query_summary(_rows(s, d)), f"WITH {SQL_ATOMS}, {PER} SELECT 'his' AS query_id, CAST(sum(pattern_count) AS BIGINT) AS patterns, count(*) AS structures, CAST(0 AS BIGINT) AS reader_errors, CAST(0 AS BIGINT) AS computation_errors, CAST(0 AS BIGINT) AS with_errors FROM n")
add("svc7_admit", lambda s, d: service.admit(table(s, d, "supplier").select(F.col("s_suppkey").alias("scope_id"), "s_name", (F.col("s_nationkey") * 100).alias("atom_count")), "s_name", 40, 60000).select("scope_id"), "SELECT scope_id FROM (SELECT s_suppkey AS scope_id, count(*) OVER w AS n, sum(s_nationkey * 100) OVER w AS m FROM supplier WINDOW w AS (ORDER BY s_name ROWS UNBOUNDED PRECEDING)) WHERE n <= 40 AND m <= 60000")
FLAGS = "scope_id, chain, res_seq, CASE WHEN res_seq % 5 = 0 THEN ['HasAll', 'Missing'] WHEN res_seq % 5 = 1 THEN ['Missing'] ELSE [] END AS flags"


def _flagged(s, d):
    c = scope(s, d)
    val = c.residues.filter(~upper_in("res_name", [*AMINO, "HOH"])).select("scope_id", "chain", "res_seq", F.when(F.col("res_seq") % 5 == 0, F.array(F.lit("HasAll"), F.lit("Missing"))).when(F.col("res_seq") % 5 == 1, F.array(F.lit("Missing"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return service.attach_flags(c.residues_of("NAG", "MAN", "DA").df, c.residues, val, [*AMINO, "HOH"])


add("svc8_flags", lambda s, d: service.flag_ids(_flagged(s, d), "flags").select("scope_id", F.array_join("atom_ids", "-").alias("atoms"), F.array_join("flags", ",").alias("flags"), F.col("flag_id").cast("long").alias("flag_id")), f"WITH {SQL_ATOMS}, g AS (SELECT scope_id, chain, res_seq, array_to_string(list_sort(list(atom_id)), '-') AS atoms, CASE WHEN res_seq % 5 = 0 THEN 'HasAll,Missing' WHEN res_seq % 5 = 1 THEN 'Missing' ELSE '' END AS flags FROM a WHERE res_name IN ('NAG', 'MAN', 'DA') GROUP BY ALL), f AS (SELECT flags, dense_rank() OVER (ORDER BY flags) - 1 AS i FROM (SELECT DISTINCT flags FROM g WHERE flags <> '')) SELECT scope_id, atoms, flags, coalesce(i, -1) AS flag_id FROM g LEFT JOIN f USING (flags)")
add("win1_serial", lambda s, d: service.with_serial(scope(s, d).atoms_of("ZN").df, "scope_id").select("scope_id", F.get("atom_ids", F.lit(0)).alias("atom_id"), F.col("serial").cast("long").alias("serial")), f"WITH {SQL_ATOMS} SELECT scope_id, atom_id, row_number() OVER (PARTITION BY scope_id ORDER BY atom_id) - 1 AS serial FROM a WHERE element = 'ZN'")
add("win2_limits", lambda s, d: service.limited(scope(s, d).residues_of("HIS").df.withColumn("atom_count", F.size("atom_ids")), 200, 1500, ["scope_id", "atom_ids"]).groupBy("scope_id").agg(F.count("*").alias("n")), f"WITH {SQL_ATOMS}, h AS ({HIS}), w AS (SELECT *, row_number() OVER o - 1 AS k, coalesce(sum(n) OVER (ORDER BY scope_id, ids ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM h WINDOW o AS (ORDER BY scope_id, ids)) SELECT scope_id, count(*) AS n FROM w WHERE k < 200 AND m < 1500 GROUP BY 1")
add("win4_page", lambda s, d: service.page(table(s, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 150), "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 15 OFFSET ((150 % CAST(ceil((SELECT count(*) FROM part) / 15.0) AS INT)) * 15)")
add("win5_preview", lambda s, d: service.preview(table(s, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"]), "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 10")
add("win6_sigma", lambda s, d: service.sigma_bands(table(s, d, "events").select("event_type", "value"), "value", ["event_type"]).groupBy("event_type", "band").agg(F.count("*").alias("n")), "WITH t AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_type, CAST(CASE WHEN value IS NULL THEN 1000 WHEN s < 1e-9 THEN 0 WHEN value > m + 3 * s THEN 3 WHEN value > m + 2 * s THEN 2 WHEN value > m + s THEN 1 ELSE 0 END AS INT) AS band, count(*) AS n FROM events JOIN t USING (event_type) GROUP BY ALL")
add("win7_ranks", lambda s, d: service.ranks(table(s, d, "events").select("event_id", "event_type", "value"), "value", ["event_type"]).select("event_id", "rank"), "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rank FROM events")
