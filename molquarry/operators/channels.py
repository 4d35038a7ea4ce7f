"""Channel profiles: bottlenecks, lengths, near-duplicates, lining layers and residue properties.

profile(channel_id, node, distance, radius, x, y, z); nodes are in order along a channel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import range_pairs
from .nearest import k_nearest
from .tables import cut


def islands(df: DataFrame, by: list[str], order: str, key: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of equal key along the order."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.coalesce(~key.eqNullSafe(F.lag(key).over(w)), F.lit(True))
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", (new | first).cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def bottleneck_filter(profile: DataFrame, radius: float, tolerance: float) -> DataFrame:
    """Channels that pass. Nodes nearer than the radius do not count; with tolerance 0 no node may be narrower, else no
    run of narrower nodes may be as long as the tolerance."""
    far = profile.filter(F.col("distance") >= radius)
    if tolerance == 0:
        bad = far.filter(F.col("radius") < radius).select("channel_id")
    else:
        runs = islands(far, ["channel_id"], "node", F.col("radius") < radius)
        bad = runs.filter(F.col("radius") < radius).groupBy("channel_id", "island").agg((F.max("distance") - F.min("distance")).alias("l")).filter(F.col("l") >= tolerance).select("channel_id")
    return profile.select("channel_id").distinct().join(bad.distinct(), "channel_id", "left_anti")


def length_filter(profile: DataFrame, least: float) -> DataFrame:
    return profile.groupBy("channel_id").agg(F.max("distance").alias("length")).filter(F.col("length") >= least)


def channel_distance(profile: DataFrame, most: float | None = None) -> DataFrame:
    """Mean of the two directed root mean square nearest-point distances, for all pairs of a structure's channels.

    Each node seeks its nearest node of each other channel by descent (see nearest.py). With `most`, only pairs whose nodes
    all have one within it, which meet in cells of that size.
    """
    nodes = profile.select("structure_id", "channel_id", "node", "x", "y", "z")
    asked = nodes.select("structure_id", "channel_id", "node", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    targets = nodes.select("structure_id", F.col("channel_id").alias("other"), "x", "y", "z")
    if most is None:
        others = targets.select("structure_id", "other").distinct()
        near = k_nearest(asked.join(others, "structure_id").filter("channel_id <> other"), targets, 1, ["structure_id", "other"])
    else:
        near = range_pairs(asked, targets, most, "structure_id").filter("channel_id <> other").groupBy("structure_id", "channel_id", "other", "node").agg(F.min("_d2").alias("_d2"))
    size = profile.groupBy("channel_id").agg(F.count("*").alias("_n"))
    one = near.groupBy("structure_id", "channel_id", "other").agg(F.sqrt(F.avg("_d2")).alias("d"), F.count("*").alias("_k")).join(size, "channel_id").filter("_k = _n").select("structure_id", "channel_id", "other", "d")
    back = one.select("structure_id", F.col("channel_id").alias("other"), F.col("other").alias("channel_id"), F.col("d").alias("_e"))
    return one.join(back, ["structure_id", "channel_id", "other"]).filter("channel_id < other").select("structure_id", "channel_id", "other", ((F.col("d") + F.col("_e")) / 2).alias("distance"))


def copies(profile: DataFrame) -> DataFrame:
    """structure_id, channel_id and first: the least channel of the structure with the same points, and as long. Channels with
    a coordinate that is no number, or two nodes of one number, stand alone."""
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in "xyz"])
    point = [F.col(c).cast("double") + 0.0 for c in "xyz"]
    # two sums of hashes stand for the points, in any order
    sums = (F.sum(h.cast("decimal(20,0)")).alias(n) for n, h in (("_ha", F.xxhash64(*point)), ("_hb", F.xxhash64(F.lit(7), *point))))
    each = profile.groupBy("structure_id", "channel_id").agg(F.count("*").alias("_n"), F.max("distance").alias("_l"), ((F.count_distinct("node") == F.count("*")) & F.min(whole)).alias("_ok"), *sums)
    each = each.withColumn("_own", F.when(~F.col("_ok"), F.col("channel_id").cast("string")).otherwise(""))
    by = ["structure_id", "_own", "_n", "_l", "_ha", "_hb"]
    each = cut(each.withColumn("_l", F.coalesce(F.col("_l").cast("string"), F.lit(""))).select("channel_id", *by))
    return each.join(each.groupBy(*by).agg(F.min("channel_id").alias("first")), by).select("structure_id", "channel_id", "first")


def _only(profile: DataFrame, of: DataFrame) -> DataFrame:
    """profile of the channels that come first in copies()."""
    return profile.join(of.filter("channel_id = first").select("structure_id", "channel_id"), ["structure_id", "channel_id"], "left_semi")


def distance_classes(profile: DataFrame, most: float | None = None) -> DataFrame:
    """channel_distance() without a row for each pair of copies: structure_id, part, channel_id, other, distance. Part `member`
    has a row for each channel, whose other is the first of its copies; part `pair` has the pairs of these first ones."""
    of = cut(copies(profile))
    members = of.select("structure_id", F.lit("member").alias("part"), "channel_id", F.col("first").alias("other"), F.lit(0.0).alias("distance"))
    pairs = channel_distance(_only(profile, of), most)
    return members.unionByName(pairs.withColumn("part", F.lit("pair")))


def drop_duplicates(profile: DataFrame, share: float = 0.9, within: float = 1.0) -> DataFrame:
    """Channels kept: from the shortest on, a longer one goes when over `share` of a kept shorter one's nodes lie on it."""
    if share < 1:
        # what covers the first of equal channels covers the others, and the first itself covers them if it is kept
        profile = _only(profile, copies(profile))
    length = profile.groupBy("structure_id", "channel_id").agg(F.max("distance").alias("length"), F.count("*").alias("n"))
    a = profile.select("structure_id", "channel_id", "node", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    b = profile.select("structure_id", F.col("channel_id").alias("other"), "x", "y", "z")
    hits = range_pairs(a, b, within, "structure_id").filter("channel_id <> other").select("structure_id", "channel_id", "other", "node").distinct()
    covers = hits.groupBy("structure_id", "channel_id", "other").count().alias("h").join(length.alias("l"), ["structure_id", "channel_id"]).join(length.select("structure_id", F.col("channel_id").alias("other"), F.col("length").alias("other_length")), ["structure_id", "other"])
    beaten = cut(covers.filter((F.col("count") > share * F.col("n")) & (F.struct("length", "channel_id") < F.struct("other_length", "other"))).select("structure_id", "channel_id", "other"))
    # a channel is kept once all that could drop it are dropped, and dropped once one of them is kept; the shortest open
    # channel of each structure is kept in any case, so every round settles some
    open_ = cut(length.select("structure_id", "channel_id"))
    kept = open_.limit(0)
    while True:
        live = beaten.join(open_.select("structure_id", "channel_id"), ["structure_id", "channel_id"], "left_semi")
        new = open_.join(live.select("structure_id", F.col("other").alias("channel_id")).distinct(), ["structure_id", "channel_id"], "left_anti")
        gone = beaten.join(new, ["structure_id", "channel_id"], "left_semi").select("structure_id", F.col("other").alias("channel_id")).distinct()
        kept = cut(kept.unionByName(new))
        open_ = cut(open_.join(new, ["structure_id", "channel_id"], "left_anti").join(gone, ["structure_id", "channel_id"], "left_anti"))
        if open_.isEmpty():
            return kept


# Names of the atoms of a backbone.
BACKBONE = ("C", "N", "O", "H", "CA", "P", "O1P", "O2P", "OP1", "OP2", "O5'", "C5'", "C4'", "O4'", "C1'", "C2'", "C3'", "O3'", "O2'")
#: Atoms that line a sample of a channel.
LINING_ATOMS = 5


def linings(profile: DataFrame, atoms: DataFrame, backbone: Column | None = None, n: int = LINING_ATOMS) -> DataFrame:
    """profile with side_chain and backbone: the residues (res_seq, chain, ins_code, res_name, in this order) of the n atoms
    nearest to each node. A residue all of whose atoms among these lie in the backbone lines with it, any other with its
    side chain. atoms: of scope_id, which is the profile's structure_id; backbone: whether a row of atoms is of one."""
    flag = F.upper("name").isin(*BACKBONE) if backbone is None else backbone
    by = ["structure_id", "channel_id", "node"]
    rest = [c for c in profile.columns if c not in by]
    asked = profile.select(*by, *[F.col(c).alias(f"p{c}") for c in "xyz"], F.struct(*rest).alias("_rest"))
    targets = atoms.select(F.col("scope_id").alias("structure_id"), "atom_id", "res_seq", "chain", "ins_code", "res_name", flag.alias("_b"), "x", "y", "z")
    met = k_nearest(asked, targets, n, ["structure_id"], ["atom_id"])
    # each node has one nearest atom: there its row of the profile rides along
    row = F.collect_list(F.when(F.col("rank") == 1, F.col("_rest"))).alias("_rows")
    residues = met.groupBy(*by, "res_seq", "chain", "ins_code").agg(F.min_by("res_name", "atom_id").alias("res_name"), F.min("_b").alias("_b"), row)
    one = F.struct("res_seq", "chain", "ins_code", "res_name")
    lined = residues.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(~F.col("_b"), one))).alias("side_chain"), F.array_sort(F.collect_list(F.when(F.col("_b"), one))).alias("backbone"), F.flatten(F.collect_list("_rows")).alias("_rows"))
    return lined.select(*by, "side_chain", "backbone", F.inline("_rows")).select(*by, *rest, "side_chain", "backbone")


def channel_layers(lined: DataFrame) -> DataFrame:
    """Runs of nodes of linings() with equal side chains and backbones: channel_id, layer (from 1), side_chain, backbone, the
    least of each radius column (radius, free_radius, b_radius, as far as they are there), start and end (the next layer's
    start, or the last node)."""
    key = F.struct(F.col("side_chain").alias("s"), F.col("backbone").alias("b"))
    runs = islands(lined, ["channel_id"], "node", key, "layer")
    radii = [c for c in ("radius", "free_radius", "b_radius") if c in lined.columns]
    layers = runs.groupBy("channel_id", "layer").agg(*(F.min_by(c, "node").alias(c) for c in ("side_chain", "backbone")), *(F.min(c).alias(c) for c in radii), F.min("distance").alias("start"), F.max("distance").alias("_last"))
    w = Window.partitionBy("channel_id").orderBy("layer")
    return layers.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("_last"))).drop("_last")


def layer_residues(layers: DataFrame) -> DataFrame:
    """A row for each layer and lining residue: channel_id, layer, res_seq, chain, ins_code, res_name and on_backbone."""
    rows = lambda c, on: layers.select("channel_id", "layer", F.inline(c)).withColumn("on_backbone", F.lit(on))
    return rows("side_chain", False).unionByName(rows("backbone", True))


def channel_flow(layers: DataFrame) -> DataFrame:
    """Residues in the order in which they first line the channel, by chain and number inside a layer; a residue's backbone
    stands apart from its side chain: channel_id, chain, res_seq, ins_code, on_backbone, first_layer and position (from 1)."""
    first = layer_residues(layers).groupBy("channel_id", "chain", "res_seq", "ins_code", "on_backbone").agg(F.min("layer").alias("first_layer"))
    w = Window.partitionBy("channel_id").orderBy("first_layer", "chain", "res_seq", "ins_code", "on_backbone")
    return first.withColumn("position", F.row_number().over(w))


def channel_means(layers: DataFrame, properties: DataFrame, backbone: DataFrame) -> DataFrame:
    """property_means() over all occurrences of residues in a channel's layers."""
    rows = layer_residues(layers).select("channel_id", "res_name", (~F.col("on_backbone")).alias("side_chain"))
    return property_means(rows, properties, backbone, ["channel_id"])


def lining_layers(lined: DataFrame) -> DataFrame:
    """lined(channel_id, node, distance, radius, residues: sorted array of texts): consecutive equal linings are a layer.

    channel_id, layer (from 1), lining, least radius, start and end (the next layer's start, or the last node).
    """
    runs = islands(lined.withColumn("_k", F.array_join("residues", ",")), ["channel_id"], "node", F.col("_k"), "layer")
    layers = runs.groupBy("channel_id", "layer").agg(F.first("_k").alias("lining"), F.min("radius").alias("radius"), F.min("distance").alias("start"), F.max("distance").alias("_last"))
    w = Window.partitionBy("channel_id").orderBy("layer")
    return layers.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("_last"))).drop("_last")


def residue_flow(layers: DataFrame) -> DataFrame:
    """Residues of layers(channel_id, layer, lining) in the order of their first layer."""
    r = layers.select("channel_id", "layer", F.explode(F.split("lining", ",")).alias("residue")).filter("residue <> ''").groupBy("channel_id", "residue").agg(F.min("layer").alias("first_layer"))
    return r.withColumn("position", F.dense_rank().over(Window.partitionBy("channel_id").orderBy("first_layer", "residue")))


def bottleneck_layer(layers: DataFrame, least_end: float = 3.0) -> DataFrame:
    """The narrowest layer that ends at least_end or later, else the narrowest after the first."""
    far = F.col("end") >= least_end
    rank = F.when(far, 0).when(F.col("layer") > 1, 1).otherwise(2)
    return layers.groupBy("channel_id").agg(F.min_by(F.struct("layer", "radius"), F.struct(rank, F.col("radius"), F.col("layer"))).alias("_b")).select("channel_id", "_b.layer", "_b.radius")


def local_minima(layers: DataFrame, flat: float = 0.005) -> DataFrame:
    """Layers narrower than both neighbours; neighbours within `flat` of each other are one plateau."""
    w = Window.partitionBy("channel_id").orderBy("layer")
    step = F.coalesce(F.abs(F.col("radius") - F.lag("radius").over(w)) > flat, F.lit(True))
    runs = layers.withColumn("_s", step.cast("int")).withColumn("_i", F.sum("_s").over(w))
    level = runs.groupBy("channel_id", "_i").agg(F.min("radius").alias("_r"), F.min("layer").alias("_from"), F.max("layer").alias("_to"))
    v = Window.partitionBy("channel_id").orderBy("_i")
    low = (F.coalesce(F.lag("_r").over(v) > F.col("_r"), F.lit(False))) & F.coalesce(F.lead("_r").over(v) > F.col("_r"), F.lit(True))
    return level.withColumn("_low", low).filter("_low").select("channel_id", F.explode(F.sequence("_from", "_to")).alias("layer"))


def property_sums(residues: DataFrame, properties: DataFrame, by: list[str]) -> DataFrame:
    """residues(by, res_name) against properties(res_name, charge, ionizable, mutability, hydropathy): sums and means."""
    p = residues.join(F.broadcast(properties), "res_name")  # a row for each of 20 names
    c = F.col("charge")
    return p.groupBy(*by).agg(F.sum(c).alias("charge"), F.sum("ionizable").alias("ionizable"), F.count_if(c > 0).alias("positives"), F.count_if(c < 0).alias("negatives"), F.floor(F.avg("mutability")).alias("mutability"), F.avg("hydropathy").alias("hydropathy"))


def property_means(residues: DataFrame, properties: DataFrame, backbone: DataFrame, by: list[str]) -> DataFrame:
    """Means of hydropathy, hydrophobicity, polarity, log_p, log_d and log_s over side chains and backbones.

    residues(by, res_name, side_chain boolean): those with a side chain in the lining count with their own properties
    (res_name, ...), all others with backbone's. backbone has those columns, with two of its rows named as sources: GLY
    (hydropathy, hydrophobicity), ASN (polarity), and the row BACKBONE (log_p, log_d, log_s). 0 without any residue.
    """
    names = ["hydropathy", "hydrophobicity", "polarity", "log_p", "log_d", "log_s"]
    own = residues.filter("side_chain").join(F.broadcast(properties), "res_name").select(*by, *names)  # a row for each of 20 names
    of = lambda c, r: F.max(F.when(F.col("res_name") == r, F.col(c))).alias(c)
    base = backbone.agg(of("hydropathy", "GLY"), of("hydrophobicity", "GLY"), of("polarity", "ASN"), *(of(c, "BACKBONE") for c in names[3:]))
    rest = residues.filter("not side_chain").select(*by).crossJoin(F.broadcast(base))  # one row
    return own.unionByName(rest.select(*by, *names)).groupBy(*by).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names))


def layer_weighted(layers: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of values(residue, value) over all occurrences of residues in the layers of each channel."""
    r = layers.select("channel_id", F.explode(F.split("lining", ",")).alias("residue")).filter("residue <> ''")
    return r.join(values, "residue").groupBy("channel_id").agg((F.sum("value") / F.count("value")).alias("value"))
