"""Edges between places and units, and features along them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, geo
from ..functions.stats import count_if
from ..session import durable_table
from .ranges import RANGE, attach, in_ranges, ranked, rows_before
from .reshape import union_all
from .windows import mutual_top_k, top_k

# Neighbours, cosine threshold and the distance-edge steps.
K_NEIGHBOURS = 8
MIN_COSINE = 0.1
DISTANCE_STEPS = ((250, 0.114), (500, 0.057), (750, 0.028), (1000, 0.013))
DENSITY_SCALE = 40
#: Half the levels of the quadtree (bits of a coordinate in each of two numbers), places of the curve handled together, and places in a read block.
HALF, CURVE_BLOCK, READ_BLOCK = 25, 4096, 64
#: Meetings of two nodes in one task of the cosine join, and rows and keys multiplied together in the dense one.
TASK_PAIRS, STRIP = 1 << 21, 1024
#: Steps of a weight between 0 and 1 in the bounds of the cosine join.
UP = 32767
#: Nodes whose edges one task gathers, and places that one task searches: small inputs unfold to far more than their files say.
TASK_NODES, TASK_PLACES = 1 << 16, 1 << 10


def _spread(df: DataFrame, reach) -> DataFrame:
    """Each row once per cell of the square around its (gi, gj), which are replaced.

    Two plain explodes: nested lambdas would leave generated code.
    """
    r = F.lit(reach) if isinstance(reach, int) else reach
    steps = F.sequence(-r, r)
    moved = df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return moved.withColumn("gi", F.col("gi") + F.col("_i")).withColumn("gj", F.col("gj") + F.col("_j")).drop("_i", "_j")


def contiguity_edges(cells: DataFrame) -> DataFrame:
    """Directed (src, dst) of units whose grid indexes differ by at most one."""
    near = _spread(cells.select(F.col("unit_id").alias("src"), "gi", "gj"), 1)
    there = cells.select(F.col("unit_id").alias("dst"), "gi", "gj")
    return near.join(there, ["gi", "gj"]).filter(F.col("src") != F.col("dst")).select("src", "dst")


def units_within(cells: DataFrame, radius_m: float, step: Sequence[float]) -> DataFrame:
    """Directed unit pairs within a radius, scaled at the source's latitude.

    A centroid lies inside its cell, so partners sit at most
    ceil(radius / cell size) + 1 cells away: an equi-join on neighbour cells.
    """
    height = step[0] * geo.METRES_PER_DEGREE
    width = step[1] * geo.METRES_PER_DEGREE * math.cos(math.radians(60))  # safe below 60 degrees
    reach = max(math.ceil(radius_m / height), math.ceil(radius_m / width)) + 1
    near = _spread(cells.select(F.col("unit_id").alias("src"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"),
                                F.col("n_poi").alias("src_poi"), "gi", "gj"), reach)
    there = cells.select(F.col("unit_id").alias("dst"), "lat", "lon", F.col("n_poi").alias("dst_poi"), "gi", "gj")
    pairs = near.join(there, ["gi", "gj"]).filter(F.col("src") != F.col("dst"))
    d = geo.flat_distance(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"))
    return pairs.withColumn("dist_m", d).filter(F.col("dist_m") <= radius_m).select(
        "src", "dst", "dist_m", "src_poi", "dst_poi")


def distance_edges(cells: DataFrame, step: Sequence[float] = geo.GRID_STEP,
                   steps: Sequence[Sequence[float]] = DISTANCE_STEPS, density: float = DENSITY_SCALE) -> DataFrame:
    """Pairs within the last step, weighted by distance step and pair density."""
    pairs = units_within(cells, steps[-1][0], step)
    ladder = F.lit(0.0)
    for upper, weight in reversed(steps):
        ladder = F.when(F.col("dist_m") <= upper, F.lit(weight)).otherwise(ladder)
    filled = F.least(F.least("src_poi", "dst_poi") / F.lit(float(density)), F.lit(1.0))
    return pairs.select("src", "dst", "dist_m", (ladder * filled).alias("w"))


def _spread_bits(x):
    """The low 25 bits of a number with a gap behind each."""
    for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, step)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _curve(gi, gj):
    """Place of a finest cell on the quadtree's curve as two numbers: cells of one level and place share a prefix."""
    low = F.lit((1 << HALF) - 1).cast("long")
    return [F.shiftleft(_spread_bits(i), 1).bitwiseOR(_spread_bits(j)) for i, j in (
        (F.shiftright(gi, HALF), F.shiftright(gj, HALF)), (gi.bitwiseAND(low), gj.bitwiseAND(low)))]


def _depths(spots: DataFrame, k: int) -> DataFrame:
    """``spots``, numbered along the curve by ``pos``, with the level of the smallest cell of the quadtree that holds a spot and k others.

    Any k + 1 spots of a cell are neighbours on the curve, so that level is the longest prefix that a spot
    has in common with all of some k + 1 neighbours it is one of. Neighbours come from blocks of the curve that
    overlap by k spots; a block is a bounded task.
    """
    at, block = F.col("pos") - 1, F.floor((F.col("pos") - 1) / CURVE_BLOCK)
    beside = F.array(block, F.when(at % CURVE_BLOCK < k, block - 1), F.when(at % CURVE_BLOCK >= CURVE_BLOCK - k, block + 1))
    rows = spots.withColumn("_block", F.explode(F.filter(beside, lambda b: b >= 0)))
    along = Window.partitionBy("_block").orderBy("pos")
    high, low = (F.col(z).bitwiseXOR(F.lead(z, k).over(along)) for z in ("zh", "zl"))
    differ = lambda x, top: top - F.floor((F.length(F.bin(x)) + 1) / 2)
    rows = rows.withColumn("_common", F.when(high.isNull(), None).when(high != 0, differ(high, HALF)).when(low != 0, differ(low, 2 * HALF)).otherwise(2 * HALF))
    deepest = F.max("_common").over(along.rowsBetween(-k, 0))
    return rows.withColumn("level", F.coalesce(deepest, F.lit(0)).cast("int")).filter(F.col("_block") == block).drop("_block", "_common")


def _tasks(df: DataFrame, rows: int) -> int:
    """How many tasks get about ``rows`` rows each."""
    return max(1, math.ceil(df.count() / rows))


def knn_lists(nodes: DataFrame, k: int = K_NEIGHBOURS) -> DataFrame:
    """(node_id, peer_id, dist_m, rank): the k nearest others by (distance, id), exact.

    * Nodes of one place share a candidate list, and only the k+1 smallest ids of
      a place can be near anything, so a place with any number of nodes counts
      as k+1.
    * Places lie in an adaptive quadtree: each is searched from the smallest cell that
      holds k+1 places, however deep that is (down to 2**-50 of the extent). A cell's places are within its diagonal, so
      all cells of its size within that reach are read and nothing nearer can be missed. A cell serves
      at most 4k places of its own, as each of its quarters holds k or is served by a deeper cell. So a place is read
      by a bounded number of others on each scale on which it lies in a cluster, however dense that is and however far an outlier.
    * Cells are stretches of the quadtree's curve, along which each place is stored once; a stretch is found by counting
      places before its ends.

    For extents of up to 30 degrees and latitudes of up to 66, where cell sides bound distances to within the
    five percent of slack used; beyond, ValueError. Places without a coordinate have no neighbours.
    """
    nodes = nodes.select("node_id", "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL")
    dist = geo.haversine("qlat", "qlon", "lat", "lon")
    flat = knn_pairs(nodes, k).withColumn("dist_m", dist).filter("dist_m <= within").select("qlat", "qlon", "dist_m", F.explode("ids").alias("peer_id"))
    near_ids = top_k(flat, ["qlat", "qlon"], [F.col("dist_m"), F.col("peer_id")], k + 1, "_r")
    shared = near_ids.groupBy(F.col("qlat").alias("lat"), F.col("qlon").alias("lon")).agg(
        F.array_sort(F.collect_list(F.struct("dist_m", "peer_id"))).alias("near"))  # at most k+1
    own = nodes.join(shared.hint("merge"), ["lat", "lon"])  # neither side is broadcast by the size of a compressed file; a place with a large share of the nodes is split
    others = F.slice(F.filter("near", lambda x: x["peer_id"] != F.col("node_id")), 1, k)
    return own.select("node_id", F.posexplode(others).alias("pos", "n")).select(
        "node_id", F.col("n.peer_id").alias("peer_id"), F.col("n.dist_m").alias("dist_m"), (F.col("pos") + 1).alias("rank"))


def knn_pairs(nodes: DataFrame, k: int) -> DataFrame:
    """(qlat, qlon, lat, lon, ids, within): each place with the places of the cells it reads and the reach of its search in metres."""
    box = nodes.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")).first()
    south, north, west, east = (0.0,) * 4 if box.s is None else (float(v) for v in box)
    far, near = max(abs(south), abs(north)), 0.0 if south <= 0 <= north else min(abs(south), abs(north))
    if max(north - south, east - west) > 30 or far > 66:
        raise ValueError(f"extent {south}..{north}, {west}..{east} is beyond 30 degrees or latitude 66")
    # a cell of level l is h / 2**l degrees high and as wide in metres where it is narrowest
    cos_far = math.cos(math.radians(far))
    h = max(north - south, (east - west) * cos_far, 1e-6) * 1.001
    diagonal = math.sqrt(1 + (math.cos(math.radians(near)) / cos_far) ** 2) * 1.05
    reach = math.ceil(diagonal)

    first = top_k(nodes, ["lat", "lon"], [F.col("node_id")], k + 1, "_r")
    spots = first.groupBy("lat", "lon").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))  # at most k+1
    finest = float(1 << 2 * HALF)
    spots = spots.withColumns({"gi": F.floor((F.col("lat") - south) / h * finest).cast("long"), "gj": F.floor((F.col("lon") - west) * cos_far / h * finest).cast("long")})
    zh, zl = _curve(F.col("gi"), F.col("gj"))
    spots = durable_table(_depths(ranked(spots.withColumns({"zh": zh, "zl": zl}), [], ["zh", "zl", "lat", "lon"], "pos"), k))  # read four times below
    up = f"{2 * HALF} - level"
    chosen = spots.select("lat", "lon", "level", F.expr(f"shiftright(gi, {up})").alias("ci"), F.expr(f"shiftright(gj, {up})").alias("cj"))

    steps = F.sequence(F.lit(-reach), F.lit(reach))
    pairs = chosen.select("level", "ci", "cj").distinct().withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns(
        {"ai": F.col("ci") + F.col("_i"), "aj": F.col("cj") + F.col("_j")}).drop("_i", "_j")
    side = F.expr("shiftleft(1L, level)")
    pairs = pairs.filter((F.col("ai") >= 0) & (F.col("aj") >= 0) & (F.col("ai") < side) & (F.col("aj") < side))
    asked = pairs.select("level", "ai", "aj").distinct()
    ends = asked.withColumn("_kind", F.explode(F.array(F.lit(0), F.lit(2)))).withColumn("_end", (F.col("_kind") / 2).cast("long"))
    corner = [F.expr(f"shiftleft({c} + _end, {up}) - _end") for c in ("ai", "aj")]  # the first and the last finest cell
    mark_h, mark_l = _curve(*corner)
    marks = ends.withColumns({"zh": mark_h, "zl": mark_l}).drop("_end")
    both = in_ranges(marks.unionByName(spots.select("zh", "zl", F.lit(1).alias("_kind")), allowMissingColumns=True), ["zh", "zl", "_kind"])
    is_spot = (F.col("_kind") == 1).cast("long")
    before = rows_before(both.groupBy(RANGE).agg(F.sum(is_spot).alias("_n")))
    here = F.sum(is_spot).over(Window.partitionBy(RANGE).orderBy("zh", "zl", "_kind"))
    counted = attach(both.withColumn("_here", here), before, [], "_before").filter("_kind <> 1").withColumn("upto", F.col("_here") + F.coalesce("_before", F.lit(0)))
    stretch = counted.groupBy("level", "ai", "aj").agg(F.min("upto").alias("lo"), F.max("upto").alias("hi")).filter("lo < hi")
    blocks = stretch.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / READ_BLOCK), F.floor((F.col("hi") - 1) / READ_BLOCK))))

    there = spots.select("lat", "lon", "ids", (F.col("pos") - 1).alias("at"), F.floor((F.col("pos") - 1) / READ_BLOCK).alias("_b"))
    read = blocks.join(there, "_b").filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("level", "ai", "aj", "lat", "lon", "ids")
    tasks = _tasks(spots, TASK_PLACES)
    asks = chosen.withColumnsRenamed({"lat": "qlat", "lon": "qlon"}).repartition(tasks, "level", "ci", "cj")
    found = read.repartition(tasks, "level", "ai", "aj").join(pairs, ["level", "ai", "aj"]).join(asks, ["level", "ci", "cj"])
    within = F.lit(diagonal * h * geo.EARTH_RADIUS_M * math.pi / 180) / F.pow(F.lit(2.0), F.col("level"))
    return found.select("qlat", "qlon", "lat", "lon", "ids", F.when(F.col("level") == 0, F.lit(math.inf)).otherwise(within).alias("within"))


def knn_edges(nodes: DataFrame, k: int = K_NEIGHBOURS) -> DataFrame:
    """Undirected (a < b) edges to the k nearest others with the distance."""
    near = knn_lists(nodes, k)
    a, b = F.least("node_id", "peer_id"), F.greatest("node_id", "peer_id")
    # an edge comes twice at most, so adding up before the shuffle would only hold all edges of a task
    ends = near.select(a.alias("a"), b.alias("b"), "dist_m").repartition(_tasks(nodes, TASK_NODES), "a", "b")
    return ends.groupBy("a", "b").agg(F.min("dist_m").alias("dist_m"))


def json_vectors(df: DataFrame, node: str, text: str) -> DataFrame:
    """(node_id, key, w): JSON count objects summed per node and key."""
    flat = df.filter(F.col(text).isNotNull()).select(F.col(node).alias("node_id"), F.explode(arrays.counts_map(F.col(text))).alias("key", "v"))
    return flat.groupBy("node_id", "key").agg(F.sum("v").alias("w"))


def _numbered(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(entries, ids, nodes): unit vectors (code, key, u), node ids and their number; codes count the nodes of positive length from 0 in the order of their ids."""
    vectors = durable_table(vectors.select("node_id", "key", "w"))  # read twice
    lengths = vectors.groupBy("node_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_len")).filter("_len > 0 AND node_id IS NOT NULL")
    ids = durable_table(ranked(lengths, [], ["node_id"], "code").withColumn("code", (F.col("code") - 1).cast("int")))
    # sizes of compressed files say little, so a broadcast of all nodes is ruled out
    entries = vectors.join(ids.hint("merge"), "node_id").select("code", "key", (F.col("w") / F.col("_len")).alias("u"))
    return entries, ids, ids.count()


def _named(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of codes as edges of node ids."""
    src, dst = (ids.select(F.col("code").alias(f"_{end}"), F.col("node_id").alias(end)).hint("merge") for end in ("src", "dst"))
    coded = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "cos")
    return coded.join(src, "_src").join(dst, "_dst").select("src", "dst", "cos")


def _holder_lists(offered: DataFrame, block_rows: int, parts: int) -> DataFrame:
    """(ours, theirs): holders (code, up, rest) of a key that meet, each a list in the order of codes; every pair of holders of a key once.

    Up to ``block_rows`` holders are one list, which meets itself from each holder on; more are cut into lists, each of which meets itself and all later ones.
    """
    holder = F.array_sort(F.collect_list(F.struct("code", "up", "rest"))).alias("ours")
    few = offered.filter(F.col("_df") <= block_rows).repartition(parts, "key").groupBy("key").agg(holder).select("ours", F.lit(None).alias("theirs"))
    many = offered.filter(F.col("_df") > block_rows).select("key", "_df", "code", "up", "rest")
    if many.isEmpty():
        return few
    place = ranked(many, ["key"], ["code"], "_place")
    lists = durable_table(place.groupBy("key", F.floor((F.col("_place") - 1) / block_rows).alias("_b")).agg(holder, F.max(F.ceil(F.col("_df") / block_rows)).alias("_n")))
    later = lists.filter("_b + 1 < _n").select("key", "ours", F.explode(F.sequence(F.col("_b") + 1, F.col("_n") - 1)).alias("_b"))
    met = later.hint("merge").join(lists.select("key", "_b", F.col("ours").alias("theirs")), ["key", "_b"]).select("ours", "theirs")
    return few.unionByName(lists.select("ours", F.lit(None).alias("theirs"))).unionByName(met)


def cosine_edges(vectors: DataFrame, min_cos: float = MIN_COSINE, k: int = K_NEIGHBOURS, mode: str = "mutual", block_rows: int = 1000) -> DataFrame:
    """(src, dst, cos) of sparse vectors (node_id, key, w) with cosine >= min_cos > 0.

    ``mutual`` keeps each pair once (src < dst) if it ranks k or better at either
    end; ``directed`` keeps the k best per source. Integer or text node ids, weights of either sign.

    A norm-bounded inverted join. Keys are ordered from rare to common, and a node
    offers its keys in that order until the norm of those left is below
    ``min_cos``. Two nodes at the floor share a key that both offer: say x stops offering
    first; if no key up to there is shared, the dot product lies within what x has left, and is at
    most its norm (Cauchy-Schwarz, any signs). So common keys are joined only where a node has little else.
    A holder of an offered key is sent the packed list of the key's later holders, each six bytes: its number and its
    weight rounded up to 15 bits. Products of these bound the cosine from above; they are added up in as many tasks as the meetings
    need. The few pairs whose bound reaches the floor get their exact cosine from the whole vectors. Where nearly all pairs share keys, see ``dense_cosine_edges``.
    """
    entries, ids, _ = _numbered(vectors)
    unit = durable_table(entries)
    common = durable_table(unit.groupBy("key").agg(F.count("*").alias("_df")).filter(F.col("_df") > block_rows))
    all_offered = common.isEmpty()
    if all_offered:  # keys of one list cost little, so all of them are offered
        unit = unit.select("*", F.lit(1).cast("long").alias("_df"), F.lit(True).alias("_offered"), F.lit(0.0).alias("rest"))
    else:
        common_first = Window.partitionBy("code").orderBy(F.desc_nulls_last("_df"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        left = unit.join(common, "key", "left").withColumn("_left", F.sqrt(F.sum(F.col("u") * F.col("u")).over(common_first)))
        # rounding may only make a node offer more
        left = left.withColumn("_offered", (F.col("_left") >= min_cos * (1 - 1e-9)) | F.col("_df").isNull())
        rest = F.max(F.when(~F.col("_offered"), F.col("_left"))).over(common_first)
        unit = durable_table(left.select("code", "key", "u", F.coalesce("_df", F.lit(1).cast("long")).alias("_df"), "_offered", F.coalesce(rest, F.lit(0.0)).alias("rest")))
    up = F.least(F.ceil(F.abs("u") * UP), F.lit(UP)).cast("short")
    offered = unit.filter("_offered").withColumn("up", up)

    n = F.col("_n")
    meetings = offered.groupBy("key").agg(F.count("*").alias("_n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    parts = max(1, math.ceil(meetings / TASK_PAIRS))
    lists = _holder_lists(offered, block_rows, parts)
    sent = lists.select("ours", F.coalesce("theirs", "ours").alias("theirs"), F.col("theirs").isNull().alias("_same"))
    columns = ("code", "up") if all_offered else ("code", "up", "rest")
    sent = sent.select(F.posexplode("ours").alias("_at", "x"), "_same", *[F.col(f"theirs.{c}").alias(f"_{c}") for c in columns])
    first = F.when(F.col("_same"), F.col("_at") + 2).otherwise(1)
    sent = sent.select(F.col("x.code").alias("src"), F.col("x.up").alias("xu"), F.col("x.rest").alias("xr"), *[F.slice(f"_{c}", first, F.size("_code")).alias(f"_{c}") for c in columns])
    sent = sent.filter(F.size("_code") > 0).repartition(parts, "src")
    met = sent.select("src", "xu", "xr", F.inline(F.arrays_zip(*[f"_{c}" for c in columns])).alias(*["dst", "yu", "yr"][:len(columns)]))
    bound = F.sum(F.col("xu").cast("long") * F.col("yu")) / F.lit(float(UP * UP))
    rest = F.lit(0.0) if all_offered else F.max(F.greatest("xr", "yr"))
    found = met.groupBy("src", "dst").agg(bound.alias("bound"), rest.alias("rest")).filter(F.col("bound") + F.col("rest") >= min_cos - 1e-8)
    found = durable_table(found.select("src", "dst"))

    of = lambda end: unit.select(F.col("code").alias(end), "key", F.col("u").alias(f"_{end}"))
    both_ends = found.hint("merge").join(of("src"), "src").hint("merge").join(of("dst"), ["dst", "key"])
    scored = both_ends.groupBy("src", "dst").agg(F.sum(F.col("_src") * F.col("_dst")).alias("cos")).filter(F.round("cos", 9) >= min_cos)
    rank_by = F.round("cos", 9)
    if mode != "directed":
        return _named(mutual_top_k(scored, rank_by, k), ids)
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return _named(top_k(scored.select(both.alias("e"), "cos").select("e.*", "cos"), ["src"], [rank_by.desc(), F.col("dst")], k, "_r").drop("_r"), ids)


def _best(rows: np.ndarray, cols: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row by (9 decimals of the cosine, descending; column)."""
    order = np.lexsort((cols, -np.round(cos, 9), rows))
    first = np.searchsorted(rows[order], rows[order])
    return order[np.arange(len(order)) - first < k]


def _best_of_strip(cos: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, ...]:
    """(rows, columns, cosines) of the k best of each row of a matrix from ``floor`` on."""
    bar = np.full((len(cos), 1), floor)
    if cos.shape[1] > k:
        bar = np.maximum(bar, np.partition(cos, -k, axis=1)[:, -k, None] - 2e-9)  # all that 9 decimals cannot tell from the k-th
    rows, cols = np.nonzero(cos >= bar)
    value = cos[rows, cols]
    at = _best(rows, cols, value, k)
    return rows[at], cols[at], value[at]


def _meet_blocks(key: tuple, table: pa.Table, min_cos: float, k: int, mutual: bool) -> pa.Table:
    """The k best peers of each node of two blocks in the other (or in the only one, if it meets itself), in strips of rows."""
    first, second = (v.as_py() for v in key)
    table = table.sort_by("code")
    codes, side = table["code"].to_numpy(), table["side"].to_numpy()
    sizes = np.diff(table["keys"].combine_chunks().offsets.to_numpy())
    keys, at = np.unique(table["keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    us, node = table["us"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(codes)), sizes)
    by_key = np.argsort(at, kind="stable")
    node, at, us = node[by_key], at[by_key], us[by_key]
    ours = np.flatnonzero(side == first)
    theirs = ours if first == second else np.flatnonzero(side == second)
    found = {"s": [], "d": []}
    for low in range(0, len(ours), STRIP):
        rows = ours[low:low + STRIP]
        cos = np.zeros((len(rows), len(theirs)))
        for start in range(0, len(keys), STRIP):
            a, b = np.searchsorted(at, (start, start + STRIP))
            dense = np.zeros((len(codes), min(STRIP, len(keys) - start)))
            dense[node[a:b], at[a:b] - start] = us[a:b]
            cos += dense[rows] @ dense[theirs].T
        if first == second:
            itself = np.arange(len(rows))
            later = np.arange(len(theirs)) > (low + itself)[:, None]
            cos[~later if mutual else ~later & (np.arange(len(theirs)) == (low + itself)[:, None])] = -2.0
        x, y, value = _best_of_strip(cos, min_cos - 1e-9, k)
        found["s"].append((codes[rows[x]], codes[theirs[y]], value))
        if mutual or first != second:
            y, x, value = _best_of_strip(np.ascontiguousarray(cos.T), min_cos - 1e-9, k)
            found["d"].append((codes[theirs[y]], codes[rows[x]], value))
    out = []
    for end, strips in found.items():
        if strips:
            own, peer, value = (np.concatenate(c) for c in zip(*strips))
            kept = _best(own, peer, value, k)
            out.append(pa.table({"end": pa.array([end if mutual else "s"] * len(kept), pa.string()), "node": pa.array(own[kept], pa.int32()), "peer": pa.array(peer[kept], pa.int32()), "cos": pa.array(value[kept], pa.float64())}))
    return pa.concat_tables(out)


def dense_cosine_edges(vectors: DataFrame, min_cos: float = MIN_COSINE, k: int = K_NEIGHBOURS, mode: str = "mutual", block_nodes: int = 8192) -> DataFrame:
    """The edges of ``cosine_edges`` where keys are so few and common that nearly all pairs of nodes share some.

    Every two blocks of nodes meet in one task, as a product of matrices in strips of rows and of keys, and only
    the k best of each node leave it. Time is quadratic in the nodes whatever is done, as nearly every pair is at the floor;
    memory is that of two blocks, and what is sent is each node once and k peers once per block.
    """
    entries, ids, n = _numbered(vectors)
    size = max(1, min(block_nodes, math.ceil(n / 8)))  # some tasks for small tables too
    blocks = math.ceil(n / size)
    keys = durable_table(ranked(entries.select("key").distinct(), [], ["key"], "_no"))
    packed = durable_table(entries.join(keys, "key").groupBy("code").agg(F.collect_list(F.struct(F.col("_no").cast("int").alias("no"), "u")).alias("_e")).select(
        "code", F.floor(F.col("code") / size).cast("int").alias("side"), F.col("_e.no").alias("keys"), F.col("_e.u").alias("us")))
    meeting = F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))).alias("_o")
    sides = packed.select("*", meeting).select(F.least("side", "_o").alias("p"), F.greatest("side", "_o").alias("q"), "code", "side", "keys", "us")
    mutual = mode != "directed"

    def meet(key, table):
        return _meet_blocks(key, table, min_cos, k, mutual)

    near = sides.repartition(max(1, blocks * (blocks + 1) // 2), "p", "q").groupBy("p", "q").applyInArrow(meet, "end string, node int, peer int, cos double")
    near = near.filter(F.round("cos", 9) >= min_cos)
    best = top_k(near, ["end", "node"], [F.round("cos", 9).desc(), F.col("peer")], k, "_r")
    turned = F.col("end") == "d"
    edges = best.select(F.when(turned, F.col("peer")).otherwise(F.col("node")).alias("src"), F.when(turned, F.col("node")).otherwise(F.col("peer")).alias("dst"), "cos")
    return _named(edges.dropDuplicates(["src", "dst"]) if mutual else edges, ids)


def edge_report(edges: DataFrame) -> DataFrame:
    """One row: edges, source nodes, mean weight and degree mean, min, max."""
    per_node = edges.groupBy("src").agg(F.count("*").alias("deg"), F.sum("w").alias("w"))
    return per_node.agg(F.coalesce(F.sum("deg"), F.lit(0).cast("long")).alias("n_edges"), F.count("*").alias("n_nodes"),
                        (F.sum("w") / F.sum("deg")).alias("mean_w"), F.round(F.avg("deg"), 1).alias("degree_mean"),
                        F.min("deg").alias("degree_min"), F.max("deg").alias("degree_max"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and nodes without any edge end."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("_t", F.lit(True))
    return nodes.select("node_id").join(touched, "node_id", "left").agg(
        F.count("*").alias("n_nodes"), count_if(F.col("_t").isNull()).alias("n_isolated"))


def merge_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two undirected families, mean of the weights present, both directions."""
    both = union_all([a.select("src", "dst", "w"), b.select("src", "dst", "w")])
    one = both.groupBy(F.least("src", "dst").alias("s"), F.greatest("src", "dst").alias("d")).agg(F.avg("w").alias("w"))
    ends = F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("d").alias("dst")),
                             F.struct(F.col("d").alias("src"), F.col("s").alias("dst"))))
    return one.select(ends.alias("e"), "w").select("e.src", "e.dst", "w")


def normalized_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Symmetric degree-normalised weights of max(A, At) with unit self loops."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    loops = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0).alias("w"))
    base = union_all([edges.select("src", "dst", "w"), flipped]).filter(F.col("src") != F.col("dst"))
    sym = union_all([base.groupBy("src", "dst").agg(F.max("w").alias("w")), loops])
    degree = sym.groupBy("src").agg(F.sum("w").alias("deg"))
    return (sym.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("deg").alias("deg_d")), "dst")
            .select("src", "dst", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg_d"))).alias("w")))


def neighbor_features(features: DataFrame, weights: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Weighted sums of the neighbours' feature columns."""
    h = features.select(F.col("node_id").alias("dst"), *columns)
    return weights.join(h, "dst").groupBy(F.col("src").alias("node_id")).agg(
        *[F.sum(F.col("w") * F.col(c)).alias(f"{c}_near") for c in columns])


def split_windows(spine: DataFrame, length: int = 48, step: int = 6, context: int = 24) -> DataFrame:
    """Hour windows whose scored part (after the context) lies in one split.

    ``spine``: one row per hour with ``hour_idx`` from 0 and ``split``. Each hour
    is given to the windows that score it, so windows are plain groups.
    """
    last = spine.agg(F.max("hour_idx").alias("_last"))
    h = F.col("hour_idx")
    lo = F.greatest(F.ceil((h - length + 1) / F.lit(step)), F.lit(0))
    hi = F.floor((h - context) / F.lit(step))
    scored = spine.filter(h >= context).select(
        "hour_idx", "split", F.explode(F.filter(F.sequence(lo, F.greatest(hi, lo)), lambda s: s <= hi)).alias("s"))
    by = scored.groupBy((F.col("s") * step).alias("start_idx")).agg(
        F.countDistinct("split").alias("n_split"), F.count("*").alias("n_hours"), F.count("split").alias("n_set"),
        F.min("split").alias("split"))
    whole = by.join(F.broadcast(last)).filter(F.col("start_idx") + length - 1 <= F.col("_last"))
    kept = whole.filter((F.col("n_split") == 1) & (F.col("n_set") == F.col("n_hours")))
    return kept.select("start_idx", "split")
