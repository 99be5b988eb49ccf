"""MinHash near-duplicates by an inverted join on signature coordinates.

A document is the set of its distinct shingles of ``width`` words (A-Z lower-cased, words between white space; fewer
words make one shingle). Its signature holds, for each of ``coords`` hash functions, the smallest value over the set.
Two sets of Jaccard similarity j agree in each coordinate with chance j, so a pair at the wanted similarity agrees in
at least ``least`` coordinates but for a stated chance (``least_matches``).

Equal sets are one class; classes, not documents, are compared. Classes are posted under their (coordinate, value)
pairs. A pair that agrees in ``least`` of ``coords`` coordinates shares one of its ``coords - least + 1`` rarest ones, so only
those lists are merged (prefix); the longer lists are skipped and probed by comparing signatures of the candidates that
the short ones gave. Pairs above the match threshold are confirmed on the full sets.

No list is paired with itself. First every class meets the leader of each of its lists, the class whose coordinates are
the most common, and the links found are closed to components. Lists of one component are done. In the others each
leader gets a centre C: its set and the shingles that most of its members add to it. Let d(x) be the number of shingles in which x differs from C, D(x) these
differences (added or lacked), s = (den - num) / (den + num), and e(x) = d(x) - s |x|; sets x and y are linked if and only if they
differ in at most s (|x| + |y|) shingles, and they differ in d(x) + d(y) - 2 |D(x) and D(y)|.

* If e(x) + e(y) <= 0 they are linked, whatever they share. So each member whose e allows it is linked to the member m of the least e, one link a member.
* If they are linked and share no difference, e(x) + e(y) <= 0, and as e(m) is least, both are linked to m: they are one component already.
* So linked members of different components share (e(x) + e(y)) / 2 > 0 differences or more. They meet over a shared one, differences being ordered from rare to common, and
  only where both have enough of them left from there on, and where their sizes and numbers of differences allow a link; the first that they share always passes.

This loses no pair, and families of thousands of copies that each add, drop or change a few words cost about one pair a member. Joins are on plain keys,
so adaptive execution splits hot ones.

Null and empty texts and texts without words have no shingles: they are linked with nothing, stay, and are their own
component. Repeated rows are copies of one class. A null id takes the smallest id of its component, or null.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, U64, components, list_array, map_texts, mix, stored, windows, word_hashes

_STEP = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def least_matches(coords: int, similarity: float, miss: float = 1e-6) -> int:
    """The largest threshold of agreeing coordinates that a pair at the similarity misses with a chance below ``miss``."""
    tail, k = 0.0, 0
    while k < coords:
        tail += comb(coords, k) * similarity**k * (1 - similarity) ** (coords - k)
        if tail >= miss:
            break
        k += 1
    return max(k, 1)


def shingles(body: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and how many each row has."""
    words, _, _, rows = word_hashes(LOWER[body], offs, NOT_SPACE)
    n = np.diff(rows)
    first, row = windows(rows, width)
    value = np.zeros(len(first), U64)
    for j in range(width):
        value += words[first + j] * _STEP[j]
    short = np.flatnonzero((n > 0) & (n < width))
    few = np.zeros(len(short), U64)
    for j in range(width - 1):
        has = n[short] > j
        few[has] += words[rows[short[has]] + j] * _STEP[j]
    few += n[short].astype(U64) * _STEP[width]
    value, row = mix(np.r_[value, few]), np.r_[row, short]
    order = np.argsort(value)
    row = row[order]
    again = np.argsort(row.astype(np.uint16) if len(n) < 1 << 16 else row, kind="stable")
    value, row = value[order][again], row[again]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.bincount(row[new], minlength=len(n))


def _sketch(body: np.ndarray, offs: np.ndarray, width: int, coords: int) -> list[pa.Array]:
    value, n = shingles(body, offs, width)
    full = np.flatnonzero(n)
    start = (np.cumsum(n) - n)[full]
    keys = np.zeros((2, len(n)), U64)
    sig = np.zeros((len(n), coords), np.uint32)
    if len(full):
        for k in range(2):
            keys[k, full] = mix(np.add.reduceat(mix(value ^ _STEP[40 + k]), start) + n[full].astype(U64))
        factors = mix(np.arange(1, coords + 1, dtype=U64) * U64(0x2545F4914F6CDD1D)) | U64(1)
        for k in range(coords):
            sig[full, k] = np.minimum.reduceat(value * factors[k], start) >> U64(32)
    flat = pa.array(sig[full].ravel().view(np.int32))
    return [pa.array(n.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
            list_array(flat, np.where(n > 0, coords, 0))]


def _sets(body: np.ndarray, offs: np.ndarray, width: int) -> list[pa.Array]:
    value, n = shingles(body, offs, width)
    full = np.flatnonzero(n)
    key = np.zeros(len(n), U64)
    if len(full):
        key[full] = mix(np.add.reduceat(mix(value ^ _STEP[40]), (np.cumsum(n) - n)[full]) + n[full].astype(U64))
    return [pa.array(key.view(np.int64)), list_array(pa.array(value.view(np.int64)), n)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", num: int = 85, den: int = 100,
                    width: int = 5, coords: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: sets with den * intersection >= num * union are linked,
    and a component is named by its smallest id, which alone is kept."""
    least = least_matches(coords, num / den)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(map_texts(base, "text", "n bigint, node bigint, other bigint, sig array<int>", lambda b, o: _sketch(b, o, width, coords)).drop("text"))
    classes = stored(rows.where("n > 0").groupBy("n", "node", "other").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")))

    tokens = classes.select("node", "n", F.posexplode("sig")).select(
        "node", "n", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("tok"))
    shared = tokens.groupBy("tok").agg(F.count("*").alias("f")).where("f > 1")
    lists = tokens.join(shared, "tok").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("f", "tok"))).alias("toks")).where(F.size("toks") >= least)
    central = F.aggregate("toks", F.lit(0).cast("long"), lambda s, x: s + x["f"])
    posts = stored(lists.select("node", "n", central.alias("c"), F.explode(F.slice("toks", F.lit(1), F.size("toks") - F.lit(least - 1)).getField("tok")).alias("tok")))

    active = posts.select("node").distinct().join(classes, "node").select("node", "rep")
    texts = base.join(active, base["doc_id"].eqNullSafe(active["rep"])).select("node", "text")
    sets = stored(map_texts(texts, "text", "own bigint, hashes array<bigint>", lambda b, o: _sets(b, o, width))
                  .where("own = node").dropDuplicates(["node"]).select("node", "hashes")
                  .join(classes.select("node", "sig"), "node"))

    near = lambda a, b: F.greatest(a, b) * num <= F.least(a, b) * den

    side = lambda c, *more: sets.select(F.col("node").alias(c), *[F.col(m).alias(f"{m}_{c}") for m in more])
    alike = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= least
    shared_size = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("long")
    similar = lambda inter: inter * den >= (F.size("hashes_a") + F.size("hashes_b") - inter) * num

    # a member of a list and its leader: what they share, and whether they are linked
    leaders = posts.groupBy("tok").agg(F.max(F.struct("c", "node")).alias("l")).select("tok", F.col("l.node").alias("b"))
    star = posts.join(leaders, "tok").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    star = star.join(side("a", "sig", "hashes"), "a").join(side("b", "sig", "hashes"), "b")
    star = stored(star.select("a", "b", F.size("hashes_b").alias("nb"), shared_size.alias("inter"), (alike & similar(shared_size)).alias("linked")))
    links = star.where("linked").select("a", "b")
    labels = components(links)

    # lists that still hold several components, and the members and leaders that meet there
    placed = posts.join(labels, "node", "left").select("tok", "node", "n", F.coalesce("label", "node").alias("comp"))
    open_ = placed.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
    extra = stored(placed.join(open_, "tok").join(leaders.withColumnRenamed("b", "lead"), "tok").select("lead", "node", "n", "comp").distinct())
    # the centre of a leader: its set and the shingles that most members add to it
    own = extra.join(side("node", "hashes"), "node").join(side("lead", "hashes"), "lead")
    added = own.select("lead", F.explode(F.array_except("hashes_node", "hashes_lead")).alias("z")).groupBy("lead", "z").agg(F.count("*").alias("f"))
    members = extra.groupBy("lead").agg(F.count("*").alias("m"))
    family = added.join(members, "lead").where(F.col("f") * 2 > F.col("m")).groupBy("lead").agg(F.collect_list("z").alias("zs"))
    centre = members.join(side("lead", "hashes"), "lead").join(family, "lead", "left").select(
        "lead", F.concat("hashes_lead", F.coalesce("zs", F.array().cast("array<bigint>"))).alias("centre"))
    # what a member adds to the centre and lacks of it; far: its distance less its share of what a link allows, times den + num
    differ = extra.join(side("node", "hashes"), "node").join(centre, "lead").select(
        "lead", "node", "n", "comp", F.array_except("hashes_node", "centre").alias("plus"), F.array_except("centre", "hashes_node").alias("minus"))
    differ = stored(differ.withColumns({"a": F.size("plus").cast("long"), "r": F.size("minus").cast("long")}).withColumn(
        "far", (F.col("a") + F.col("r")) * (den + num) - F.col("n") * (den - num)))
    nearest = stored(differ.groupBy("lead").agg(F.min(F.struct("far", "node", "comp")).alias("m")).select("lead", "m.far", "m.node", "m.comp").toDF("lead", "least_far", "to", "to_comp"))
    sure = stored(differ.join(nearest, "lead").where((F.col("far") + F.col("least_far") <= 0) & (F.col("comp") != F.col("to_comp"))).select("node", "to", "comp", "to_comp"))
    links = links.union(sure.select(F.col("node").alias("a"), F.col("to").alias("b")))
    merged = components(sure.select(F.col("comp").alias("a"), F.col("to_comp").alias("b")).distinct()).select(F.col("node").alias("comp"), "label")
    placed = differ.join(merged, "comp", "left").join(nearest.select("lead", "least_far"), "lead").select(
        "lead", "node", "n", F.coalesce("label", "comp").alias("comp"), "plus", "minus", "a", "r", "far", "least_far")
    placed = stored(placed)

    # who is still apart shares a difference: all of them, signed, from rare to common
    signed = lambda c, sign: F.transform(c, lambda z: F.struct(z.alias("z"), F.lit(sign).alias("sign")))
    marks = placed.select("lead", "node", "comp", F.explode(F.concat(signed("plus", True), signed("minus", False))).alias("m")).select("lead", "node", "comp", "m.z", "m.sign")
    freq = marks.groupBy("lead", "z", "sign").agg(F.count("*").alias("f"), (F.min("comp") != F.max("comp")).alias("open"))
    by_node = marks.join(freq, ["lead", "z", "sign"]).groupBy("lead", "node").agg(F.array_sort(F.collect_list(F.struct("f", "z", "sign", "open"))).alias("zs"))
    # linked members share (far + far of the other) / (2 (den + num)) differences or more; from rare to common, the first that they share has as many behind it in both
    size = F.col("a") + F.col("r")
    overlap = F.greatest(F.lit(1), F.ceil((F.col("far") + F.col("least_far")) / F.lit(2 * (den + num))))
    prefix = F.least(size - overlap, F.floor(F.col("n") * (den - num) / num)) + 1
    over = placed.drop("plus", "minus").join(by_node, ["lead", "node"]).where(prefix > 0)
    over = over.select("lead", "node", "n", "comp", "a", "r", "far", size.alias("d"), F.posexplode(F.slice("zs", F.lit(1), prefix.cast("int"))).alias("i", "m")).where("m.open")
    over = over.select("lead", "node", "n", "comp", "a", "r", "far", (F.col("d") - F.col("i")).alias("behind"), "m.z", "m.sign")
    slack = (F.col("x.n") + F.col("y.n")) * (den - num)
    apart = (F.col("x.comp") != F.col("y.comp")) & (F.col("x.node") < F.col("y.node")) & near(F.col("x.n"), F.col("y.n"))
    uneven = F.abs(F.col("x.a") - F.col("y.a")) + F.abs(F.col("x.r") - F.col("y.r"))
    enough = F.col("x.far") + F.col("y.far") <= 2 * (den + num) * F.least("x.behind", "y.behind")
    same = (F.col("x.lead") == F.col("y.lead")) & (F.col("x.z") == F.col("y.z")) & (F.col("x.sign") == F.col("y.sign"))
    met = over.alias("x").join(over.alias("y"), same & apart & enough & (uneven * (den + num) <= slack))
    rest = stored(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    few = rest.join(side("a", "sig"), "a").join(side("b", "sig"), "b").where(alike).select("a", "b")
    full = few.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b").where(similar(shared_size)).select("a", "b")
    links = links.union(stored(full))
    labels = components(links)

    named = classes.join(labels, "node", "left").select("n", "node", "other", "rep", F.coalesce("label", "node").alias("comp"))
    names = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = stored(named.join(names, "comp").select("n", "node", "other", "component_id"))
    out = rows.drop("sig").join(named, ["n", "node", "other"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      ((F.col("n") == 0) | component.eqNullSafe(F.col("doc_id"))).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id names their component. Rows of equal id and text stay or go together."""
    kept = near_duplicates(docs, id_col, text, **options).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]), "left_semi")
