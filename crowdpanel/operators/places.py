"""Batch place search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_words, words
from ..session import durable_table
from .ranges import ranked
from .windows import top_k

# Results per query and the shortest query.
TOP_N = 8
MIN_QUERY = 2
#: Postings of a list that are read at first; each further read goes STEP times as far.
FIRST_READ, STEP = 64, 16
#: For each score the lists that may drive its search: of the first token alone, and of any token.
DRIVERS = {0: ("first", "name"), 1: (None, "name"), 2: ("whole", "address"), 3: (None, "address"), 4: (None, "any")}


def search_places(queries: DataFrame, index: DataFrame, n: int = TOP_N) -> DataFrame:
    """(query, rank, score, name, address): the n best places of each distinct query.

    Every token must prefix-match a word of the place. Score 0: all in the name and
    its first word starts with the first token; 1: all in the name; 2: all in the
    address, first token whole; 3: all in the address; 4: across both. Ties by
    name, then address.

    Postings are kept by token in use and by where it matches, in the order of results (name, address), numbered
    along that order by ranges so that a common token's list is split over tasks. A score is searched along
    the shortest of the lists that all its places are in. Lists are read piece by piece: as each gives its
    score's results in order, a list is left as soon as n places of its score or better are known, or it ends. So a
    query that matches every place reads a few hundred postings. A query of common tokens that seldom stand together reads its shortest list.
    """
    asked = queries.select(F.lower(F.trim("query")).alias("query")).filter(F.length("query") >= MIN_QUERY).distinct()
    asked = durable_table(asked.withColumn("tokens", query_words(F.col("query"))).filter(F.size("tokens") > 0))
    lists = durable_table(postings(asked.select(F.explode("tokens").alias("token")).distinct(), index))
    lengths = lists.groupBy("token", "field").agg(F.max("pos").alias("length"))

    options = [F.struct(F.lit(score).alias("score"), F.lit(field).alias("field"), token.alias("token"))
               for score, (first, every) in DRIVERS.items() for field, token in ((first, F.get("tokens", F.lit(0))), (every, F.col("t"))) if field]
    choice = asked.withColumn("t", F.explode(F.array_distinct("tokens"))).select("query", F.explode(F.array(*options)).alias("o")).select("query", "o.*").distinct()
    choice = choice.join(lengths, ["token", "field"], "left").withColumn("length", F.coalesce("length", F.lit(0)))
    shortest = choice.groupBy("query", "score").agg(F.min(F.struct("length", "token", "field")).alias("l"))
    active = durable_table(shortest.filter("l.length > 0").select("query", F.col("score").alias("sought"), "l.*").join(asked, "query"))

    found, piece = None, 0
    while True:
        here = lists.filter(F.col("piece") == piece)
        hits = active.join(here, ["token", "field"]).withColumn("score", _score()).filter(F.col("score") == F.col("sought"))
        hits = top_k(hits, ["query", "score"], [F.lower("name"), F.col("name"), F.col("address")], n).select("query", "score", "name", "address")
        found = durable_table(hits if found is None else found.unionByName(hits))
        known = found.groupBy("query", "score").agg(F.count("*").alias("c"))
        better = active.select("query", "sought").join(known, "query").filter("score <= sought").groupBy("query", "sought").agg(F.sum("c").alias("known"))
        left = active.join(better, ["query", "sought"], "left").filter((F.col("length") > FIRST_READ * STEP**piece) & (F.coalesce("known", F.lit(0)) < n)).drop("known")
        active, piece = durable_table(left), piece + 1
        if active.isEmpty():
            break
    best = top_k(found, ["query"], [F.col("score"), F.lower("name"), F.col("name"), F.col("address")], n)
    return best.select("query", "rank", "score", "name", "address")


def postings(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """(token, field, pos, piece, name, address, n, a): the places of each token and kind of match in the order of results.

    Fields: ``first``, the name's first word starts with the token; ``name``, a word of it does; ``whole``, a word of the address is the token;
    ``address``, a word of it starts with it; ``any``, a word of either. ``piece`` is the read that a posting belongs to.
    """
    places = index.select("name", "address").distinct().withColumn("n", words(F.col("name"))).withColumn("a", words(F.col("address")))
    spots = F.concat(F.transform("n", lambda w, i: F.struct(w.alias("word"), F.when(i == 0, "first").otherwise("name").alias("at"))),
                     F.transform("a", lambda w: F.struct(w.alias("word"), F.lit("address").alias("at"))))
    flat = places.select("name", "address", F.explode(F.array_distinct(spots)).alias("s")).select("name", "address", "s.word", "s.at")
    lengths = tokens.agg(F.array_sort(F.collect_set(F.length("token"))).alias("lens"))  # a few small numbers
    vocabulary = flat.select("word").distinct().join(F.broadcast(lengths)).select(
        "word", F.explode(F.filter("lens", lambda i: i <= F.length("word"))).alias("len"))
    prefixes = vocabulary.select("word", F.substring("word", F.lit(1), F.col("len")).alias("token")).join(tokens, "token", "left_semi")
    fields = F.when(F.col("at") == "first", F.array(F.lit("first"), F.lit("name"), F.lit("any"))).when(F.col("at") == "name", F.array(F.lit("name"), F.lit("any"))).when(
        F.col("word") == F.col("token"), F.array(F.lit("whole"), F.lit("address"), F.lit("any"))).otherwise(F.array(F.lit("address"), F.lit("any")))
    rows = flat.join(prefixes, "word").select("token", F.explode(fields).alias("field"), F.lower("name").alias("lname"), "name", "address").distinct()
    placed = ranked(rows, ["token", "field"], ["lname", "name", "address"], "pos").drop("lname")
    bounds = F.array(*[F.lit(FIRST_READ * STEP**i).cast("long") for i in range(14)])
    piece = F.size(F.filter(bounds, lambda b: b < F.col("pos")))
    return placed.withColumn("piece", piece).withColumn("n", words(F.col("name"))).withColumn("a", words(F.col("address")))


def _score():
    def every(*fields: str):
        ws = F.concat(*[F.col(f) for f in fields])
        return F.forall("tokens", lambda t: F.exists(ws, lambda w: w.startswith(t)))

    first = F.get("tokens", F.lit(0))
    starts = F.coalesce(F.get("n", F.lit(0)).startswith(first), F.lit(False))
    return (F.when(every("n"), F.when(starts, 0).otherwise(1))
            .when(every("a"), F.when(F.array_contains("a", first), 2).otherwise(3)).when(every("n", "a"), 4))
