"""Operators without plain SQL against direct computation, with hot keys."""

import math
import random
import re
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdpanel.functions.stats import student_quantile
from crowdpanel.operators import disagg, graph, places
from crowdpanel.operators.aggregates import exact_quantiles
from crowdpanel.operators.joins import asof_join
from crowdpanel.operators.uplift import calibrate_velocity


def _quarters(n=(90, 91, 92)):
    quarter = np.repeat(np.arange(len(n)), n)
    p = 1000 + 200 * np.random.default_rng(3).random(sum(n))
    return p, quarter, np.array([1_072_906_635.0, 1_194_561_464.0, 1_180_687_372.0])


def test_denton_equals_the_full_system():
    p, q, y = _quarters()
    n, c = len(p), np.eye(3)[q].T
    d = np.diff(np.diag(p.mean() / p), axis=0)  # scaling leaves the minimiser and helps the solver
    kkt = np.block([[2 * d.T @ d, c.T], [c, np.zeros((3, 3))]])
    want = np.linalg.lstsq(kkt, np.append(np.zeros(n), y), rcond=None)[0][:n]
    got = disagg.denton_series(p, q, y)
    assert np.allclose(got, want, rtol=1e-6) and np.allclose(c @ got, y, rtol=1e-12) and (got > 0).all()


def test_chowlin_equals_the_dense_form():
    p, q, y = _quarters()
    x, se, rho = disagg.chowlin_series(p, q, y)
    c = np.eye(3)[q].T
    assert np.allclose(c @ x, y, rtol=1e-12) and 0 <= rho <= 0.98 and (se >= 0).all()
    lag = np.abs(np.subtract.outer(np.arange(len(p)), np.arange(len(p))))
    v = rho**lag if rho > 0 else np.eye(len(p))
    design = np.column_stack([np.ones(len(p)), p])
    inv = np.linalg.inv(c @ v @ c.T)
    beta = np.linalg.solve((c @ design).T @ inv @ (c @ design), (c @ design).T @ inv @ y)
    want = design @ beta + v @ c.T @ inv @ (y - c @ design @ beta)
    assert np.allclose(x, want, rtol=1e-8)


def test_spreads_run_per_series(spark):
    days = [(s, date(2024, 1, 1) + timedelta(i), 1000.0 + (i * 37 % 200)) for s in ("a", "b") for i in range(366)]
    ind = spark.createDataFrame(days, "series string, date date, ind double")
    totals = spark.createDataFrame([(s, f"2024Q{k}", 1e6 * k) for s in ("a", "b") for k in (1, 2, 3, 4)], "series string, period string, total double")
    for method in ("prorata", "denton", "chowlin"):
        back = disagg.sum_back(disagg.disaggregate(totals, ind, method), totals).collect()
        assert len(back) == 2 and all(r.n_quarters == 4 and r.max_rel_error < 1e-9 for r in back)


def _haversine(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - lp) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("spread", [0.01, 5.0])
def test_knn_with_a_crowded_place(spark, spread):
    rnd = random.Random(5)
    pts = [(i, 37.7786, -122.3893) for i in range(70)]  # a third of all nodes in one place
    pts += [(i, 37.7786 + rnd.gauss(0, 1e-4), -122.3893 + rnd.gauss(0, 1e-4)) for i in range(70, 140)]
    pts += [(i, 37.7 + rnd.random() * spread, -122.5 + rnd.random() * spread) for i in range(140, 210)]
    got = {}
    for r in graph.knn_lists(spark.createDataFrame(pts, "node_id long, lat double, lon double"), 8).collect():
        got.setdefault(r.node_id, {})[r["rank"]] = r.peer_id
    for i, la, lo in pts:
        want = sorted((round(_haversine((la, lo), (b, c)), 6), j) for j, b, c in pts if j != i)[:8]
        assert [got[i][k + 1] for k in range(8)] == [j for _, j in want]


@pytest.mark.parametrize("shape", ["outlier", "nested", "line", "even"])
def test_knn_pairs_stay_linear(spark, shape):
    """A far outlier and a tight cluster, clusters inside clusters on twelve scales, a line, an even spread: exact, and few pairs for each wanted neighbour."""
    rnd = random.Random(6)
    n, k = 600, 4
    at = {"outlier": lambda i: (20.0, 20.0) if i == 0 else (1 + rnd.random() * 1e-7, 1 + rnd.random() * 1e-7),
          "nested": lambda i: (1 + rnd.random() * 10.0 ** -(i % 12), 1 + rnd.random() * 10.0 ** -(i % 12)),
          "line": lambda i: (2.0, i * 1e-4), "even": lambda i: (rnd.random(), rnd.random())}[shape]
    pts = [(i, *at(i)) for i in range(n)] + [(n, None, 1.0)]
    df = spark.createDataFrame(pts, "node_id long, lat double, lon double")
    assert graph.knn_pairs(df.filter("lat is not null"), k).count() <= (100 if shape == "nested" else 60) * k * n
    got = {}
    for r in graph.knn_lists(df, k).collect():
        got.setdefault(r.node_id, []).append((r["rank"], r.dist_m))
    la, lo = (np.radians([p[c] for p in pts[:-1]]) for c in (1, 2))
    for i in range(n):
        a = np.sin((la - la[i]) / 2) ** 2 + np.cos(la) * np.cos(la[i]) * np.sin((lo - lo[i]) / 2) ** 2
        want = np.sort(np.delete(2 * 6_371_008.8 * np.arcsin(np.sqrt(a)), i))[:k]
        assert [d for _, d in sorted(got[i])] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-7)
    assert n not in got


def test_knn_checks_its_extent(spark):
    with pytest.raises(ValueError, match="extent"):
        graph.knn_lists(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 40.0)], "node_id long, lat double, lon double"))
    assert graph.knn_lists(spark.createDataFrame([], "node_id long, lat double, lon double")).collect() == []


def test_knn_of_fewer_nodes_than_k(spark):
    pts = [(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 10.0, 0.0)]
    edges = graph.knn_edges(spark.createDataFrame(pts, "node_id long, lat double, lon double"), 8).collect()
    assert {(r.a, r.b) for r in edges} == {(1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize("mode", ["mutual", "directed"])
def test_cosine_with_a_hot_key(spark, mode):
    rnd = random.Random(11)
    vec = {i: {k: float(rnd.randint(1, 9)) for k in rnd.sample(range(40), 4)} for i in range(60)}
    for i in range(0, 60, 2):
        vec[i][99] = float(rnd.randint(1, 30))
    rows = [(i, k, w) for i, m in vec.items() for k, w in m.items()]
    length = {i: math.sqrt(sum(w * w for w in m.values())) for i, m in vec.items()}
    cos = {(a, b): round(sum(vec[a][k] * vec[b].get(k, 0.0) for k in vec[a]) / length[a] / length[b], 9) for a in vec for b in vec if a != b}
    cos = {p: c for p, c in cos.items() if c >= 0.1}
    if mode == "directed":
        want = {(a, b) for a in vec for c, b in sorted((-c, b) for (x, b), c in cos.items() if x == a)[:3]}
    else:
        once = {(a, b): c for (a, b), c in cos.items() if a < b}
        want = {(a, b) for a in vec for c, b in sorted((-c, b) for (x, b), c in once.items() if x == a)[:3]}
        want |= {(a, b) for b in vec for c, a in sorted((-c, a) for (a, x), c in once.items() if x == b)[:3]}
    df = spark.createDataFrame(rows, "node_id long, key long, w double")
    for rows in (1000, 8, 3):  # no key, some keys, most keys split
        got = {(r.src, r.dst) for r in graph.cosine_edges(df, k=3, mode=mode, block_rows=rows).collect()}
        assert got == want, rows


@pytest.mark.parametrize("mode", ["mutual", "directed"])
def test_cosine_of_text_ids_and_signed_weights(spark, mode):
    rnd = random.Random(12)
    vec = {f"n{i}": {k: rnd.choice([-1, 1]) * float(rnd.randint(1, 9)) for k in rnd.sample(range(30), 4)} | {99: float(rnd.randint(5, 9))} for i in range(60)}
    length = {i: math.sqrt(sum(w * w for w in m.values())) for i, m in vec.items()}
    cos = {(a, b): round(sum(vec[a][k] * vec[b].get(k, 0.0) for k in vec[a]) / length[a] / length[b], 9) for a in vec for b in vec if a != b}
    cos = {p: c for p, c in cos.items() if c >= 0.1}
    if mode == "mutual":
        cos = {(a, b): c for (a, b), c in cos.items() if a < b}
    want = {(a, b) for a in vec for c, b in sorted((-c, b) for (x, b), c in cos.items() if x == a)[:3]}
    if mode == "mutual":
        want |= {(a, b) for b in vec for c, a in sorted((-c, a) for (a, x), c in cos.items() if x == b)[:3]}
    rows = [(i, k, w) for i, m in vec.items() for k, w in m.items()]
    df = spark.createDataFrame(rows, "node_id string, key long, w double")
    for rows in (1000, 20, 3):  # no key, some keys, most keys split
        got = {(r.src, r.dst) for r in graph.cosine_edges(df, k=3, mode=mode, block_rows=rows).collect()}
        assert got == want, rows


@pytest.mark.parametrize("floor", [0.3, 0.7, 0.95])
def test_cosine_where_common_keys_are_not_offered(spark, floor):
    """Weights fall towards the common keys, so that high floors leave most of them unoffered; exact cosines all the same."""
    rnd = random.Random(int(floor * 100))
    vec = {i: {rnd.randrange(25): rnd.choice([-9.0, 9.0]), 100 + i % 3: rnd.uniform(-4, 4), 200: rnd.uniform(-3, 3), 201: 1.0} for i in range(90)}
    length = {i: math.sqrt(sum(w * w for w in m.values())) for i, m in vec.items()}
    cos = {(a, b): sum(vec[a][k] * vec[b].get(k, 0.0) for k in vec[a]) / length[a] / length[b] for a in vec for b in vec if a < b}
    df = spark.createDataFrame([(i, k, w) for i, m in vec.items() for k, w in m.items()], "node_id long, key long, w double")
    got = {(r.src, r.dst): r.cos for r in graph.cosine_edges(df, floor, k=1000, block_rows=20).collect()}
    want = {p: c for p, c in cos.items() if round(c, 9) >= floor}
    assert got.keys() == want.keys() and all(abs(got[p] - c) < 1e-9 for p, c in want.items())


@pytest.mark.parametrize("mode", ["mutual", "directed"])
def test_dense_cosine_equals_plain(spark, mode, monkeypatch):
    """Nearly all pairs share keys, a third of the nodes are copies (ties go to the smaller id), some weights are negative; blocks and strips are many."""
    rnd = random.Random(13)
    vec = {i: {f"k{k}": float(rnd.choice([-1, 1, 2, 3])) for k in rnd.sample(range(12), 6)} for i in range(40)}
    vec |= {100 + i: dict(vec[i]) for i in range(20)}
    length = {i: math.sqrt(sum(w * w for w in m.values())) for i, m in vec.items()}
    cos = {(a, b): round(sum(vec[a][k] * vec[b].get(k, 0.0) for k in vec[a]) / length[a] / length[b], 9) for a in vec for b in vec if a != b}
    cos = {p: c for p, c in cos.items() if c >= 0.1 and (mode == "directed" or p[0] < p[1])}
    want = {(a, b) for a in vec for c, b in sorted((-c, b) for (x, b), c in cos.items() if x == a)[:3]}
    if mode == "mutual":
        want |= {(a, b) for b in vec for c, a in sorted((-c, a) for (a, x), c in cos.items() if x == b)[:3]}
    df = spark.createDataFrame([(i, k, w) for i, m in vec.items() for k, w in m.items()] + [(999, "k1", 0.0)], "node_id long, key string, w double")
    for size, strip in ((8192, 1024), (7, 1024), (25, 4)):
        monkeypatch.setattr(graph, "STRIP", strip)
        got = {(r.src, r.dst): round(r.cos, 9) for r in graph.dense_cosine_edges(df, k=3, mode=mode, block_nodes=size).collect()}
        assert got == {p: cos[p] for p in want}, size
    assert graph.dense_cosine_edges(df.limit(0), mode=mode).collect() == []


@pytest.fixture
def many_ranges(spark):
    """Many shuffle partitions that stay apart, as on large tables."""
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield 23
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("spread", [3000, 40])
def test_asof_with_a_hot_key(spark, strict, spread, many_ranges):
    rnd = random.Random(2)
    t0 = pd.Timestamp("2024-01-01")
    key = lambda: "hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 5)}"
    left = pd.DataFrame({"id": range(400), "key": [key() for _ in range(400)], "ts": [t0 + pd.Timedelta(minutes=30 * rnd.randint(0, spread)) for _ in range(400)]})
    right = pd.DataFrame({"key": [key() for _ in range(200)], "ts": [t0 + pd.Timedelta(minutes=30 * rnd.randint(0, spread)) for _ in range(200)]}).drop_duplicates()
    right["v"] = range(len(right))
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="key", allow_exact_matches=not strict).set_index("id").v
    ntz = lambda pdf, cols: spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*cols)
    got = asof_join(ntz(left, ["id", "key", "ts"]), ntz(right, ["key", "ts", "v"]), ["key"], "ts", ["v"], strict).toPandas().set_index("id").v
    pd.testing.assert_series_equal(got.sort_index().astype(float), want.sort_index().astype(float), check_names=False)


@pytest.mark.parametrize("strict", [True, False])
def test_asof_where_one_key_holds_most_rows_of_one_hour(spark, strict, many_ranges):
    from crowdpanel.operators import ranges
    rnd = random.Random(3)
    t0 = datetime(2024, 1, 1, 10)
    left = [(i, "hot", t0 + timedelta(seconds=rnd.randint(0, 3599))) for i in range(3000)] + [(3000 + i, f"k{i % 7}", t0) for i in range(70)] + [(9000, None, t0), (9001, "hot", None)]
    right = sorted({("hot", t0 + timedelta(seconds=rnd.randint(-9, 1200))) for _ in range(40)} | {("k1", t0), ("k2", t0 - timedelta(days=400))}) + [(None, t0)]
    ldf = spark.createDataFrame(left, "id long, key string, ts timestamp_ntz")
    rdf = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(right)], "key string, ts timestamp_ntz, v long")
    sizes = ranges.in_ranges(ldf, ["key", "ts"]).groupBy(ranges.RANGE).count().collect()
    assert max(r["count"] for r in sizes) < 3 * len(left) / many_ranges
    got = {r.id: (r.asof_ts, r.v) for r in asof_join(ldf, rdf, ["key"], "ts", ["v"], strict).collect()}
    for i, key, ts in left:
        before = [(t, n) for n, (k, t) in enumerate(right) if k == key and key is not None and ts is not None and (t < ts or (t == ts and not strict))]
        assert got[i] == (max(before) if before else (None, None)), (i, key, ts)


def test_ranks_over_ranges(spark, many_ranges):
    from crowdpanel.operators import ranges, windows
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, rnd.randint(0, 500)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {r[2]: n + 1 for k in ("a", "b", None) for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=order))}
    assert {r.i: r.n for r in ranges.ranked(df, ["k"], ["v", "i"], "n").collect()} == want
    codes = {r.i: r.c for r in windows.category_codes(df, "i", "c").collect()}
    assert codes == {i: i + 1 for i in range(900)}
    plan = windows.category_codes(df, "i", "c")._jdf.queryExecution().optimizedPlan().toString()
    assert all(re.search(r"\[_range#\d+", line) for line in plan.splitlines() if "Window [" in line)


def test_sample_is_the_smallest_hashes(spark):
    import hashlib
    from crowdpanel.operators.reshape import sample_rows
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    order = sorted(range(5000), key=lambda i: hashlib.md5(f"4|{i}".encode()).hexdigest())
    for n in (0, 1, 57, 4999, 5000, 6000):
        got = sample_rows(df, n, ["id"], 4)
        assert {r.id for r in got.collect()} == set(order[:n]) and got.columns == ["id", "g"]
        assert "Sort" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sample_rows(df, 1700, ["g"], 4).count() == 1700  # keys that do not tell rows apart


@pytest.mark.parametrize("shape", ["small", "far", "equal", "keys"])
def test_quantiles_rank_a_share_of_the_values_in_a_task(spark, shape, many_ranges):
    """However values are spread, a range of them holds at most three times its even share."""
    from crowdpanel.operators import ranges
    rng = np.random.default_rng(5)
    x = {"small": rng.random(6000) * 1e-3, "far": np.concatenate([rng.random(5999) * 1e-9, [1e12]]), "equal": np.concatenate([np.ones(5000), rng.random(1000)]), "keys": rng.normal(0, 1, 6000)}[shape]
    key = ["big" if shape != "keys" or i % 3 else None if i % 2 else "b" for i in range(len(x))]
    df = spark.createDataFrame([(k, float(v)) for k, v in zip(key, x)] + [("nan", float("nan")), ("big", None)], "k string, v double")
    sizes = [r["count"] for r in ranges.in_ranges(df.groupBy("k", "v").count().drop("count"), ["k", "v"]).groupBy(ranges.RANGE).count().collect()]
    assert max(sizes) <= 3 * sum(sizes) / many_ranges
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.777, "e": 1.0}
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"]).collect()}
    for k in set(key):
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(x[[y == k for y in key]], p), rel=1e-12, abs=1e-15)
    assert set(got) == set(key)


def test_quantiles_of_mixed_signs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 100, 500), np.zeros(300), rng.exponential(1e6, 200), [-0.5, -0.25, 1e-9]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.777, "e": 0.999, "f": 1.0}
    got = exact_quantiles(df, "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)


def test_place_search_ranks(spark):
    index = spark.createDataFrame([("King Cafe", "128 King St"), ("The King", "1 Main Street"), ("Bar", "128 King Street"), ("Pub", "1280 King St"),
                                   ("O'Neil Pub", "9 Oak Ave"), ("San Francisco Museum", "3 Rose Pl")], "name string, address string")
    ask = spark.createDataFrame([("King",), ("128 king st, San Francisco, CA 94107",), ("oneil oak",), ("san francisco",), ("x",), ("zzz",)], "query string")
    got = {}
    for r in places.search_places(ask, index).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.score, r["name"]))
    assert sorted(got["king"])[:3] == [(1, 0, "King Cafe"), (2, 1, "The King"), (3, 2, "Bar")]
    assert [x[2] for x in sorted(got["128 king st, san francisco, ca 94107"])] == ["Bar", "King Cafe", "Pub"]
    assert sorted(got["oneil oak"]) == [(1, 4, "O'Neil Pub")] and sorted(got["san francisco"])[0][2] == "San Francisco Museum"
    assert "x" not in got and "zzz" not in got


def test_place_search_reads_a_few_postings_of_common_tokens(spark, monkeypatch):
    """Queries of every kind over places that share their tokens, with short reads: equal to scoring every place."""
    monkeypatch.setattr(places, "FIRST_READ", 4)
    monkeypatch.setattr(places, "STEP", 2)
    rnd = random.Random(8)
    vocabulary = ["star", "stone", "bar", "barn", "king", "oak", "5"]
    rows = {(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 3))).title(), f"{rnd.randint(1, 30)} {rnd.choice(vocabulary)} Street") for _ in range(400)}
    asks = ["s", "st", "sta", "bar", "oak king", "king 5", "5 st", "bar oak st", "barn stone star", "stree", "1", "zz st"]
    index = spark.createDataFrame(sorted(rows), "name string, address string")
    got = {}
    for r in places.search_places(spark.createDataFrame([(q,) for q in asks], "query string"), index).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.score, r["name"], r.address))
    table = {"street": "st"}
    for q in asks:
        toks = [table.get(w, w) for w in q.split()]
        want = []
        for name, address in rows:
            nw, aw = name.lower().split(), [table.get(w, w) for w in address.lower().split()]
            has = lambda ws: all(any(w.startswith(t) for w in ws) for t in toks)
            score = (0 if nw[0].startswith(toks[0]) else 1) if has(nw) else (2 if toks[0] in aw else 3) if has(aw) else 4 if has(nw + aw) else None
            if score is not None and len(q) >= 2:
                want.append((score, name.lower(), name, address))
        assert sorted(got.get(q, [])) == [(i + 1, s, name, a) for i, (s, _, name, a) in enumerate(sorted(want)[:8])], q


def test_one_token_that_matches_every_place_reads_its_first_postings(spark):
    index = spark.range(3000).selectExpr("concat('Star ', id) name", "concat(id, ' Stone Street') address")
    reads = []
    join = places.top_k
    places.top_k, old = lambda df, keys, *a: (reads.append(df.count()) if "score" in keys else None) or join(df, keys, *a), places.top_k
    try:
        got = places.search_places(spark.createDataFrame([("st",)], "query string"), index).collect()
    finally:
        places.top_k = old
    assert [r["name"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(f"Star {i}" for i in range(3000))[:8]
    assert sum(reads) <= 5 * places.FIRST_READ  # of 3000 places


def test_velocity_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    d = [date(2023, 1, 1) + timedelta(i) for i in range(500)]
    att = np.where(rng.random(500) < 0.2, rng.integers(10000, 40000, 500), 0)
    y = 0.01 * att / 10000 + 0.02 * np.array([x.weekday() for x in d]) + rng.normal(0, 0.01, 500)
    spend = spark.createDataFrame([(a, float(b)) for a, b in zip(d, y)], "date date, spend_idx double")
    games = spark.createDataFrame([(a, int(b)) for a, b in zip(d, att) if b], "date date, attendance long")
    got = calibrate_velocity(spend, games).first()
    pdf = pd.DataFrame({"c": 1.0, "a": att / 10000, "dow": [x.weekday() for x in d], "m": [x.month for x in d], "y": [x.year for x in d]})
    x = pd.get_dummies(pdf, columns=["dow", "m", "y"], drop_first=True).to_numpy(float)
    beta, rss, *_ = np.linalg.lstsq(x, 100 * y, rcond=None)
    se = math.sqrt(rss[0] / (500 - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert got.pp_per_10k == pytest.approx(beta[1], rel=1e-6) and got.se == pytest.approx(se, rel=1e-6) and got.lo < beta[1] < got.hi


def test_student_quantile():
    assert student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert student_quantile(0.975, 480) == pytest.approx(1.964918, abs=1e-5)


def test_knn_edges_are_spread_before_they_are_gathered(spark, monkeypatch):
    """No task holds the edges of a whole input file, whose size says little about them."""
    monkeypatch.setattr(graph, "TASK_NODES", 50)
    monkeypatch.setattr(graph, "TASK_PLACES", 50)
    pts = spark.range(400).selectExpr("id AS node_id", "37.7 + id * 7919 % 1400 / 10000D AS lat", "-122.5 + id * 104729 % 1700 / 10000D AS lon")
    edges = graph.knn_edges(pts, 3)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"partial_min\(dist_m#\d+\)\][^\n]*\n[^\n]*Exchange hashpartitioning\(a#\d+L, b#\d+L, 8\), REPARTITION_BY_NUM", plan)
    assert re.search(r"hashpartitioning\(level#\d+, ai#\d+L, aj#\d+L, 8\), REPARTITION_BY_NUM", plan)
    assert edges.count() == edges.select("a", "b").distinct().count() >= 600
