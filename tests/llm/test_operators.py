"""Each operator on small tables against a plain version, and on nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import io
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crowdpanel.llm import common, decontam, line_dedup, mil, minhash, pieces, queries, rules, secrets, suffix_dedup, toxicity, warc
from crowdpanel.llm.suffix_sort import suffix_array

SF = "/root/testdata/sf0.001"
ODD = [(None, "Alone and without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "Ärger über Öl " * 300), (6, "a b c d e f g h i j k l m n " * 50),
       (7, "a b c d e f g h i j k l m n " * 50), (8, "x\ny\n\nx")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, copies, a repeated row, and columns named like results."""
    rows = [(i, t, None, "s", 0.5, 1, [1], True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, n_words long, spans array<int>, kept boolean")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_suffix_array_equals_sorting():
    draw = random.Random(3)
    for _ in range(400):
        x = [draw.randrange(draw.choice([1, 2, 4, 9])) for _ in range(draw.randrange(60))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_line_dedup_equals_plain(spark, docs):
    want = brute.lines(sorted(pairs(docs)))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_same"], r["n_near"]) for r in queries.op1_line_dedup(spark, SF).collect()}
    assert got == want and sum(w[3] for w in want.values()) > 0


def test_line_dedup_keeps_the_earliest_of_near_lines(spark):
    base = "a b c d e f g h i"
    rows = [(1, base), (2, base.replace("e", "z")), (3, base + " j"), (4, base.replace("c ", "")), (5, "a b c d q r s t u"), (6, "a b"), (7, "a c")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [base, "", "", "", "a b c d q r s t u", "a b", "a c"]


def test_pieces_take_the_best_segmentation():
    model = pieces.Pieces(["<unk>", "a", "b", "ab", "ba", "aba", "▁a"], [0, -3, -3, -4, -3.5, -9, -2], {}, 0, set())

    def best(word):
        options = {p: s for p, s in zip(model.text[1:], [-3, -3, -4, -3.5, -9, -2])}
        done = {0: 0.0}
        for j in range(1, len(word) + 1):
            done[j] = max([done[i] + options[word[i:j]] for i in range(j) if word[i:j] in options] + [done[j - 1] + model.penalty])
        return done[len(word)]

    score = dict(enumerate([model.penalty, -3, -3, -4, -3.5, -9, -2]))
    draw = random.Random(1)
    for _ in range(300):
        word = "".join(draw.choice("▁abc") for _ in range(draw.randrange(9)))
        assert sum(score[i] for i in model.viterbi(word)) == pytest.approx(best(word))


def test_cut_words_keep_the_best_segmentation():
    model = pieces.loaded(pieces.MODEL)
    draw = random.Random(2)
    for _ in range(200):
        text = "".join(draw.choice("ab.,\n\té漢e'!s ") for _ in range(draw.randrange(1, 90)))
        assert model.encode(text) == list(model.viterbi((pieces.MARK + text).replace(" ", pieces.MARK)))
        assert model.decode(model.encode(text)) == text
    assert model.decode([]) == model.decode([None]) == ""


def test_solved_words_survive_a_full_table(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_WORDS", 3)
    asked = []
    solved = pieces._Solved(lambda w: asked.append(w) or w.encode())
    assert [solved[w] for w in "abcdaab"] == [w.encode() for w in "abcdaab"]
    assert asked == list("abcd") and len(solved) <= 3 and len(solved.old) <= 3


def test_pieces_round_trip(spark, odd):
    got = queries.op2_sentencepiece(spark, SF).collect()
    assert len(got) == 200 and all(r["round_trip"] for r in got)
    back = pieces.decode(pieces.encode(odd)).collect()
    assert [r["decoded"] for r in back] == [t or "" for _, t in ODD]
    model = pieces.loaded(pieces.MODEL)
    for text in (" ", "▁", " ▁ a", "\x00\n", "日本 😀", "a  b"):
        assert model.decode(model.encode(text)) == text


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name, label, mod, held, least", [("op3_quality_mil", "quality", 3, 1, 0.95), ("op6_toxicity", "toxic", 4, 2, 0.75)])
def test_classifiers_on_rows_held_out(spark, name, label, mod, held, least):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).toPandas().set_index("doc_id")
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % mod == held for i in got.index]
    assert got["score"].between(0, 1).all() and len(got) == 1000
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")[label]
    both = got.join(labels, how="inner")
    both = both[both["held_out"]]
    assert auc(both["score"].to_numpy(), both[label].to_numpy()) > least


def test_attention_learns_bags():
    draw = np.random.default_rng(0)
    x, rows = draw.standard_normal((12, 6)), np.array([0, 3, 4, 9, 12])
    y = np.array([0.0, 1.0, 1.0, 0.0])
    net = mil.fit(x.astype(np.float32), rows, y.astype(np.float32), epochs=400, decay=0)
    assert ((net.score(x.astype(np.float32), rows)[0] > 0.5) == (y == 1)).all()


def test_toxicity_restores_disguised_words(spark):
    docs = spark.createDataFrame([(k, "you are a stupid clown and a moron indeed") for k in range(30)] + [(99, None), (100, "")], "doc_id long, text string")
    counts = np.zeros(28**3)
    for code, n in toxicity.trigram_counts(docs).collect():
        counts[code] = n
    decoder = toxicity.Decoder(counts)
    for shown in ("stup1d", "$tupid", "st*pid", "s.t.u.p.i.d", "s t u p i d", "stuuuupid", "STUP1D"):
        assert decoder.restore(shown) == "stupid"


@pytest.fixture(scope="module")
def decoder(spark):
    docs = spark.createDataFrame([(k, "you are a stupid idiot full of hate and an ass man") for k in range(30)], "doc_id long, text string")
    counts = np.zeros(28**3)
    for code, n in toxicity.trigram_counts(docs).collect():
        counts[code] = n
    return toxicity.Decoder(counts)


def slots(decoder, *texts):
    """The slots of each text when all share one slice."""
    row, slot = toxicity.word_slots(decoder, *common.text_bytes(pa.array(texts)))
    return [set(slot[row == k].tolist()) for k in range(len(texts))]


def test_toxicity_decodes_every_disguised_token(decoder):
    want = {"idiot": ("idio7", "idi07", "1d107", "1d107!", '"idi07,"'), "hate": ("hat3", "h473"), "ass": ("a$$", "a55."), "stupid": ("$tup1d!", "stuuupid")}
    for word, shown in want.items():
        for text in shown:
            assert slots(decoder, word)[0] <= slots(decoder, f"you {text} man")[0], text


def test_toxicity_finds_spaced_words(decoder):
    shown = ("you are a s t u p i d man", "s t u p i d a man", "s  t  u  p  i  d", "s\tt\tu\tp\ti\td", "s\nt\nu\np\ni\nd", "s. t. u. p. i. d", "s t u p i d\ni d i o t", "s t u p i d  i d i o t")
    for text in shown:
        assert slots(decoder, "stupid")[0] <= slots(decoder, text)[0], text
    assert all(slots(decoder, "idiot")[0] <= slots(decoder, text)[0] for text in shown[-2:])


def test_toxicity_rows_do_not_see_their_neighbours(decoder):
    """Spaced words and repeated letters at the ends of rows, in one slice and each in its own."""
    rows = ["s t u p i d", "you", "x s t u p i d", "a man", "s t u p i d", "i d i o t", "ss", "ss man", "", "7 i d i o t"]
    assert slots(decoder, *rows) == [slots(decoder, r)[0] for r in rows]
    assert all(slots(decoder, "stupid")[0] <= slots(decoder, *rows)[k] for k in (0, 2, 4))
    starts = toxicity.suspects(*common.text_bytes(pa.array(["zoo", "oh"])))[0]
    assert len(starts) == 0


def test_toxicity_scores_disguised_words_alike(spark, decoder):
    weight = np.zeros(toxicity.SLOTS)
    weight[list(slots(decoder, "idiot")[0])] = 3
    rows = [(1, "you idiot"), (2, "you idi07"), (3, "you 1d107"), (4, "you man"), (5, "you man, well.")]
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), toxicity.Scorer(decoder, weight, -1.0)).orderBy("doc_id").collect()
    assert [r["score"] > 0.5 for r in got] == [True, True, True, False, False] and [r["n_restored"] for r in got] == [0, 1, 1, 0, 0]


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}\r\nX: y", ("payload %d " % (i % 3)) * 200) for i in range(40)] + [(50, None, None), (51, "u", ""), (None, "u", "payload 0 " * 200), (60, "u", "ä" * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    place = warc.new_folder(spark)
    got = warc.resolved(warc.read_archives(warc.write_archives(pages, place, train_bytes=20_000), place)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, _, html in rows:
        body = (html or "").encode()
        r = by[None if i is None else str(i)]
        assert (r["payload_bytes"], r["full_digest"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest(), hashlib.sha1(body).hexdigest())
    assert {r["page_id"] for r in got if r["record_type"] == "response"} == {"37", "38", "39", "50", "51", "60"}
    assert by["0"]["refers_to"] == "39" and by[None]["refers_to"] == "39"
    assert warc.read_archives(warc.write_archives(pages.limit(0), place + "-none"), place).count() == 0


def test_archives_carry_their_dictionary():
    body = [warc.record_bytes(i, "u", "d", "response", None, b"some html text %d" % i * 30) for i in range(20)]
    words = warc.train(body, 4096)
    import struct

    import zstandard
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress(body[3])
    raw = struct.pack("<II", warc.MAGIC, len(words)) + words + struct.pack("<III", warc.SIZE_MAGIC, 4, len(frame)) + frame
    assert list(warc.read_archive(io.BytesIO(raw))) == [body[3]]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-5])))


def test_secret_findings_are_whole(spark):
    text = 'see token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and mail someone.92@mail6.example.com now'
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "nothing here")], "doc_id long, text string")
    found = secrets.findings(docs, secrets.letter_costs(docs), secrets.common_words(docs))
    rows = found.collect()
    assert sorted((r["doc_id"], r["candidate"]) for r in rows) == [(1, "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda")] * 2 + [(1, "someone.92@mail6.example.com")] * 2
    assert all(text.encode()[r["start"]:r["end"]].decode() == r["candidate"] for r in rows)
    got = secrets.judged(found, found.withColumn("label", secrets.weak_label()).where("label is not null"))
    assert {r["candidate"]: r["is_secret"] for r in got.collect()} == {"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda": True, "someone.92@mail6.example.com": False}
    assert secrets.judged(found.limit(0), found.withColumn("label", F.lit(1)).limit(0)).count() == 0


def test_short_and_letter_only_secrets_are_candidates(spark):
    texts = ["password = hunter2x9Q", "pwd: swordfish and more", "x passwd=letmein", "abcd1234", "ab12", "qwertyuiopasdfghjklzxcvb", "monkey: bananas", "the key", "= bananas", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    zero = np.zeros((28, 28)), np.zeros(secrets.SLOTS, bool)
    got = {(r.doc_id, r.candidate) for r in secrets.findings(docs.coalesce(1), *zero).collect()}
    assert got == {(0, "hunter2x9Q"), (1, "swordfish"), (2, "passwd=letmein"), (3, "abcd1234"), (5, "qwertyuiopasdfghjklzxcvb")}
    assert secrets.findings(docs.limit(0), *zero).count() == 0


def test_coverage_of_tokens_matches_a_plain_version():
    words = np.zeros(secrets.SLOTS, bool)
    known = ["key", "house", "use", "stone", "ones", "extraordinary"]
    for w in known:
        raw = np.frombuffer(w.encode(), np.uint8)
        words[int(common.stretch_hash(common.prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0] & np.uint64(secrets.SLOTS - 1))] = True
    cost = np.arange(28 * 28, dtype=float).reshape(28, 28)
    for token in ("Houses1key", "xx", "12345678", "aHouseStonesq9/extraordinaryz", "STONE" * 3000 + "7"):
        low, hit = token.lower(), set()
        for w in known:
            at = low.find(w)
            while at >= 0:
                hit |= set(range(at, at + len(w)))
                at = low.find(w, at + 1)
        n = sum(c.isalpha() for c in low)
        steps = [cost[ord(a) - 96][ord(b) - 96] for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
        got = secrets.features(token, "", "", "", cost, words)
        assert got[5] == (len(hit) / n if n else 0.0) and got[1] == pytest.approx(np.mean(steps) if steps else 0.0)
        assert got[4] == len(set(token)) / len(token)
    assert len(secrets.features("ab7" * 2_000_000, "", "", "", cost, words)) == secrets.PLAIN + 2 * secrets.BESIDE


def test_near_duplicates_equal_plain(spark, docs):
    want = brute.near(pairs(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8_minhash(spark, SF).collect()}
    assert got == want


def test_near_duplicate_families(spark):
    """One text and 150 copies with one to six words changed: no link is lost and none is added."""
    draw = random.Random(5)
    base = ["w%d" % draw.randrange(500) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 151):
        words = list(base)
        for _ in range(1 + k % 6):
            words[draw.randrange(120)] = "v%d" % draw.randrange(40)
        rows.append((k, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


@pytest.mark.parametrize("num", [80, 85])
@pytest.mark.parametrize("kind", ["drop", "add", "both", "core"])
def test_near_duplicate_families_of_uneven_members(spark, kind, num):
    """Members that lack different words of one text, add some, do both, or share an addition of their own; many lie at the border of a link."""
    draw = random.Random(len(kind) + num)
    base = ["w%d" % draw.randrange(900) for _ in range(130)]
    rows = [(1000, " ".join(base))]
    for k in range(140):
        words = list(base)
        for _ in range(k % 9):
            at = draw.randrange(len(words))
            if kind == "drop" or (kind == "both" and draw.random() < 0.5):
                del words[at]
            else:
                words.insert(at, "v%d" % draw.randrange(12 if kind == "core" else 10**6))
        if kind == "core" and k % 3 == 0:
            words[60:60] = ["c1", "c2", "c3", "c4", "c5"]
        rows.append((k, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num=num).collect()}
    assert got == brute.near(rows, num)


def test_pipeline_drops_copies_from_a_similarity_of_80(spark):
    """Pairs of texts of 100 words, the second with one to three words changed far apart: Jaccard 0.90, 0.81 and 0.73."""
    rows = []
    for k in range(1, 4):
        words = ["p%dw%d" % (k, j) for j in range(100)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join("x" if j in (20, 50, 80)[:k] else w for j, w in enumerate(words)))]
    named = brute.near(rows, 80)
    assert [d for d, _ in rows if named[d][1] == d] == [10, 20, 30, 31] and brute.near(rows)[21][1] == 21
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r["doc_id"] for r in got) == [10, 20, 30, 31]


def test_contamination_equals_plain(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "Short Item here"), (901, None), (902, "the"), (903, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(pairs(docs), items)
    for block in (8 << 20, 4000):  # one block and several
        got = decontam.contamination(docs.select("doc_id", "text"), bench, block_bytes=block).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got} == want


def test_repeats_equal_plain(spark, docs):
    rows = pairs(docs)
    want = brute.repeats(rows)
    for chunk in (4096, 2):  # whole anchors and anchors cut into parts
        cut = suffix_dedup.remove_repeats(docs, chunk=chunk)
        got = {r["doc_id"]: r for r in cut.collect()}
        for (i, _), (n, gone, spans, digest) in zip(rows, want):
            r = got[i]
            assert (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) == (n, gone, spans, digest)


def test_odd_rows_have_defined_results(spark, odd):
    n = len(ODD)
    assert [r["n_lines"] for r in line_dedup.dedup_lines(odd).where("doc_id = 1 or doc_id = 2").orderBy("doc_id").collect()] == [0, 1]
    assert line_dedup.dedup_lines(odd).where("doc_id = 8").first()["text"] == "x\ny\n"
    near = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()}
    assert {(1, 0, 1, True), (3, 0, 3, True), (4, 1, 4, True), (6, 14, 6, True), (7, 14, 6, False)} <= near
    assert minhash.keep_first(odd).count() == n - 1 and minhash.keep_first(odd).columns == odd.columns
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    judged = decontam.contamination(odd, bench)
    assert judged.count() == n and judged.where("doc_id = 6").first()["n_hit"] > 0
    assert decontam.clean(odd, bench).columns == odd.columns and decontam.clean(odd, bench).count() == n - 2
    cut = suffix_dedup.remove_repeats(odd)
    assert cut.count() == n and [r["n_bytes"] for r in cut.where("doc_id = 1").collect()] == [0]
    verdict = rules.judged(odd)
    assert verdict.count() == n and verdict.where("doc_id <= 4 and not base_failed").count() == 0
    model = mil.train(odd, spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int"))
    assert mil.scored(odd, model).where("score between 0 and 1").count() == n
    assert mil.train(odd, spark.createDataFrame([], "doc_id long, quality int")) == 0.5
    worded = toxicity.train(odd, spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, toxic int"))
    assert toxicity.scored(odd, worded).where("score between 0 and 1").count() == n


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    frames = [line_dedup.dedup_lines(none), minhash.near_duplicates(none), decontam.contamination(none, bench), suffix_dedup.remove_repeats(none), rules.judged(none),
              pieces.encode(none), mil.scored(none, 0.5)]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert decontam.contamination(odd, bench).where("n_hit > 0").count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_components_of_a_long_path_in_random_order(spark):
    """A path of 2,000 nodes with random 64-bit ids, and one whose ids fall and rise by turns."""
    draw = random.Random(11)
    path = [draw.randrange(-(1 << 63), 1 << 63) for _ in range(2000)]
    turns = [10**6 + x for k in range(150) for x in (k, 299 - k)]
    edges = [*zip(path, path[1:]), *zip(turns[1:], turns)]
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(path, min(path)) | dict.fromkeys(turns, 10**6)


def test_rules_stay_in_the_jvm(spark):
    plan = queries.op5_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_equals_its_stages_done_plainly(spark, docs):
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns
    scores = queries.op3_quality_mil(spark, SF).where("score >= 0.5").select("doc_id")
    assert sorted(pairs(good)) == sorted(pairs(docs.join(scores, "doc_id", "left_semi")))
    lines = {d: w[0] for d, w in brute.lines(sorted(pairs(good))).items()}
    named = brute.near(lines.items(), 80)
    first = {d: t for d, t in lines.items() if named[d][1] == d}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute.contamination(first.items(), items)
    clean = {d: t for d, t in first.items() if not (hits[d][1] > 0 and 20 * hits[d][1] >= hits[d][0])}
    model = pieces.loaded(pieces.MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {d: r["token_ids"] for d, r in got.items()} == {d: model.encode(t) for d, t in clean.items()}
    assert all(r["round_trip"] for r in got.values())
