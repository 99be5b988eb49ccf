"""Phrases, prefix tries and page text against plain versions, and on nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdpanel.llm import html_blocks, phrases, pieces, queries, trie

SF = "/root/testdata/sf0.001"


def plain_phrases(rows, least, first=2000):
    """(lang, rank) -> (phrase, a, l, r, n, score) by counting all runs of words."""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    often = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    gone = set()
    for (lang, w), c in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if (inner := (lang, w[i:i + k])) in often and 100 * c >= 80 * often[inner]:
                    gone.add(inner)
    by_lang = defaultdict(list)
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            by_lang[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1): (p.decode(), -a, left, right, n[lang], -s) for lang, rows in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first])}


def as_phrases(df):
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def drawn_texts(seed, n):
    """Texts of few words, so that phrases of all lengths repeat, with every kind of border between them."""
    draw = random.Random(seed)
    words = ["a", "b", "c", "dd", "É", "z\x01z", "Über"]
    for _ in range(n):
        lang = draw.choice(["en", "de", None, "und", ""])
        yield "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! ", " "]) for _ in range(draw.randrange(60))), lang


@pytest.mark.parametrize("least", [2, 5, 30])
def test_phrases_equal_plain(spark, least):
    rows = list(drawn_texts(least, 150)) + [(None, "en"), ("", None), (" \t. ", "de"), ("x y z x y z " * 20000, "long"), ("x y z x y z " * 20000, "long")]
    df = spark.createDataFrame([(t, lang, 1, 2.0) for t, lang in rows], "text string, lang string, rank int, score double").repartition(7)
    assert as_phrases(phrases.collocations(df, least=least)) == plain_phrases(rows, least)


def test_phrases_on_ranges_that_cut_hot_phrases(spark, monkeypatch):
    """One leading pair holds most suffixes; with small shares its sizes come from many tasks."""
    monkeypatch.setattr(phrases, "SHARE", 40)
    draw = random.Random(1)
    rows = [(" ".join(f"hot pair w{draw.randrange(30)} v{draw.randrange(4)}" for _ in range(30)), "en") for _ in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(9)
    assert as_phrases(phrases.collocations(df, least=4)) == plain_phrases(rows, 4)
    assert len(as_phrases(phrases.collocations(df, least=4, first=3))) == 3


def test_phrases_of_slices_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(phrases, "COUNT_BYTES", 50)
    rows = list(drawn_texts(9, 60))
    df = spark.createDataFrame(rows, "text string, lang string")
    assert as_phrases(phrases.collocations(df, least=3)) == plain_phrases(rows, 3)


def test_full_marks_only_let_more_through(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MARK_BITS", 64)
    rows = list(drawn_texts(4, 80))
    assert as_phrases(phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=6)) == plain_phrases(rows, 6)


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([("once only", "en")], "text string, lang string")).collect() == []


def test_scores_of_large_counts_are_exact(spark):
    big = 10**14 + 7
    known = spark.createDataFrame([("en", "x", 3 * big + 1, ["x"]), ("en", "y", 5 * big + 2, ["y"]), ("en", "x y", big, ["x", "y"])], "lang string, phrase string, f bigint, words array<string>")
    row = phrases._scored(known, 30, 80).first()
    assert row.score == 2000000 * big // (8 * big + 3)


def test_equal_partitions_are_all_prefixes_with_their_weights():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 4, (4, 500)).astype(np.int32)
    words[2:, draw.random(500) < 0.3] = -1
    weight = draw.integers(1, 5, 500)
    depth, row, size = phrases.equal_partitions(words, weight, 20, np.zeros(500))
    got = {tuple(words[:d, r]): s for d, r, s in zip(depth.tolist(), row.tolist(), size.tolist())}
    want = Counter()
    for i in range(500):
        for d in range(1, 5):
            if words[d - 1, i] >= 0:
                want[tuple(words[:d, i])] += int(weight[i])
    assert got == {k: s for k, s in want.items() if s >= 20} and len(got) == len(depth)


def plain_nodes(rows, block=20, kinds=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % kinds
        base = c - (abs(c) % block) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + x[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, x in whole.items():
        ends[tuple(x)].append(c)
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        value = (len(ms) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += value
    return sorted((min(ms), len(p), min(members[p[:-1]]) if p else -1, len(ms), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, ms in members.items())


def as_nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def nodes_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return trie.prefix_nodes(*trie.rebuilt(trie.paths(df)))


def test_nodes_equal_plain(spark, monkeypatch):
    """Shared openings, copies, turnless conversations, ties, repeats, nulls, negative ids, missing bases, turns past several bands and shards."""
    monkeypatch.setattr(trie, "BAND", 3)
    monkeypatch.setattr(trie, "SHARD_PATHS", 10)
    monkeypatch.setattr(trie, "PACK_TURNS", 40)
    draw = random.Random(5)
    rows = []
    for c in [*range(-25, 45), *range(61, 75), 10**15 + 3]:
        for i in range(draw.choice([1, 1, 2, 3, 6, 14])):
            rows.append((c, draw.choice([i, i, 1, None]), draw.choice(["user", "assistant", None, ""]), draw.choice(["hi", "hi", "tell me more", "", None, " \t", "a b c"])))
    rows += [(100 + i, t, "user", f"same {t}") for i in range(0, 40) for t in range(9)]  # many copies of one conversation
    rows += [(7, 3, "user", "again")] * 3 + [(None, 1, "user", "of nobody")]
    assert as_nodes(nodes_of(spark, rows)) == plain_nodes(rows)


def test_one_conversation_with_most_turns(spark):
    rows = [(5, i, "user", f"t{i % 7}") for i in range(600)] + [(c, i, "user", f"t{i % 7}") for c in (6, 9) for i in range(c)]
    assert as_nodes(nodes_of(spark, rows)) == plain_nodes(rows)


def test_no_conversations(spark):
    assert nodes_of(spark, []).collect() == []
    assert nodes_of(spark, [(None, 1, "user", "x")]).collect() == []


def test_nodes_carry_their_turns(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = trie.paths(df)
    nodes = trie.prefix_nodes(turns.select("conv_id").distinct(), turns.withColumns({"a": F.lit(1), "least": F.lit("x"), "e1": F.lit(None).cast("int")}))
    rows = trie.with_turns(nodes, turns).collect()
    assert sum(r.text is None for r in rows) == 1 and all(r.depth == 0 for r in rows if r.text is None)
    assert len({(r.conv_id, r.depth) for r in rows}) == len(rows)


def test_double_array_holds_its_paths_only():
    draw = np.random.default_rng(4)
    path = draw.integers(1, 40, (300, 5))
    for row, n in enumerate(draw.integers(1, 6, 300)):
        path[row, n:] = 0
    tree = trie.DoubleArray(path)
    seen = {}
    for row in path:
        state = np.zeros(1, np.int64)
        for d, code in enumerate(row[row > 0]):
            state = tree.step(state, np.array([code]))
            assert seen.setdefault(int(state[0]), tuple(row[:d + 1])) == tuple(row[:d + 1])
    assert len(seen) == len({tuple(row[:d + 1]) for row in path for d in range(5) if row[d] > 0})
    with pytest.raises(ValueError):
        tree.step(np.zeros(1, np.int64), np.array([40]))


LONG = "It was the best of the times, and it was the worst of times for all of the people who lived in the town by the sea. "
PAGE = f"""<!DOCTYPE html><html lang=en><head><title>Not this</title><style>p {{ color: red }}</style><script>if (a < b) document.write("<p>no</p>")</script></head>
<body class="has-sidebar"><header class=site><h1>Site name</h1><p>{LONG}</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">{LONG}</div><!-- <p>{LONG}</p> -->
<article><header><h1>The   headline</h1><p class=byline>By the author</p></header><p>{LONG * 3}<p>Short &amp;amp; <b>bo</b>ld&nbsp;one.</p>
<div class="ad">{LONG}</div><aside>{LONG * 3}</aside><h2>A part</h2><p>{LONG}<br>goes on<table><tr><td>left<td>right</table>
<form action=/s><p>{LONG}</p><input value="x > y"></form><ul><li><a href=1>Read this other thing</a></li><li><a href=2>And that other thing</a></li></ul>
<section><h3>Comments (2)</h3><div><p>{LONG * 3}</p></div></section></article>
<div id="comments"><p>{LONG * 3}</p></div><footer>&copy; us. {LONG}</footer><div style="display: none">{LONG}</div></body></html>"""


def test_page_text_is_the_article():
    assert html_blocks.article_blocks(PAGE) == ["The headline", (LONG * 3).strip(), "Short &amp; bold one.", "A part", LONG + "goes on", "left", "right"]


def test_open_blocks_take_the_label_of_the_nearest_decided_block():
    page = f"<body><div><div><a href=1>one</a> <a href=2>two</a></div><p>Next to links</p></div><div><p>{LONG * 3}</p><p>Beside the text</p></div></body>"
    assert html_blocks.article_blocks(page) == [(LONG * 3).strip(), "Beside the text"]


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), (" \n ", ""), ("plain words", "plain words"), ("<p>one<p>two", "one\ntwo"), ("<P>A&#66;&eacute;&bogus;</P>", "ABé&bogus;"), ("<script>x", ""), ("<p>a<!-- b", "a"),
    ("<p title='it > is'>a</p>", "a"), ("a < b and c", "a < b and c"), ("<div>a<span>b</span>c</div>d", "abc\nd"), ("<nav>menu</nav>", ""), ("<p>x<br><br>y", "x\ny"), ("<p title=it's>a</p><p>it's b</p>", "a\nit's b")])
def test_small_pages(spark, page, want):
    rows = [(1, page, "old", 5)] * 2
    got = html_blocks.main_text(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, want, len(want))] * 2


def test_long_and_broken_pages_take_time_in_proportion():
    for part in ("<div>", "<a href='", "<p title=\"", "</div>", "<li><a>x", "<!--", "&amp", "<b><i>", "<script>"):
        assert isinstance(html_blocks.article_blocks(part * 60000), list)


def test_empty_pages(spark):
    assert html_blocks.main_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_given_pages_give_their_articles(spark):
    import html

    rows = queries.op13_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert rows
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h\d)>", inside)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_remembered_words_stay_under_their_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_BYTES", 5000)
    solved = pieces._Solved(lambda w: b"1234" * len(w))
    for i in range(500):
        assert solved[f"word{i}"] == b"1234" * len(f"word{i}")
        for part in (solved, solved.old):
            assert sum(pieces.ENTRY_BYTES + 4 * len(w) + len(ids) for w, ids in part.items()) <= 5000


def test_one_step_encodes_and_decodes_alike(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "a b. c\n", "x", 1), (3, "a b. c\n", "x", 1), (4, "Ärger 日本 ▁ " * 150000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, token_ids int")
    got = sorted(((r.doc_id, r.decoded, r.token_ids) for r in pieces.encode_and_decode(df).collect()), key=lambda r: r[0])
    model = pieces.loaded(pieces.MODEL)
    assert got == [(i, t or "", model.encode(t or "")) for i, t, _, _ in rows]
    assert pieces.encode_and_decode(df.limit(0)).collect() == []
