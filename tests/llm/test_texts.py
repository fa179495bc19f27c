"""Extraction and tokens: fixed pages, the public vocabulary's own library, the whole pipeline."""

import os
import random
import time
from collections import Counter

import pytest
from conftest_corpus import words
from test_operators import counted

import corpus_pipeline
from quire.llm import host_paths, pieces, queries, quality_rules

MODEL = queries.MODEL
SF = "/root/testdata/sf0.001"

ARTICLE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class=page-12>
<header><h1>Site name</h1><nav>menu <a href=/>home</a></nav></header><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="sidebar left">side</div><div class="post-body x7"><header class=in><h2>Head&amp;line</h2><span class="share">Share!</span></header>
<p>First <b>bold</b>&nbsp;text<br>second line <a href="x>y">link</a>.<p class='lead'>Unclosed &lt;tag&gt; &eacute; &#x1F389; 1 < 2
<ul><li>one<li>two <i>it</i></ul><!-- <p>no</p> --><table><tr><td>a<td>b</table><form>Name <input name=q><button>Go</button></form>
<div class="ad-slot banner">Buy</div><pre>  kept
   text </pre><section class="comments"><p>I think so too, a very long comment of a reader, longer than all the rest of the page put together, on and on and on, to no end, quite so, on and on and on,
to no end at all.</p></section></div></div><aside>more</aside><footer>&copy; me</footer></body></html>"""
TEXT = "Head&line\n\nFirst bold text second line link.\n\nUnclosed <tag> é 🎉 1 < 2\n\none\n\ntwo it\n\na\n\nb\n\nkept text"


def test_page_parts():
    nodes, blocks = host_paths.parse(ARTICLE)
    path, held = host_paths.best_path(nodes, blocks)
    assert path.endswith(">div.post-body.x#") and held > 0
    assert host_paths.main_text(nodes, blocks, path) == TEXT


@pytest.mark.parametrize("page", [
    "<body><nav>x</nav><article><h1>Head</h1><p>{lead}</p><div class=body><p>{rest}</p></div></article></body>",
    "<body><main><h1>Head</h1><section class=a><p>{lead}</p></section><section class=b><p>{rest}</p></section></main><aside>x</aside></body>",
    "<body><div id=wrap><div class=sidebar>x</div><div class=post><h1>Head</h1><div class=intro><p>{lead}</p></div><div class=rest><p>{rest}</p></div></div></div></body>",
    "<body><h1>Head</h1><div class=intro><p>{lead}</p></div><div class=rest><p>{rest}</p></div></body>",
])
def test_no_part_of_an_article_is_cut(page):
    lead, rest = " ".join(["lead"] * 50), " ".join(["rest"] * 100)
    nodes, blocks = host_paths.parse(page.format(lead=lead, rest=rest))
    assert host_paths.main_text(nodes, blocks, host_paths.best_path(nodes, blocks)[0]) == f"Head\n\n{lead}\n\n{rest}"


@pytest.mark.parametrize("page", ["", "plain", "<", "<p", "<p>x</b></p>", "<!-- open", "<script>never", "</div></div>", "<div " + "a" * 5000, "<div>" * 3000 + "deep", '<a title="open>x</a>', "<![CDATA[x]]>y", "\x00<b>퟿"])
def test_broken_pages_do_not_fail(page):
    nodes, blocks = host_paths.parse(page)
    host_paths.main_text(nodes, blocks, host_paths.best_path(nodes, blocks)[0])


@pytest.mark.parametrize("page, also", [
    ("<body><nav>m</nav><div class='content has-sidebar'><p>{0}</p></div></body>", ""),
    ("<body><div id=page class='layout-sidebar-right'><article><p>{0}</p></article></div></body>", ""),
    ("<body><article><div class='post with-comments'><p>{0}</p></div></article></body>", ""),
    ("<body><div class='no-ads'><p>{0}</p></div></body>", ""),
    ("<body><form id=aspnetForm><label>Find</label><input><select><option>x</select><p>{0}</p></form></body>", ""),
    ("<body><article><p>a</p><div class='text social-history'><p>{0}</p></div></article></body>", "a\n\n"),
    ("<body><div id='discussion-article'><p>{0}</p></div></body>", ""),
    ("<body><div class=widget><main><p>{0}</p></main></div><div class=sidebar>x</div></body>", ""),
    ("<body><div class='article-widget'><h1>a</h1><p>{0}</p></div><div class=comments><article>x y</article></div></body>", "a\n\n"),
])
def test_a_marked_wrapper_keeps_the_article(page, also):
    text = " ".join(["word"] * 100)
    parsed, blocks = host_paths.parse(page.format(text))
    assert host_paths.main_text(parsed, blocks, host_paths.best_path(parsed, blocks)[0]) == also + text


@pytest.mark.parametrize("extra", [
    "<div class=comments><p>{0}</p></div>", "<section id=comments><article><p>{0}</p></article></section>", "<div class='comment-list'><p>{0}</p></div>",
    "<div class='social-share'>{1}</div>", "<div class='site-footer'>{1}</div>", "<form><label>Your name</label><p>{1}</p></form>", "<div class='left-sidebar'>{1}</div>", "<div role=search>{1}</div>",
])
@pytest.mark.parametrize("inside", [True, False])
def test_extras_go_however_long_readers_comment(extra, inside):
    text, long, short = " ".join(["word"] * 100), " ".join(["remark"] * 400), " ".join(["aside"] * 30)
    made = extra.format(long, short)
    parsed, blocks = host_paths.parse(f"<body><article><h1>Head</h1><p>{text}</p>{made}</article></body>" if inside else f"<body><article><h1>Head</h1><p>{text}</p></article>{made}</body>")
    assert host_paths.main_text(parsed, blocks, host_paths.best_path(parsed, blocks)[0]) == f"Head\n\n{text}"


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "deep", "<b>" * 50_000 + "<hr>x" * 50_000, "<div class=a>x" * 50_000, "</p>" * 200_000 + "x", "<a \">\" " * 150_000, "<li><ul>" * 50_000 + "<b>" * 20_000 + "<li>x</li>" * 50_000])
def test_hostile_pages_take_a_time_that_grows_with_their_size(page):
    began = time.process_time()
    parsed, blocks = host_paths.parse(page)
    path, _ = host_paths.best_path(parsed, blocks)
    assert host_paths.main_text(parsed, blocks, path)
    assert time.process_time() - began < 10


def test_hosts_agree(spark):
    """A page whose own best container is another is read by its host's path; without the path, by its own."""
    usual = '<body><div class="top"><p>{0}</p></div><div class="main-{1}"><p>{2}</p></div></body>'
    rows = [(i, "http://A.example:80/x", usual.format("s", i, f"long main text {i} " * 9)) for i in range(5)]
    rows += [(10, "https://u@a.example/y", usual.format("short top " * 40, 7, "little")), (11, "//a.example", "<body><article><p>other layout</p></article></body>")]
    rows += [(12, None, "<p>alone</p>"), (13, "no url", None), (13, "no url", None), (None, "http://b.example", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS path")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in host_paths.extract(df).collect()), key=str)
    want = [(i, " ".join((f"long main text {i} " * 9).split())) for i in range(5)] + [(10, "little"), (11, "other layout"), (12, "alone"), (13, ""), (13, ""), (None, "")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert host_paths.extract(df.where("false")).count() == 0


def test_pages_of_the_table(spark):
    """Every given page's text is its article's, as told by the headings and paragraphs in it."""
    import html as h
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op5_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


ODD = ["", " ", "  ", "a", "▁", "▁▁x  y ", " a ﬁ é\t\n\n z", "日本語のテキスト ünïcödé 🎉👨‍👩‍👧 x", "x" * 700 + " " + "ab" * 400, "\x00\x01 b", "\n\n  \n", "don't   stop", "s" * 5000]


def test_ids_are_the_librarys(spark, docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words_ = pieces.load(MODEL)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in [*ODD, None]], "text string")).union(docs.select("text"))
    got = pieces.round_trip(table, words_).collect()
    assert len(got) == table.count()
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["same"] == (pieces.MARK not in (r["text"] or ""))
    out = pieces.encode(docs, words_)
    assert sorted(out.columns) == sorted(docs.columns) and pieces.encode(none, words_).count() == 0
    ids = [[1, 2, 0, 300], [3 + 0xE2, 3 + 0x96], [], [259, 300, 3 + 65]]
    back = pieces.decode(spark.createDataFrame([(i,) for i in [*ids, None]], "ids array<int>"), words_).collect()
    assert back[-1]["decoded"] is None and [b["decoded"] for b in back[:-1]] == library.decode(ids)
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode(spark.createDataFrame([([40000],)], "ids array<int>"), words_).collect()


def test_viterbi_is_the_librarys_for_unigram_models():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    random.seed(5)
    with open(MODEL, "rb") as file:
        spec = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    spec.trainer_spec.model_type = 1
    for p in spec.pieces:
        if p.type == 1:
            p.score = -random.uniform(4, 16) - (6 if len(p.piece) == 1 else 0)
    model = spec.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    # Runs of one character can be cut in several ways of equal score; the others have one best way.
    texts = [*(t for t in ODD if len(t) < 500), "some plain English words, and a few more of them", "die Würde des Menschen ist unantastbar"]
    for text, ids in zip(texts, pieces.Encoder(pieces.from_bytes(model))(texts)):
        assert ids.tolist() == library.encode(text)


def test_pipeline(spark):
    """Stage by stage against brute force on its own input; run() gives the same rows."""
    from quire.llm.common import save

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, save(stage(spark, docs, SF), "stage")
        made[name] = (before.collect(), docs.collect())
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and (name == names[-1]) == (len(docs.columns) > 5)
    before, after = made["quality rules"]
    features = {r["doc_id"]: counted(r["text"]) for r in before}
    failed = {i for i, f in features.items() if f[0] < 50 or 100 * f[4] > 50 * f[0]}
    assert not failed & {r["doc_id"] for r in after} and len(after) > 0.7 * (len(before) - len(failed))
    before, after = made["simhash near-dedup"]
    kept = {r["doc_id"] for r in after}
    shingles = {r["doc_id"]: {tuple(w[j:j + 5]) for w in [words(r["text"].lower())] for j in range(len(w) - 4)} for r in before}
    alike = lambda i, j: len(shingles[i] & shingles[j]) / max(1, len(shingles[i] | shingles[j]))
    for i in set(shingles) - kept:
        assert max(alike(i, j) for j in shingles if j != i) > 0.6
    assert not [(i, j) for i in kept for j in kept if i < j and alike(i, j) >= 0.85]
    before, after = made["substring dedup"]
    first, text = {}, {r["doc_id"]: words(r["text"]) for r in before}
    for i, w in text.items():
        for p in range(len(w) - 49):
            first[tuple(w[p:p + 50])] = min(first.get(tuple(w[p:p + 50]), i), i)
    for r in after:
        w = text[r["doc_id"]]
        gone = {j for p in range(len(w) - 49) if first[tuple(w[p:p + 50])] < r["doc_id"] for j in range(p, p + 50)}
        assert words(r["text"]) == [x for j, x in enumerate(w) if j not in gone] and r["n_chars"] == len(r["text"])
    before, after = made["mixing"]
    size = Counter()
    for r in before:
        size[r["source"]] += len(words(r["text"]))
    taken = Counter()
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    assert sum(taken.values()) <= sum(size.values()) + len(size) and all(taken[s] <= 3 * size[s] for s in size)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    before, after = made["sentencepiece"]
    assert len(before) == len(after) and all(r["same"] and r["ids"] == library.encode(r["text"]) for r in after)
    assert Counter(map(str, corpus_pipeline.run(spark, SF).collect())) == Counter(map(str, after))


def test_pipeline_on_odd_tables(spark, docs, none):
    """Nulls, repeated rows, empty tables and further columns pass through every stage."""
    for table in (docs, none):
        made = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, made, SF)
            assert made.columns == docs.columns
        assert {"ids", "n_tokens", "same"} <= set(corpus_pipeline.STAGES[-1][1](spark, made, SF).columns)
        made.count()


def test_model_is_no_part_of_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not os.path.abspath(MODEL).startswith(root + os.sep)


def test_rules_are_readable():
    rule = quality_rules.Rule((quality_rules.Condition("symbol_share", True, 0.1),), 9, 0)
    assert str(rule) == "symbol_share > 0.1 -> reject (9:0)"
