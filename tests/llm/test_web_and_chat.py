"""Operators on pages and conversations."""

import html
import random
import re
from itertools import accumulate

import duckdb
import pytest
from pyspark.sql import functions as F

from trellisgraph.llm import chat, html_extract, queries, url_filter


def test_articles_of_pages(spark, small):
    got = {r.page_id: r for r in queries.op1_main_text(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""),
        ("<p>", ""),
        ("<nav>a b c</nav>", ""),
        ("hi there", "hi there"),
        ("<div>x < y &amp; z&nbsp;&#233;&eacute;</div>", "x < y & z éé"),
        ("<p>a<p>b<script>if(a<b)</script>c", "a\n\nb\n\nc"),
        ("<article><p>one two<br>three</p><div class='ad-box'>Buy</div><aside>side</aside><p>four</p><form>f</form></article><footer>foot</footer>", "one two three\n\nfour"),
        ("<main><header><h1>T</h1></header><p>x y z</p><section id='comments'><p>bad words here</p></section></main>", "T\n\nx y z"),
        ('<p title="a>b">q r</p>', "q r"),
        ("<article><p>kept words</p><p hidden>gone</p><p style='display: none'>gone</p></article>", "kept words"),
        ("<article>text <!-- <p>no</p> --> more</article>", "text more"),
        ("<article><p>end of it<", "end of it<"),
        ("<article><p>end of it<a href='x", "end of it"),
        ("<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div><p>A text of several words stands here.</p></div><div><a href=c>Next</a> <a href=d>Last</a></div>", "A text of several words stands here."),
    ],
)
def test_shapes_of_pages(source, text):
    assert html_extract.extract(source) == text


def test_scan_finds_the_best_of_all_regions():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.5, -0.5, 0.0, 0.5, 2.0]) for _ in range(rng.randrange(30))]
        start, stop = html_extract.best_region(scores)
        every = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1)]
        assert sum(scores[start:stop]) == max(every, default=0)


def test_pages_match_a_search_over_all_regions(spark, small):
    """Whole pages: the text is that of the best of all regions of their tokens."""
    model = html_extract.model()
    for r in spark.read.parquet(f"{small}/pages.parquet").limit(8).collect():
        page = html_extract.Page(r.html, model)
        scores = [model.score(t) for t in page.tokens]
        upto = [0.0, *accumulate(scores)]
        best = max(((upto[b] - upto[a], a, b) for a in range(len(scores)) for b in range(a, len(scores) + 1)), key=lambda x: (round(x[0], 6), -(x[2] - x[1])))
        assert html_extract.extract(r.html) == "\n\n".join(page.blocks(best[1], best[2]))


WORDS = "Yeast eats the sugar of the flour and breathes out gas, which the dough holds in many small bubbles."


@pytest.mark.parametrize(
    "source, text",
    [
        ('<article><div class="article-header"><h1>Title of it</h1></div><p>Body words here now.</p></article>', "Title of it\n\nBody words here now."),
        (f'<article><h1>T</h1><section id="search-results"><p>{WORDS}</p></section><p class="warning">Mind the step here.</p></article>', f"T\n\n{WORDS}\n\nMind the step here."),
        (f"<div><h1>Dough</h1><p>{WORDS}</p><p>{WORDS}</p></div><footer>Made by us</footer><p>Terms of use of this site apply to you.</p>", f"Dough\n\n{WORDS}\n\n{WORDS}"),
        (f"<table><tr><td>{WORDS}</td></tr>{'<tr><td></td></tr>' * 60}<tr><td>{WORDS}</td></tr></table>", f"{WORDS}\n\n{WORDS}"),
        (f"<article><p>{WORDS}</p><div class='advert'>Buy more of it now</div><div class='reader-comments'><p>I liked it.</p></div><div id='cookie-notice'>We use cookies.</div></article>", WORDS),
        (f"<div class='content'><p>{WORDS}</p><div class='sidebar-right'>More of it</div></div><div class='site-footer'>Our address</div>", WORDS),
    ],
)
def test_what_classes_decide(source, text):
    assert html_extract.extract(source) == text


@pytest.mark.parametrize("source", ["<b></i>" * 150_000, "<b>" * 100_000 + "<hr>" * 100_000, "<p><object>" + "<b>" * 100_000 + "<hr>" * 100_000, "<li>" * 200_000, "<option><td>" * 90_000])
def test_broken_markup_takes_linear_time(source):
    import time

    html_extract.model()
    began = time.process_time()
    html_extract.extract(source + "<p>some words")
    assert time.process_time() - began < 4


def test_awkward_pages(spark):
    deep = "<div>" * 3000 + "deep words" + "</div>" * 3000
    rows = [(1, None), (2, ""), (3, "<p>x</p>"), (3, "<p>x</p>"), (None, "<p>y</p>"), (4, deep), (5, "<p " * 20000), (6, "<" * 50000)]
    pages = spark.createDataFrame([(i, h, "t") for i, h in rows], "page_id long, html string, text string")
    got = html_extract.main_text(pages, ["page_id"])
    by_id = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows) and by_id[1] == by_id[2] == "" and by_id[3] == "x" and by_id[None] == "y" and by_id[4] == "deep words"
    assert html_extract.main_text(pages.limit(0), ["page_id"]).count() == 0


def test_weights_have_the_methods_signs():
    w = html_extract.weights()
    assert w["word"] > 0 and w["word-article"] > 0 and all(w[k] < 0 for k in ("tag-block", "tag-inline", "tag-link", "tag-end", "chrome"))


def oracle(sql, **frames):
    c = duckdb.connect()
    for name, frame in frames.items():
        c.register(name, frame.toPandas())
    return sorted(c.sql(sql).fetchall(), key=str)


def test_awkward_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://COM/en/", "https://a.example.com/en/7x?q", "https://a.example.com/en/8", "http://example.com.au/en/7", "http://net/de/", "http://x.example.net/de/8/9",
        "http://notexample.net/de/8", "x://org/es/#f", "http://org/es", "ftp://ORG/ES/", "http://a..com/en/1", "http://.com/en/", "http://com", "a://b://com/en/", "http://u@com/en/", "http://com:80/en/", "http://com?/en/", "http://com\n/en/1",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls + urls[4:6])], "page_id long, url string, host string, verdict string")
    got = sorted([tuple(r) for r in url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()], key=str)
    assert got == oracle(url_filter.ORACLE_SQL, pages=pages.select("page_id", "url"))
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules=[]).collect()} == {"allow"}


def test_verdicts_of_the_contracts_list(spark):
    """Each rule's word as the contract of op7 lists it; ORACLE_SQL differs in net/de/."""
    assert url_filter.RULES == [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    wanted = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://example.com/en/71": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"),
        "http://x.example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/81": ("example.net/de/8", "block"),
        "http://a.b.org/es/": ("org/es/", "block"),
        "http://a.net/en/": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(wanted)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert [got[i] for i in range(len(wanted))] == list(wanted.values())


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(0, 3000, 3).selectExpr("concat('k', id) as key")
    universe = spark.range(0, 30000).selectExpr("concat('k', id) as key")
    cascade = url_filter.Cascade.build(listed, universe)
    wrong = universe.where(cascade.holds(universe.key) != universe.key.isin([f"k{i}" for i in range(0, 3000, 3)])).count()
    assert wrong == 0 and len(cascade.levels) > 1


def many_rules():
    return [(f"h{i}.org", "/" + "ab"[i % 2], ("block", "allow")[i % 3 == 0]) for i in range(3000)] + [("org", "/a", "block"), ("h7.org", "/b/x", "allow")]


@pytest.mark.parametrize("literal_bytes", [url_filter.LITERAL_BYTES, 100])
def test_many_rules_match_brute_force(spark, monkeypatch, literal_bytes):
    """Filters of many words, and the join that takes their place beyond the size of a literal."""
    monkeypatch.setattr(url_filter, "LITERAL_BYTES", literal_bytes)
    rules = many_rules()
    urls = [f"http://{('', 'x.')[i % 2]}h{i % 4000}.org/{'abc'[i % 3]}{('', '/x')[i % 5 == 0]}" for i in range(9000)] + [None, "http://other.com/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by_rule = {(h, p): v for h, p, v in rules}
    for r in url_filter.judge(pages, rules).collect():
        labels = r.host.split(".")
        hits = [(len(h) + len(p), h, p) for n in range(1, len(labels) + 1) for h in [".".join(labels[-n:])] for p in ("/a", "/b", "/b/x") if (h, p) in by_rule and r.path.startswith(p)]
        best = max(hits)[1:] if hits else None
        assert (r.rule, r.verdict) == ((best[0] + best[1], by_rule[best]) if best else (None, "allow"))


def test_filters_are_planned_quickly(spark):
    import time

    listed = spark.range(60_000).selectExpr("concat('k', id) as key")
    cascade = url_filter.Cascade.build(listed, spark.range(200_000).selectExpr("concat('k', id) as key"))
    began = time.monotonic()
    assert spark.range(200_000).selectExpr("concat('k', id) as key").where(cascade.holds(F.col("key"))).count() == 60_000
    assert time.monotonic() - began < 8 and len(cascade.levels[0].words) > 1000


def test_judging_runs_no_python(spark, small):
    plan = queries.op7_url_cascade(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Arrow" not in plan


def test_awkward_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "again"), (1, 2, "assistant", "again"), (2, 0, "user", None), (3, None, None, "x"), (3, 1, "system\nrole", "<|im_start|>\\n<\\|"),
        (None, 0, "user", "no id"), (None, 1, "assistant", "of one conversation"), (None, 1, "assistant", "of one conversation"), (4, 5, "assistant", "first \\ <|im_end|>\n"), (4, 6, "user", "tail"), (5, 0, "assistant", ""), (6, 0, "user", "é🙂" * 30000), (6, 1, "assistant", "é🙂" * 30000),
    ]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, chars string")
    got = sorted([tuple(r) for r in chat.read_back(chat.expand(chat.with_probe(table))).collect()], key=str)
    assert got == oracle(chat.ORACLE_SQL, conversations=table.drop("chars"))
    assert chat.read_back(chat.expand(table.limit(0))).count() == 0


def test_examples_train_on_one_reply_each():
    turns = [("system", "s"), ("user", "u"), ("assistant", "A<|im_end|>"), ("user", "v"), ("assistant", "B\\"), ("user", "w")]
    examples = list(chat.examples_of(iter(turns)))
    assert [chat.unescape(t[a:b]) for _, t, a, b, _ in examples[:2]] == ["A<|im_end|>", "B\\"]
    assert [chat.parse(e[1]) for e in examples] == [turns[:3], turns[:5], turns] and [e[4] for e in examples] == [False, False, True]


