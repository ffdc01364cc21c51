"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page becomes a sequence of tokens: words of visible text score positive, tags and whole boilerplate elements score
negative. A token's class says what it is (``word``, ``word-link``, ``tag-block``, ``tag-inline``, ``tag-link``, ``tag-end``,
``chrome``) and where: within an article (``-article``), beside one (``-outside``), after the footer of a page without
one (``-tail``). Tags between two texts count once for each class, so empty markup cannot part two texts. Signs are the
method's, words positive and tags negative, but for words that stand beside an article, after a footer, or in links. One
linear scan finds the contiguous region with the largest sum, and its text is the result, without the boilerplate
elements inside it.

All weights are log-odds learned from labelled pages (``LABELLED``: a written sample of common layouts; main text lies between
marks): of the classes, and of the stems (first ``STEM`` letters) of words in the class, id and role of the elements around a
text, where labelled pages have a stem within articles with a weight of its own there. An element is boilerplate by its tag
(scripts, styles, menus, asides, forms, ...), by being hidden, or if the weights of its own stems sum to less
than -``EVIDENCE``. Stems that no labelled page has weigh nothing. A header counts unless it is inside an article.

Text: character references are decoded once, white space within a block becomes one space, blocks are trimmed and joined
by two line feeds; block elements end a block, a line break element is white space. A null, empty or textless page gives
an empty text. Broken markup never fails and takes linear time: unclosed elements end with their parents, a stray end tag is
ignored, an unfinished tag at the end is dropped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from math import log

from pyspark.sql import DataFrame

from .common import per_text

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that are never main text.
CHROME_TAGS = {
    "applet", "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "fieldset", "footer", "form", "frameset", "head", "header", "iframe", "input", "label", "legend", "map",
    "menu", "nav", "noembed", "noframes", "noscript", "object", "option", "progress", "meter", "script", "search", "select", "style", "svg", "template", "textarea", "title", "video",
}
#: Letters of a word of a class, id or role that are told apart.
STEM = 6
#: Log-odds against main text that make an element boilerplate by its stems.
EVIDENCE = 1.0
#: With these a class tells a state of the page ("has-sidebar", "comments-open"), not what an element is.
STATE_WORDS = {"has", "with", "without", "no", "enabled", "disabled", "open", "closed", "free", "on", "off"}
#: Start tags that close an open element of the same kind.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Names after which a cell, an item or an option is not closed by a start tag of the same kind.
_SCOPES = {"ul", "ol", "dl", "table", "select", "div", "article", "section"}

#: Labelled pages: main text lies between <!--main--> and <!--/main-->, but for what is between <!--/main--> and <!--main--> again.
LABELLED = [
    "<div id=page-header class='site-header masthead'><div class='topbar toolbar'>Today is Monday, the weather is fine</div><div class='skip'>Skip to the content of this page</div></div><div class='breadcrumbs'>Start of the site / News / Region / Here</div><article class='article post entry content'><!--main--><div class='article-header page-header'><h1 class='entry-title headline'>The old mill is open again after a long time</h1></div><p class='lead intro'>After years of work the mill by the river grinds corn again, as it did for two centuries before the war.</p><!--/main--><div class='ad ads advert adbox adslot adsense banner'>Now for half the price: our best shoes for the whole family, only today and only while stocks last, order here and save money</div><!--main--><div class='article-body text story'><p>Volunteers took the stones out, cut them anew and put them back, and the wheel was made of oak from the hills around.</p></div><!--/main--><div class='share social sharing'>Share this with friends on all networks, send it by mail, print it, like it and follow us everywhere</div><!--main--><section class='results body'><p>Some five hundred people came on the first day, and the flour was sold out before noon.</p></section><!--/main--></article><div id=comments class='comments replies disqus'><p>Great text, I was there with my children and we liked it a lot, thanks to all who helped with it.</p><p>When will it be open again, does anybody know, and is there a place to park nearby for a bus?</p></div><div class='sidebar widget related'>Other texts you may like: the bridge, the road, the church, the school, the market, the station</div><div class='newsletter subscribe signup popup overlay modal'>Sign up for our letter and get the news of the week by mail, free of charge, every Friday</div><div class='cookie consent gdpr notice'>We use cookies to make this site better for you; by going on you agree to that and to our rules</div><div class='footer copyright disclaimer contentinfo'>All rights reserved by the owners of this paper, nothing may be copied without our consent</div>",
    "<article class=post><!--main--><h2 class=post-title>A walk in the woods</h2><div class='entry-content text'><p>The path begins behind the chapel and climbs through beeches to the ridge, where the wind blows all year.</p><!--/main--><div class='sponsor sponsored promo promoted promotion paywall'>Brought to you by the makers of the best boots in the land, who wish you dry feet on every walk you take, and warm ones as well</div><!--main--><p>From the ridge one sees three lakes, and in clear weather the sea behind them.</p></div><!--/main--><section class='comments'><p>We did this walk last year and got lost at the second lake, so take a map with you when you go there.</p><p>A good walk, but too long for small children, mine were tired after the first hour and cried.</p></section><div class='advertisement advertising adunit tracking'>This summer: two nights for the price of one in all our houses by the lakes, breakfast and boats included, book before May</div><div class='cookies notice banner'>This page keeps small files on your machine to count visits, to show what you may like, and for no other purpose than that</div><div class='share social sharing'>Tell your friends about this walk on all the networks that you use, by mail or by letter</div><div class='related pager pagination'>More walks: the gorge, the old railway, the three castles, the vineyards, the long ridge, page two, page three</div><div class='sidebar signup newsletter subscribe'>The author writes about walks each week; leave your address and get each new one by mail on Sunday</div></article>",
    "<div id=page class='site page-wrapper container layout'><div class='header page-header'>The house of chairs, tables and lamps</div><div class='menu navbar navigation menubar'>Home News Sport Weather Culture Travel Shop Contact</div><div id=main class=content><!--main--><h1>How to mend a chair</h1><p>Take the loose leg out, scrape the old glue off and let the wood dry for a day.</p><p>Then put new glue on, set the leg in and hold it with a clamp until the next morning.</p><!--/main--></div><div id=sidebar class='widget nav'>Other things to mend: tables, lamps, clocks, shoes, roofs, fences, bicycles and boats</div><div class='search form'>Search for words</div><div class='login account form'>Your name and secret word</div><footer>Made by people who like chairs</footer></div><p>Terms of use and imprint of this site apply to all visits and all texts.</p><p>Hosted in the north by friends of ours.</p>",
    "<head><title>One</title><script>var a = 1;</script></head><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><!--main--><article><h1>Rain over the hills</h1><p>Rain fell on the hills for the third day in a row, and the rivers rose.</p><p>The <b>old bridge</b> was closed in the morning, while <a href=c>boats</a> carried people over the water.</p></article><!--/main--><footer>Copyright of the paper</footer>",
    "<div class=menu><a href=a>Start</a> <a href=b>Shop</a> <a href=c>Contact</a></div><div><!--main--><h1>How bread rises</h1><p>Yeast eats the sugar of the flour and breathes out gas, which the dough holds in many small bubbles.</p><!--/main--><div class=ad>Buy our flour today and save</div><!--main--><p>Warmth helps the yeast, so bakers let dough rest near the oven until it has doubled.</p><ul><li>Keep it warm and out of the wind.<li>Do not hurry the dough.</ul><!--/main--></div><div id=sidebar><a href=d>Old posts</a> <a href=e>Recipes</a></div>",
    "<main><!--main--><h2>Minutes of the council</h2><p>The council met at eight and heard the report on the schools of the district.</p><blockquote>We need more rooms, said the head of the school board.</blockquote><p>A vote will follow in the coming month.</p><!--/main--></main><div><h3>More</h3><a href=x>Weather</a><br><a href=y>Sport</a></div><div><p>Write to us at the desk.</p></div>",
    "<header><a href=/>Logo</a><form><input name=q><button>Search</button></form></header><article><!--main--><h1>Stars</h1><p>Stars shine because hydrogen turns to helium deep within them, and light takes long to leave.</p><table><tr><td>Sun<td>yellow<tr><td>Vega<td>white</table><p>Their colour tells how hot they are at the surface.</p><!--/main--></article><section class=comments><p>Great text, thanks for it!</p><p>I do not agree with this at all.</p></section><p>All rights reserved by the owner of this site.</p>",
    "<div><a href=z>Top</a></div><article><!--main--><h1>Glass</h1><p>Glass is made of sand.</p><!--/main--><div class=promo>Sign up</div><!--main--><p>Heat <em>melts</em> it.</p><aside>Aside</aside><p>Tin keeps it <a href=q>flat</a>.</p><!--/main--></article><nav>Pages</nav><div>Made with care</div>",
    "<p><a href=u>Up</a></p><!--main--><h1>Wind</h1><h2>Why</h2><p>Warm air rises.</p><p>Cool air follows.</p><ul><li>Day<li>Night</ul><p>So <i>wind</i> blows from sea to land by <a href=s>day</a>.</p><dl><dt>Gale<dd>strong wind</dl><!--/main--><script>x()</script><a href=v>Imprint</a><hr>",
    "<table><tr><td><a href=1>A</a><br><a href=2>B</a><br><a href=3>C</a></td><td><!--main--><p>On this page I keep notes about the trains that ran through our valley until the line was closed.<br>They were slow, but on time.</p><p>Most engines were built before the war and ran for fifty years with little repair.</p><!--/main--></td></tr></table><center><a href=4>Back</a> | <a href=5>Next</a></center>",
]


class Page:
    """Tokens of a page: (class, how many, kind, text). kind: 't' text, 'b' block edge, 's' white space, '' other.

    Without a model no element is boilerplate by its class, id or role, and ``stems`` are kept for each text.
    """

    def __init__(self, source: str, model: Model | None = None):
        self.model = model
        self.tokens: list[tuple[str, int, str, str]] = []
        self.marks: list[tuple[int, bool]] = []
        self.stems: dict[int, tuple[frozenset[str], ...]] = {}
        self._read(source, bool(re.search(r"<(?:article|main)[\s>]", source, re.I)))

    def _read(self, source: str, has_article: bool) -> None:
        # Open elements: name, in boilerplate, in an article, in a link, stems around. Beside it how many of each name are
        # open, and the places of those that the closing of paragraphs and of items looks at.
        stack: list[tuple[str, bool, bool, bool, tuple[frozenset[str], ...]]] = []
        opened: Counter[str] = Counter()
        blocks: list[int] = []
        items: list[int] = []
        tokens = self.tokens
        run: set[str] = set()  # classes of tags since the last text
        tail = False
        at = 0
        nothing = ("", False, False, False, ())

        def place(article: bool) -> str:
            return "-article" if article else "-outside" if has_article else "-tail" if tail else ""

        def text(raw: str) -> None:
            _, chrome, article, link, stems = stack[-1] if stack else nothing
            if chrome or not raw:
                return
            words = len(raw.split())
            if words:
                run.clear()
            where = place(article)
            if stems:
                self.stems[len(tokens)] = stems
            tokens.append(("word" + (where or "-link" * link), words, "t", raw))

        def tag(name: str, kind: str) -> None:
            tokens.append((name, int(name not in run), kind, ""))
            run.add(name)

        def pop_to(depth: int) -> None:
            nonlocal tail
            while len(stack) > depth:
                name, chrome, _, _, _ = stack.pop()
                opened[name] -= 1
                for places in (blocks, items):
                    if places and places[-1] == len(stack):
                        places.pop()
                inside = stack[-1] if stack else nothing
                tail = tail or name == "footer" and not inside[1]
                if not chrome:
                    tag("tag-end" + place(inside[2]), "b" if name in BLOCK else "")

        size = len(source)
        while at < size:
            cut = source.find("<", at)
            if cut < 0:
                text(source[at:])
                break
            m = _TOKEN.match(source, cut)
            if not m:  # a lone <
                following = source.find("<", cut + 1)
                following = size if following < 0 else following
                text(source[at:following])
                at = following
                continue
            text(source[at:cut])
            at = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                if m["comment"] in ("main", "/main"):
                    self.marks.append((len(tokens), m["comment"] == "main"))
                continue
            if not m["name"] and not source.endswith(">", cut, at):
                break  # unfinished at the end
            name = name.lower()
            if m["close"] or m["close2"]:
                if opened[name]:
                    depth = len(stack) - 1
                    while stack[depth][0] != name:
                        depth -= 1
                    pop_to(depth)
                elif name == "p" or name == "br":
                    tag("tag-end", "b" if name == "p" else "s")
                continue
            attributes = m["attributes"] if m["name"] else m["attributes2"]
            if name in BLOCK and blocks and stack[blocks[-1]][0] == "p":  # a block ends an open paragraph
                pop_to(blocks[-1])
            if name in _SIBLINGS:
                while items and stack[items[-1]][0] in _SIBLINGS[name]:
                    pop_to(items[-1])
            _, chrome, article, link, stems = stack[-1] if stack else nothing
            within = article or name in ("article", "main")
            if within and not article:
                stems = ()  # what is around an article says nothing of it
            if not chrome:
                own_stems = _stems(name, attributes)
                if own_stems and not self.model:
                    stems = (*stems, own_stems)
                own = name in CHROME_TAGS and not (name == "header" and article) or _is_hidden(attributes)
                if own_stems and not own and self.model:
                    own = self.model.is_boilerplate(own_stems, within)
                if own and name not in VOID:
                    tag("chrome" + place(article), "b" if name in BLOCK or name in ("script", "style") else "")
                elif not own:
                    kind = "tag-link" if name == "a" else "tag-block" if name in BLOCK else "tag-inline"
                    tag(kind + place(article), "b" if name in BLOCK else "s" if name == "br" else "")
                chrome = own
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                if end is None:
                    break
                if not chrome:
                    text(source[at : end.start()])
                close = source.find(">", end.start())
                at = size if close < 0 else close + 1
            elif name not in VOID and not (attributes.endswith("/") and name in ("svg", "path")):
                if name in BLOCK or name in ("button", "object"):
                    blocks.append(len(stack))
                if name in _SIBLINGS or name in _SCOPES:
                    items.append(len(stack))
                opened[name] += 1
                stack.append((name, chrome, within, link or name == "a", stems))

    def blocks(self, start: int, stop: int) -> list[str]:
        out, part = [], []
        for _, _, kind, raw in self.tokens[start:stop]:
            if kind == "t":
                part.append(raw)
            elif kind == "s":
                part.append(" ")
            elif kind == "b" and part:
                out.append("".join(part))
                part = []
        out.append("".join(part))
        decoded = (" ".join(html.unescape(b).split()) for b in out)
        return [b for b in decoded if b]


def _stems(name: str, attributes: str) -> frozenset[str]:
    """Stems of the words of an element's class, id and role."""
    if not attributes or name in ("html", "body", "main"):
        return frozenset()
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for token in (m[2] or m[3] or m[4] or "").split():
                parts = {w.lower() for w in _PART.findall(token)}
                if STATE_WORDS.isdisjoint(parts):
                    out |= {p[:STEM] for p in parts}
    return frozenset(out)


def _is_hidden(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Model:
    """Log-odds of token classes and of stems within and without the labelled main texts, one half added to each count."""

    def __init__(self, labelled: list[str]):
        tokens: list[tuple[bool, str, int, tuple[frozenset[str], ...]]] = []
        for source in labelled:
            page = Page(source)
            marks = iter([*page.marks, (len(page.tokens) + 1, False)])
            edge, opens = next(marks)
            within = False
            for i, (name, n, _, _) in enumerate(page.tokens):
                while i >= edge:
                    within = opens
                    edge, opens = next(marks)
                tokens.append((within, name, n, page.stems.get(i, ())))
        marked = [(within, name.endswith("-article"), stem, n) for within, name, n, around in tokens for stem in frozenset().union(*around)]
        self.stems = self._odds((within, stem, n) for within, article, stem, n in marked if not article)
        self.article_stems = self._odds((within, stem, n) for within, article, stem, n in marked if article)
        # Words under stems of boilerplate do not tell what their place is worth.
        found = self._odds((within, name, n) for within, name, n, around in tokens if not any(self.is_boilerplate(stems, name.endswith("-article")) for stems in around))
        #: Words of a page without an article lie both in and around the text: they score, tags and chrome cost.
        self.classes = {k: max(v, 0.1) if k in ("word", "word-article") else min(v, -0.1) for k, v in found.items()}

    @staticmethod
    def _odds(counted: Iterable[tuple[bool, str, int]]) -> dict[str, float]:
        inside, outside = Counter(), Counter()
        for within, name, n in counted:
            (inside if within else outside)[name] += n
        total_in, total_out = inside.total() + 1, outside.total() + 1
        return {k: log((inside[k] + 0.5) / total_in) - log((outside[k] + 0.5) / total_out) for k in inside.keys() | outside.keys()}

    def is_boilerplate(self, stems: frozenset[str], article: bool) -> bool:
        """By an element's own stems; what is known of one within articles goes first there, else last."""
        first, second = (self.article_stems, self.stems) if article else (self.stems, self.article_stems)
        return sum(first[s] if s in first else second.get(s, 0.0) for s in stems) < -EVIDENCE

    def score(self, token: tuple[str, int, str, str]) -> float:
        return self.classes.get(token[0], -0.1) * token[1]


@lru_cache(maxsize=1)
def model() -> Model:
    return Model(LABELLED)


def weights() -> dict[str, float]:
    """Weights of the token classes."""
    return model().classes


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, stop) of the contiguous region with the largest sum, by one linear scan; (0, 0) if none is positive."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def extract(source: str) -> str:
    """The main text of one page."""
    page = Page(source, model())
    return "\n\n".join(page.blocks(*best_region(list(map(model().score, page.tokens)))))


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` plus text and n_chars (code points) of every whole page; null pages give an empty text."""

    def make():
        def apply(sources):
            texts = [extract(s.decode()) for s in sources]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return apply

    return per_text(pages, "text string, n_chars bigint", make, keep, html_col)
