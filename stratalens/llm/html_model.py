"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element and text run is a variable with two states, boilerplate and content.  A node's
observed features depend on its state; its state depends on its parent's through a 2 x 2 table
that differs by kind of node and by what the parent is called.  Sum-product messages go up the tree once and down once, which on
a tree gives exact marginals; text whose content marginal is at least ``CONTENT`` is kept.

The tables are counts (with add-one smoothing) from labelled pages.  The labelled pages come
from ``labelled_pages``: a seeded writer of pages of many layouts whose text runs it marks itself,
so that nothing is fitted to the tables that are extracted.

Text of kept runs: character references decoded, white space inside a block to one space, trimmed,
empty blocks dropped, blocks joined in page order by one line feed.  Nothing else is dropped.

Defined cases: null or empty html gives empty text; text outside any element is scored like any
other; unclosed elements end with their parents; null or repeated ids are extracted each; other
columns are ignored; an empty table gives an empty result.  Pages of any length and any depth of
nesting are read whole.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import arrow_batch, parts, table

CONTENT, PAGES, SEED = 0.5, 600, 11
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the second kind, without crossing the third.
ENDS = {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
ENDS |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPE = frozenset("article aside body button div footer form header html main menu nav ol section table td th ul dl".split())
KINDS = {
    "article": "main", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "select": "form", "option": "form", "input": "form", "fieldset": "form", "dialog": "notice",
    "p": "para", "blockquote": "para", "pre": "para", "figcaption": "para", "h1": "head", "h2": "head", "h3": "head", "h4": "head", "h5": "head", "h6": "head", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "tr": "table", "td": "table", "th": "table", "a": "link", "div": "box", "section": "box", "body": "body", "html": "body", "head": "meta",
}
HINTS = [
    ("comment", "comment comments disqus reply replies respond discussion"),
    ("ad", "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner adbox adslot"),
    ("nav", "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc topbar"),
    ("side", "sidebar side aside related recommended widget widgets trending popular"),
    ("foot", "footer foot colophon copyright legal bottom"),
    ("top", "header masthead site logo brand top"),
    ("notice", "cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe signup share social paywall"),
    ("form", "form login search signin"),
    ("body", "article content post entry main story text body"),
]
_HINT = {w: name for name, words in reversed(HINTS) for w in words.split()}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s>=/])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\s]+")


@dataclass
class Dom:
    """Nodes in page order (a parent before its children); text nodes have ``text``."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)

    def add(self, parent: int, tag: str, attrs: str = "", text: str | None = None) -> int:
        self.parent.append(parent), self.tag.append(tag), self.attrs.append(attrs), self.text.append(text)
        return len(self.parent) - 1


class _Open:
    """The open elements, the root first, with where each name and each scope stands: finding one is no walk, however deep."""

    def __init__(self, root: int):
        self.nodes, self.names, self.where, self.scopes = [root], ["#root"], {}, []

    def push(self, node: int, name: str) -> None:
        self.where.setdefault(name, []).append(len(self.nodes))
        if name in SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node), self.names.append(name)

    def cut(self, at: int) -> None:
        """Close the element at depth ``at`` and all within it."""
        while len(self.nodes) > at:
            self.nodes.pop()
            self.where[self.names.pop()].pop()
        while self.scopes and self.scopes[-1] >= at:
            self.scopes.pop()

    def end(self, name: str) -> None:
        """An end tag closes the innermost element of its name; that of an inline one does not reach out of a scope."""
        at = self.where.get(name)
        if at and (name not in INLINE or not self.scopes or at[-1] > self.scopes[-1]):
            self.cut(at[-1])

    def over(self, names: set[str]) -> None:
        """Close what a start tag implies is over: the outermost of ``names`` within the innermost other scope."""
        edge = next((x for x in reversed(self.scopes) if self.names[x] not in names), 0)
        inside = [at[bisect.bisect(at, edge)] for x in names if (at := self.where.get(x)) and at[-1] > edge]
        if inside:
            self.cut(min(inside))


def parse(page: str) -> Dom:
    """A forgiving parser: never fails, ignores stray end tags, closes what a start tag implies is over."""
    dom = Dom()
    stack = _Open(dom.add(-1, "#root"))
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or len(token) == 1:
            dom.add(stack.nodes[-1], "#text", text=token)
        elif token[1] == "/":
            stack.end(re.match(r"</([^\s/>]*)", token)[1].lower())
        elif token[1].isalpha():
            name = re.match(r"<([^\s/>]*)", token)[1].lower()
            if over := ENDS.get(name):
                stack.over(over)
            node = dom.add(stack.nodes[-1], name, token[len(name) + 1 : -1])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else n
                stack.push(node, name)
            elif name not in VOID and not token.endswith("/>"):
                stack.push(node, name)
    return dom


def kind(tag: str) -> str:
    return "text" if tag == "#text" else "raw" if tag in RAW else KINDS.get(tag, "inline" if tag in INLINE else "other")


def relation(dom: Dom, i: int) -> str:
    """Which table is between a node and its parent: that of the parent's hint, if it has one, else of the node's kind."""
    sign = hint(dom.attrs[dom.parent[i]])
    return kind(dom.tag[i]) if sign == "-" else f"in {sign}"


def hint(attrs: str) -> str:
    """The first kind of word found in class, id and role; hidden elements have a hint of their own."""
    if not attrs:
        return "-"
    if _HIDDEN.search(attrs + " "):
        return "hidden"
    names = {_HINT[w] for m in _ATTR.finditer(attrs) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()) if w in _HINT}
    return next((name for name, _ in HINTS if name in names), "-")


def observe(dom: Dom) -> tuple[list[tuple[tuple[str, str], ...]], list[bool]]:
    """Each node's features as (name, value): kind, hint, and for elements link share and amount of text below; and which nodes hold all text of their parents.

    An element is content if most of its text is, so such a node and its parent are in one state for
    certain.  A plain wrapper of one node has no features but its hint: however many there are, they
    say nothing that the node does not.
    """
    n = len(dom.tag)
    chars, linked, full = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        if dom.text[i] is not None and dom.tag[p] not in RAW:
            chars[i] = len(dom.text[i].strip())
        if dom.tag[i] in ("a", "button"):
            linked[i] = chars[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        full[p] += chars[i] > 0
    out = []
    for i in range(n):
        if dom.text[i] is not None:
            out.append((("size", str(min(4, int(math.log2(1 + chars[i]) / 2)))),))
            continue
        named, sign = kind(dom.tag[i]), hint(dom.attrs[i])
        if full[i] == 1 and named in ("box", "inline", "other"):
            out.append((("hint", sign),) if sign != "-" else ())
            continue
        share = linked[i] / chars[i] if chars[i] else 0
        out.append((("kind", named), ("hint", sign), ("links", "none" if not linked[i] else "few" if share < 0.4 else "most"), ("size", str(min(5, int(math.log2(1 + chars[i]) / 2.5))))))
    return out, [i > 0 and chars[i] > 0 and full[dom.parent[i]] == 1 for i in range(n)]


#: Between a node and a parent whose text it holds alone.
SAME = ((0.0, -50.0), (-50.0, 0.0))


@dataclass
class Model:
    """Log tables: ``emit[name][value]`` a pair by state, ``move[relation]`` rows by parent state, ``root`` a pair."""

    emit: dict[str, dict[str, np.ndarray]]
    move: dict[str, np.ndarray]
    root: np.ndarray

    def marginals(self, dom: Dom) -> np.ndarray:
        """P(content) of every node by one upward and one downward pass of sum-product messages."""
        n = len(dom.tag)
        up = np.zeros((n, 2))
        seen, same = observe(dom)
        for i, features in enumerate(seen):
            for name, value in features:
                if (e := self.emit[name].get(value)) is not None:
                    up[i] += e
        up, move = up.tolist(), {k: v.tolist() for k, v in self.move.items()}
        flat = [[0.0, 0.0], [0.0, 0.0]]
        tables = [SAME if same[i] else move.get(relation(dom, i), flat) for i in range(n)]
        message = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            (a, b), (c, d) = tables[i]
            x, y = up[i]
            message[i] = (_add(a + x, b + y), _add(c + x, d + y))
            p = up[dom.parent[i]]
            p[0] += message[i][0]
            p[1] += message[i][1]
        belief = [(0.0, 0.0)] * n
        belief[0] = (up[0][0] + self.root[0], up[0][1] + self.root[1])
        for i in range(1, n):
            p, m = belief[dom.parent[i]], message[i]
            x, y = p[0] - m[0], p[1] - m[1]  # the parent without this child
            (a, b), (c, d) = tables[i]
            s, t = up[i][0] + _add(x + a, y + c), up[i][1] + _add(x + b, y + d)
            z = _add(s, t)
            belief[i] = (s - z, t - z)
        z = _add(*belief[0])
        belief[0] = (belief[0][0] - z, belief[0][1] - z)
        return np.exp(np.array(belief)[:, 1])


def _add(a: float, b: float) -> float:
    """log(exp a + exp b)."""
    m = a if a > b else b
    return m + math.log1p(math.exp(-abs(a - b)))


def extract(page: str | None, model: Model, threshold: float = CONTENT) -> str:
    if not page:
        return ""
    dom = parse(page)
    keep = model.marginals(dom) >= threshold
    blocks, now, last = [], [], None
    # A run belongs to the block of its nearest block element; leaving or entering one ends the block.
    block = [0] * len(dom.tag)
    for i in range(1, len(dom.tag)):
        t, p = dom.tag[i], dom.parent[i]
        is_block = t != "#text" and t not in INLINE and t not in VOID
        block[i] = i if is_block else block[p]
        if is_block or t in ("hr",):
            last = None if last is None else -1
        if t == "br" or t == "wbr":
            if t == "br" and now:
                now.append(" ")
            continue
        if dom.text[i] is None or dom.tag[p] in RAW or not keep[i]:
            continue
        if last is not None and last != block[i]:
            blocks.append("".join(now))
            now = []
        now.append(entities.unescape(dom.text[i]))
        last = block[i]
    blocks.append("".join(now))
    return "\n".join(b for b in (_SPACE.sub(" ", x).strip() for x in blocks) if b)


# -- labelled pages ---------------------------------------------------------------------------


#: Around every content run of a labelled page; private-use characters, cut out before features are taken.
OPEN, SHUT = "\ue000", "\ue001"


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages of many layouts with their content runs between OPEN and SHUT."""
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfghlmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(800)]

    def some(a, b):
        return " ".join(r.choice(words) for _ in range(r.randint(a, b)))

    def sentence(a=4, b=25):
        return some(a, b).capitalize() + r.choice([".", ".", ".", "?", "!"])

    def links(a, b):
        return "".join(f'<li><a href="/{r.choice(words)}">{some(1, 3)}</a></li>' for _ in range(r.randint(a, b)))

    def cls(*names):
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'

    def menu():
        inner = f"<ul>{links(3, 9)}</ul>"
        return r.choice([f"<nav>{inner}</nav>", f"<div{cls('menu', 'navbar', 'nav main-menu', 'breadcrumbs')}>{inner}</div>", f'<nav role="navigation">{inner}</nav>'])

    def head():
        return r.choice([f"<header><div{cls('logo', 'brand')}>{some(1, 3)}</div>{menu()}</header>", f"<div{cls('header', 'masthead', 'site-header')}><h1>{some(1, 3)}</h1><p>{some(3, 8)}</p></div>", f"<header><a href='/'>{some(1, 3)}</a></header>"])

    def ad():
        return r.choice([f"<div{cls('ad', 'ads', 'advert', 'sponsored', 'ad-banner', 'promo')}>{r.choice(['', '<p>'])}{sentence()}{r.choice(['', sentence()])}</div>", f"<aside{cls('ad', 'advertisement')}><a href='/x'>{some(2, 8)}</a></aside>", f"<ins{cls('ads', 'adslot')}>{sentence()}</ins>"])

    def notice():
        return f"<div{cls('cookie-notice', 'notice', 'consent', 'newsletter', 'alert', 'popup', 'gdpr-banner')}><p>{sentence()} {sentence()}</p><button>{some(1, 2)}</button></div>"

    def form():
        return f"<form action='/go'{r.choice(['', cls('search', 'login', 'signup')])}><label>{some(1, 3)}</label><input name='q'><select><option>{some(1, 1)}<option>{some(1, 1)}</select><button>{some(1, 2)}</button></form>"

    def side():
        return r.choice([f"<aside><h3>{some(1, 3)}</h3><ul>{links(3, 8)}</ul></aside>", f"<div{cls('sidebar', 'related', 'widget', 'side trending')}><h3>{some(1, 3)}</h3><p>{sentence()}</p><ul>{links(2, 6)}</ul></div>", f"<aside><p>{sentence()}</p><p>{sentence()}</p></aside>"])

    def comments():
        one = "".join(f"<div{cls('comment', 'reply')}>" + nested(f"<b>{some(1, 2)}</b><p>{sentence()} {sentence()}</p>") + "</div>" for _ in range(r.randint(1, 5)))
        return r.choice([f"<section{cls('comments', 'discussion', 'respond')}><h2>{some(1, 2)}</h2>{one}</section>", f"<div{cls('comments', 'comment-list')}><h3>{some(1, 2)}</h3><ol>{''.join(f'<li><p>{sentence()}</p></li>' for _ in range(r.randint(1, 5)))}</ol></div>"])

    def foot():
        inner = f"&copy; {r.choice(words)}.example &middot; {sentence()}"
        return r.choice([f"<footer>{inner}</footer>", f"<footer><p>{inner}</p><ul>{links(2, 6)}</ul></footer>", f"<div{cls('footer', 'site-footer', 'legal')}>{inner}</div>"])

    def mark(text):
        return f"{OPEN}{text}{SHUT}"

    def nested(part):
        """Now and then within plain boxes."""
        for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2, 3])):
            part = f"<div{r.choice(['', '', cls('wrap', 'inner', 'row', 'col', 'box')])}>{part}</div>"
        return part

    def para():
        body = mark(" ".join(sentence() for _ in range(r.randint(1, 9))))
        if r.random() < 0.25:
            body = f"{mark(sentence())} <{(t := r.choice(['b', 'i', 'em', 'strong', 'span']))}>{mark(some(1, 5))}</{t}> {body}"
        if r.random() < 0.2:
            body += f" <a href='/{r.choice(words)}'>{mark(some(1, 4))}</a> {mark(sentence())}"
        if r.random() < 0.1:
            body += f"<br>{mark(sentence())}"
        return r.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>" if r.random() < 0.3 else f"<p>{body}</p>"])

    def block():
        x = r.random()
        if x < 0.7:
            return para()
        if x < 0.78:
            return f"<h{(k := r.randint(2, 4))}>{mark(some(1, 7))}</h{k}>"
        if x < 0.86:
            return f"<ul>{''.join(f'<li>{mark(sentence(2, 14))}</li>' for _ in range(r.randint(2, 6)))}</ul>"
        if x < 0.91:
            return f"<blockquote>{r.choice(['', '<p>'])}{mark(sentence())}</blockquote>"
        if x < 0.95:
            rows = "".join(f"<tr><td>{mark(some(1, 4))}</td><td>{mark(some(1, 4))}</td></tr>" for _ in range(r.randint(2, 5)))
            return f"<table>{rows}</table>"
        if x < 0.97:
            return f"<pre><code>{mark(some(3, 12))}</code></pre>"
        return f"<figure><img src='x.png'><figcaption>{mark(some(3, 9))}</figcaption></figure>"

    out = []
    for _ in range(pages):
        inside = [f"<h1>{mark(some(1, 12))}</h1>"] * (r.random() < 0.85) + [block() for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20]))]
        for extra, chance in ((ad, 0.2), (side, 0.1), (notice, 0.08), (form, 0.08)):
            if r.random() < chance:
                inside.insert(r.randint(1, len(inside)) if inside else 0, nested(extra()))
        body = nested("".join(inside))
        body = r.choice([f"<article>{body}</article>", f"<article>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>", f"<div{cls('content', 'post', 'entry-content', 'article-body')}>{body}</div>", f'<div role="main">{body}</div>', f"<section{cls('post', 'story')}>{body}</section>"])
        before = [nested(f()) for f, c in ((head, 0.5), (menu, 0.8), (ad, 0.6), (notice, 0.3), (form, 0.2), (side, 0.2)) if r.random() < c]
        after = [nested(f()) for f, c in ((side, 0.35), (ad, 0.2), (comments, 0.4), (form, 0.2), (notice, 0.15), (foot, 0.9)) if r.random() < c]
        if r.random() < 0.3:
            r.shuffle(before)
        wrap = r.choice(["{}", "{}", "<div id='page'>{}</div>", "<div class='container'><div class='row'>{}</div></div>"])
        page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{some(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>' + wrap.format("".join(before) + ("<!-- ad 0 -->" * r.randint(0, 1)) + body + "".join(after)) + r.choice(["</body></html>", "</body></html>", ""])
        out.append(page)
    return out


def learn(pages: list[str] | None = None) -> Model:
    """Counts over labelled pages.  An element is content if most of the text under it is; one without text is left out."""
    pages = pages or labelled_pages()
    emit: dict[str, dict[str, np.ndarray]] = {}
    move: dict[str, np.ndarray] = {}
    root = np.ones(2)
    for page in pages:
        dom = parse(page)
        n = len(dom.tag)
        good, all_ = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if dom.text[i] is not None and dom.tag[dom.parent[i]] not in RAW:
                marked, dom.text[i] = OPEN in dom.text[i], dom.text[i].replace(OPEN, "").replace(SHUT, "")
                all_[i] = len(dom.text[i].strip())
                good[i] = all_[i] * marked
            if i:
                good[dom.parent[i]] += good[i]
                all_[dom.parent[i]] += all_[i]
        state = [None if not a else int(2 * g >= a) for g, a in zip(good, all_, strict=True)]
        seen, same = observe(dom)
        for i, features in enumerate(seen):
            if state[i] is None:
                if dom.tag[i] in RAW or dom.tag[dom.parent[i]] in RAW:
                    state[i] = 0
                else:
                    continue
            for name, value in features:
                emit.setdefault(name, {}).setdefault(value, np.ones(2))[state[i]] += 1
            if not i:
                root[state[i]] += 1
            elif state[dom.parent[i]] is not None and not same[i]:
                move.setdefault(relation(dom, i), np.ones((2, 2)))[state[dom.parent[i]], state[i]] += 1
    for values in emit.values():
        total = sum(values.values())
        for v in values:
            values[v] = np.log(values[v] / total)
    return Model(emit, {k: np.log(v / v.sum(axis=1, keepdims=True)) for k, v in move.items()}, np.log(root / root.sum()))


def extract_pages(pages: DataFrame, model: Model, html_col: str = "html", threshold: float = CONTENT) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, in one pass without a shuffle."""
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for batch, some in parts(batches, "html", 64):
            found = [extract(x, shipped.value, threshold) for x in some]
            out = pa.schema([batch.schema.field(0), batch.schema.field(1), ("text", pa.string()), ("n_chars", pa.int64())])
            yield arrow_batch(out, [batch.column(0), batch.column(1), found, [len(x) for x in found]])

    picked = pages.select("page_id", "url", F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op1_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), learn())
