"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding (operator 1).

A page becomes a tree of its block-level elements; inline markup belongs to the block around it. The
scanner reads a page once: its work grows with the page's length alone, however it is nested or cut
off. Boosted trees give each node a probability of being main text, from the density of its subtree,
its tag, what the words of its class and id say, its depth, its siblings and the same of its
ancestors. Words of attributes are hashed, and what each slot says is learned; words that weren't met
say nothing, and the rest decides. Decoding works up the tree: a node's subtree is wholly in, wholly
out, or open, when its children decide and a price is paid; so nothing below a node that is out can
be in. A page that would keep nothing keeps what is as likely as its likeliest block, if that isn't
unlikely. The model is fitted on pages built from random parts whose role is known by construction
(see training_page), with class names of several languages, made-up ones and none; nothing is learned
from the rows that are extracted.

Defined cases: null, empty or text-free html gives an empty text; broken nesting, unclosed tags and
raw '<' are read as far as they go; nesting of any depth and pages of any length are read whole;
repeated rows give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import table

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>|[^>]*+>)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+")

# fixed values: names of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mtable mtr mtd semantics annotation".split())
#: What isn't text of the page; left open, browsers read the first ones up to the page's end, the others are then nodes like any other.
TO_END = frozenset("script style title textarea iframe xmp noembed noframes".split())
RAW = TO_END | frozenset("template svg select".split())
VOID = frozenset("area base col embed hr input link meta param source track img br wbr keygen".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"), "option": ("option", "datalist")}
SAME = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SAME.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Slots that the words of class, id and role are hashed into; what each says about main text is learned.
SLOTS = 1 << 14
TAGS = ["article main", "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "table tr td th tbody thead tfoot caption", "div", "section", "aside", "nav", "header", "footer", "form fieldset button input legend datalist dialog", "blockquote pre figure figcaption address details summary", "body html"]
TAG_OF = {t: i for i, ts in enumerate(TAGS) for t in ts.split()}


class Page:
    """tags, parents, names (slots of the attributes' words), hidden; blocks: (node, text, share of it in links). Parents come before children."""

    def __init__(self, html: str):
        self.tags, self.parents, self.names, self.hidden = ["html"], [-1], [()], [False]
        self.blocks: list[tuple[int, str, float]] = []
        self._parse(html)

    def _flush(self, node: int, buf: list[str], linked: int) -> None:
        if buf:
            if text := " ".join("".join(buf).split()):
                self.blocks.append((node, text, min(1.0, linked / max(1, sum(map(len, buf))))))
            buf.clear()

    def _attributes(self, raw: str) -> tuple[tuple[int, ...], bool]:
        slots, hidden = [], False
        for name, a, b, c in ATTRIBUTE.findall(raw):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "itemprop", "data-role", "aria-label"):
                slots += [zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % SLOTS for w in PARTS.findall(value)]
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value == "true":
                hidden = True
        return tuple(slots), hidden

    def _parse(self, html: str) -> None:
        stack, buf, at, linked, links, unclosed = [0], [], 0, 0, 0, set()
        tags = self.tags
        places: dict[str, list[int]] = defaultdict(list)  # of each open tag its places on the stack
        last = html.rfind(">") + 1  # past it there is no tag

        def text(s: str) -> None:
            nonlocal linked
            s = unescape(s) if "&" in s else s
            buf.append(s)
            if links:
                linked += len(s)

        def cut(i: int) -> None:
            for k in stack[i:]:
                places[tags[k]].pop()
            del stack[i:]

        def top(names) -> int:
            return max([places[x][-1] for x in names if places.get(x)], default=0)

        def close(names, stops) -> None:
            if (i := top(names)) > top(stops):
                cut(i)

        while True:
            m = TOKEN.search(html, at, last)
            if m is None:
                text(html[at:])
                break
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:].removesuffix("]]>"))
                if at == last and m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "--!>", "]]>")):
                    at = len(html)  # left open
                continue
            tag, end = m[2].lower(), bool(m[1])
            if tag in INLINE:
                if tag == "a":
                    links = 0 if end else 1
                elif tag == "br":
                    buf.append(" ")
                continue
            if tag in RAW and tag not in unclosed:
                if end or m[3].rstrip(">").endswith("/"):
                    continue
                over = _end_of(tag).search(html, at, last)
                if over or tag in TO_END:
                    at = over.end() if over else len(html)
                    continue
                unclosed.add(tag)  # no end tag follows
            self._flush(stack[-1], buf, linked)
            linked = 0
            if end:
                if places.get(tag):
                    cut(places[tag][-1])
                if tag in ("article", "div", "section", "p", "li", "td"):
                    links = 0
                continue
            if tag in ("html", "body", "head"):
                if tag == "body":
                    cut(1)
                if tag != "body":
                    continue
            if tag in CLOSE_P:
                close(("p",), ("table", "td", "th", "button"))
            if tag in HEADINGS and tags[stack[-1]] in HEADINGS:
                cut(len(stack) - 1)
            if tag in SAME:
                close(*SAME[tag])
            if tag in VOID:
                continue
            names, hidden = self._attributes(m[3]) if "=" in m[3] or "hidden" in m[3] else ((), False)
            tags.append(tag)
            self.parents.append(stack[-1])
            self.names.append(names)
            self.hidden.append(hidden)
            if not m[3].endswith("/>"):
                places[tag].append(len(stack))
                stack.append(len(tags) - 1)
        self._flush(stack[-1], buf, linked)


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9])[^>]*>", re.I)


def features(page: Page, weights: np.ndarray) -> np.ndarray:
    n = len(page.tags)
    parent = np.array(page.parents)
    own, words, linkw, marks, blocks, first = (np.zeros(n) for _ in range(6))
    where, seen = np.zeros(n), 0
    copy = np.zeros(n)
    for k, t, share in page.blocks:
        w = t.count(" ") + 1
        own[k] += w
        linkw[k] += share * w
        marks[k] += t.count(",") + t.count(".") + t.count("!") + t.count("?")
        blocks[k] += 1
        copy[k] += "©" in t or "(c)" in t[:40].lower()
        if not first[k]:
            first[k], where[k] = 1, seen
        seen += w
    words, nodes, paras, depth = own.copy(), np.ones(n), np.zeros(n), np.zeros(n)
    tag = np.array([TAG_OF.get(t, 6) for t in page.tags])
    paras[tag == 1] = 1
    named = np.array([sum(weights[k] for k in x) if x else 0.0 for x in page.names]).clip(-6, 6)
    total_link, total_marks, total_blocks, size = linkw.copy(), marks.copy(), blocks.copy(), np.zeros(n)
    worst, finest = np.minimum(named, 0), np.maximum(named, 0)
    place, same, order = np.zeros(n), np.zeros(n), np.where(first > 0, where, np.inf)
    up_worst, up_finest, up_tags = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        words[p] += words[i]
        nodes[p] += nodes[i]
        paras[p] += paras[i]
        total_link[p] += total_link[i]
        total_marks[p] += total_marks[i]
        total_blocks[p] += total_blocks[i]
        worst[p], finest[p] = min(worst[p], worst[i]), max(finest[p], finest[i])
        size[p] += 1
        order[p] = min(order[p], order[i])
    kids: dict[tuple[int, int], int] = {}
    nth = np.zeros(n)
    hidden = np.array(page.hidden)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        nth[p] += 1
        place[i] = nth[p] / size[p]
        key = (p, tag[i])
        kids[key] = kids.get(key, 0) + 1
        up_worst[i], up_finest[i] = min(up_worst[p], named[p]), max(up_finest[p], named[p])
        up_tags[i] = up_tags[p] | 1 << int(tag[p])
        hidden[i] |= hidden[p]
    for i in range(1, n):
        same[i] = kids[parent[i], tag[i]] / size[parent[i]]
    par = np.maximum(parent, 0)
    w1 = np.maximum(words, 1)
    cols = [
        np.minimum(depth, 30), np.log1p(words), np.log1p(own), total_link / w1, np.log1p(nodes), words / nodes, np.log1p(paras), total_marks / w1,
        words / np.maximum(total_blocks, 1), np.log1p(size[par]), place, same, words / max(1, words[0]), words / np.maximum(words[par], 1),
        (total_link / w1)[par], np.log1p(words[par]), np.where(np.isfinite(order), order / max(1, seen), 1), hidden.astype(float), np.full(n, float(0 in tag)), copy,
    ]
    cols += [(tag == k).astype(float) for k in range(len(TAGS))]
    cols += [(up_tags >> k & 1).astype(float) for k in (0, 3, 4, 5, 8, 9, 10, 11, 12)]
    cols += [named, up_worst, up_finest, worst, finest, np.array([min(len(x), 3) for x in page.names], float)]
    return np.stack(cols, axis=1)


def decode(page: Page, margin: np.ndarray, price: float = 1.0) -> list[bool]:
    """For each node, whether text right in it is main text."""
    n = len(page.tags)
    own = np.zeros(n)
    for k, t, _ in page.blocks:
        own[k] += 1 + np.log1p(t.count(" "))
    odds = np.clip(margin, -8, 8) * (own + 0.25)
    inside, best = odds.copy(), np.zeros(n)  # against wholly out, which scores 0
    split = np.where(own > 0, np.maximum(odds, 0), 0.0) - price
    choice = [0] * n
    for i in range(n - 1, -1, -1):
        options = (0.0, inside[i], split[i])
        choice[i] = max(range(3), key=options.__getitem__)
        best[i] = options[choice[i]]
        if i:
            inside[page.parents[i]] += inside[i]
            split[page.parents[i]] += best[i]
    state, keep = [2] * n, [False] * n
    for i in range(n):
        up = state[page.parents[i]] if i else 2
        state[i] = choice[i] if up == 2 else up
        keep[i] = state[i] == 1 or state[i] == 2 and odds[i] > 0
    return keep


# ---- training pages ----

SYLLABLES = "an ber cor del en fi ga hul il jo ka lem mi nor os pra qui rat so tu um vel wan xi yo zed".split()


@functools.cache
def _pool(seed: int = 5) -> list[str]:
    r = np.random.default_rng(seed)
    return ["".join(SYLLABLES[i] for i in r.integers(0, len(SYLLABLES), n)) for n in r.integers(1, 4, 3000)]


def _words(r: np.random.Generator, n: int) -> str:
    pool = _pool()
    out = [pool[i] for i in r.integers(0, len(pool), n).tolist()]
    for i in np.flatnonzero(r.random(n) < 0.12).tolist():
        out[i] += ",.."[i % 3]
    return " ".join(out).capitalize() + "." * int(r.random() < 0.6)


#: Class names as sites of several languages use them, for the training pages alone.
NAMES = {
    "menu": "nav navbar menu main-nav breadcrumb breadcrumbs navigation top-menu toc tabs pagination sitemap hauptmenue menue navigationsleiste navigation-principale fil-ariane menu-principal migas navegacion navigazione navegacao kruimelpad meny",
    "advert": "ad ads advert adverts ad-slot sponsored sponsor promo promotion banner-ad advertisement advertising commercial werbung anzeige reklame publicite pub annonce publicidad anuncio pubblicita propaganda advertentie reklam",
    "notice": "cookie-notice cookie-banner cookies consent notice alert gdpr privacy-notice popup modal overlay disclaimer paywall hinweis datenschutz einwilligung avis avertissement aviso privacidad avviso informativa melding",
    "side": "sidebar side aside related widget widgets recommended more-stories trending popular teaser rail seitenleiste randspalte verwandt empfehlungen barre-laterale encadre lateral barra-lateral relacionados correlati zijbalk",
    "form": "newsletter subscribe search-form search login signup contact-form register anmeldung suche suchformular formulaire recherche inscription connexion formulario busqueda suscripcion ricerca iscrizione zoeken",
    "comments": "comments comment comment-list comment-body discussion responses replies reply reader-comments comments-area user-comment disqus kommentare kommentar leserkommentare diskussion commentaires commentaire comentarios comentario commenti commento reacties kommentarer",
    "top": "header site-header masthead page-header top-bar branding logo kopfzeile kopf seitenkopf entete en-tete cabecera encabezado testata intestazione koptekst",
    "foot": "footer site-footer page-footer copyright bottom colophon imprint legal fusszeile fuss impressum pied-de-page mentions-legales pie pie-de-pagina rodape piede voettekst",
    "share": "share social share-buttons sharing tags meta post-meta byline author follow teilen autor partager auteur compartir etiquetas condividi autore delen",
    "main": "content main post entry-content article article-body story text post-body main-content prose inhalt artikel beitrag haupttext contenu corps-article texte contenido articulo cuerpo contenuto articolo conteudo artigo inhoud",
    "part": "lead intro review quote note summary first big chapter figure body zitat einleitung absatz citation resume nota resumen capitolo",
}


def training_page(r: np.random.Generator) -> str:
    """Random html; main text carries the mark \x01 in each of its blocks. On some pages all names are made up, on some there are none."""
    pick = lambda *x: x[r.integers(len(x))]
    link = lambda: f'<a href="/x">{_words(r, int(r.integers(1, 5)))}</a>'
    para = lambda lo=1, hi=80: _words(r, int(np.exp(r.uniform(np.log(lo), np.log(hi)))))
    how_named, made_up = r.random(), {}

    def name(role):
        if how_named < 0.35:
            if role not in made_up or r.random() < 0.3:
                made_up[role] = pick("c", "x", "js-", "") + "".join(pick(*SYLLABLES) for _ in range(3)) + str(r.integers(100))
            return made_up[role]
        return pick(*NAMES[role].split())

    def box(tag_names, role, inner, plain=0.2):
        tag = pick(*tag_names.split())
        named = (r.random() > plain or tag in ("div", "section", "p")) and how_named < 0.93
        attribute = f' {pick("class", "class", "id")}="{name(role)}{pick("", "", " " + pick("row", "box", "col", "block"))}"' if named else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def menu():
        items = "".join(f"<li>{link()}</li>" for _ in range(r.integers(2, 12)))
        return box("nav nav div ul", "menu", pick(f"<ul>{items}</ul>", items, " | ".join(link() for _ in range(5))))

    def advert():
        return box("div div aside section p ins", "advert", pick(para(2, 50), f"<p>{para(2, 50)}</p>", f"<p>{para(2, 25)}</p>{link()}"), 0.0)

    def notice():
        return box("div div section aside", "notice", pick(f"<p>{para(4, 50)}</p><button>{_words(r, 2)}</button>", para(4, 40)), 0.0)

    def side():
        items = "".join(pick(f"<li>{link()}</li>", f"<p>{para(2, 30)}</p>") for _ in range(r.integers(1, 8)))
        return box("aside aside div section", "side", f"<h3>{_words(r, 3)}</h3>" * int(r.random() < 0.6) + items, 0.3)

    def form():
        return box("form form div", "form", f"<label>{_words(r, 3)}</label><input type=text><button>{_words(r, 1)}</button>" + f"<p>{para(3, 20)}</p>" * int(r.random() < 0.5))

    def comments():
        one = lambda: box("div li article p section", "comments", pick(para(2, 60), f"<p>{para(2, 60)}</p>", f"<h4>{_words(r, 2)}</h4><p>{para(2, 60)}</p><p>{para(2, 30)}</p>"), 0.1)
        return box("section div div ol ul", "comments", f"<h3>{_words(r, 2)}</h3>" * int(r.random() < 0.6) + "".join(one() for _ in range(r.integers(1, 8))), 0.0)

    def top():
        return box("header header div", "top", pick(f"<h1>{_words(r, 3)}</h1>", f"<h2>{_words(r, 2)}</h2><p>{para(2, 12)}</p>", f"<p>{para(2, 12)}</p>", link()) + menu() * int(r.random() < 0.4))

    def foot():
        return box("footer footer div", "foot", pick(f"&copy; {para(2, 25)}", f"<p>&copy; {para(2, 25)}</p>", f"<p>{para(3, 30)}</p>" + link()))

    def share():
        return box("div ul div", "share", " ".join(link() for _ in range(r.integers(2, 5))), 0.0)

    def body():
        out, broken = [], r.random() < 0.35
        out.append(pick(f"<h1>\x01{_words(r, int(r.integers(2, 12)))}</h1>", f"<header><h1>\x01{_words(r, 6)}</h1></header>", f"<h1>\x01{_words(r, 6)}</h1><h2>\x01{_words(r, 6)}</h2>", ""))
        for _ in range(int(np.exp(r.uniform(0, np.log(25)))) if r.random() < 0.75 else int(r.integers(1, 3))):
            text = para(1, 120)
            x = r.random()
            if x < 0.04:
                out.append(box("p p div blockquote", "part", f"\x01{text}", 0.0))
            elif x < 0.72:
                out.append(pick(f"<p>\x01{text}</p>", f"<p>\x01{text}</p>", f"<p>\x01{text} {link()} {para(1, 20)}</p>") if not broken or r.random() < 0.6 else pick(f"<p>\x01{text}", f"<p><b>\x01{text}<br>"))
            elif x < 0.78:
                out.append(f"<h2>\x01{_words(r, 4)}</h2>")
            elif x < 0.84:
                out.append("<ul>" + "".join(f"<li>\x01{para(1, 20)}</li>" for _ in range(r.integers(2, 7))) + "</ul>")
            elif x < 0.89:
                out.append(pick(f"<blockquote><p>\x01{text}</p></blockquote>", f"<blockquote>\x01{text}</blockquote>", f"<pre>\x01{text}</pre>", f"<figure><img src=x><figcaption>\x01{para(2, 12)}</figcaption></figure>"))
            elif x < 0.92:
                out.append("<table>" + "".join(f"<tr><td>\x01{para(1, 6)}</td><td>\x01{para(1, 6)}</td></tr>" for _ in range(r.integers(2, 5))) + "</table>")
            elif x < 0.95:
                out.append(f"<div>\x01{text}</div>")
            else:
                out.append(pick(advert, share, side, form, notice)())
        return "".join(out)

    inner = body()
    if r.random() < 0.3:
        inner += pick(comments, share, form, side, foot)()
    elif r.random() < 0.1:
        inner += f"<footer>{pick(share(), f'<p>{para(1, 12)}</p>', f'<p>{para(1, 5)} {link()}</p>')}</footer>"
    x = r.random()
    if x < 0.5:
        art = pick(f"<article>{inner}</article>", box("article", "main", inner, 0.0), f"<main><article>{inner}</article></main>")
    elif x < 0.65:
        art = pick(f"<main>{inner}</main>", box("main", "main", inner, 0.0))
    elif x < 0.92:
        art = box("div div div section", "main", inner, 0.0)
    else:
        art = pick(inner, f"<div>{inner}</div>", f"<section>{inner}</section>")
    before = [f() for f in (top, menu, notice, advert, form) if r.random() < 0.45]
    after = [f() for f in (comments, side, advert, foot, notice, form, menu) if r.random() < 0.4]
    mid = art + "".join(after[:2])
    if r.random() < 0.4:
        mid = f'<div class="{pick("wrapper", "container", "page", "row", "layout")}">{pick("", side() if r.random() < 0.5 else "")}{mid}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(r, 5)}</title><style>p{{}}</style></head><body>{''.join(before)}{mid}{''.join(after[2:])}</body></html>"


def learn_names(pages: list[tuple[Page, np.ndarray]]) -> np.ndarray:
    """Of each slot the log odds that a node with one of its names is mostly main text; slots seen on under five pages say nothing."""
    seen = np.zeros((2, SLOTS))
    for page, share in pages:
        met = {(k, share[i] > 0.5) for i, names in enumerate(page.names) for k in names if share[i] >= 0}
        for k, good in met:
            seen[int(good), k] += 1
    odds = np.log((seen[1] + 0.5) / (seen[0] + 0.5)).clip(-3, 3)
    return np.where(seen.sum(axis=0) >= 5, odds, 0.0)


class Model:
    def __init__(self, weights: np.ndarray, trees: gbt.Trees):
        self.weights, self.trees = weights, trees


@functools.cache
def model(pages: int = 2400, seed: int = 7) -> Model:
    """The fitted trees; the number of training pages bounds the work, whatever the input. Names are learned on one half
    of the pages and the trees on the other, so that the trees don't trust names more than they hold."""
    r, known = np.random.default_rng(seed), []
    for _ in range(pages):
        p = Page(training_page(r))
        good, all_ = np.zeros(len(p.tags)), np.zeros(len(p.tags))
        blocks = []
        for k, t, share in p.blocks:
            w = t.count(" ") + 1
            good[k] += w * ("\x01" in t)
            all_[k] += w
            blocks.append((k, t.replace("\x01", ""), share))
        p.blocks = blocks
        for i in range(len(p.tags) - 1, 0, -1):
            good[p.parents[i]] += good[i]
            all_[p.parents[i]] += all_[i]
        known.append((p, np.where(all_ > 0, good / np.maximum(all_, 1), -1)))
    weights = learn_names(known[: pages // 2])
    xs, ys, ws = [], [], []
    for p, share in known[pages // 2 :]:
        use = share >= 0
        xs.append(features(p, weights)[use])
        ys.append(share[use] > 0.5)
        ws.append(0.05 + np.abs(2 * share[use] - 1))
    return Model(weights, gbt.fit(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws), trees=70, depth=5))


def kept(page: Page, margin: np.ndarray, least: float = -2.0) -> list[str]:
    """The blocks of main text. Where none is, though the likeliest block's margin is above `least`, what is as likely as that one."""
    keep = decode(page, margin)
    out = [t for k, t, _ in page.blocks if keep[k]]
    if not out:
        best = max(margin[k] for k, _, _ in page.blocks)
        if best > least:
            keep = decode(page, margin - best + 2.0)
            out = [t for k, t, _ in page.blocks if keep[k]]
    return out


def extract(html: str | None, fitted: Model) -> str:
    page = Page(html or "")
    return "\n".join(kept(page, fitted.trees.margin(features(page, fitted.weights)))) if page.blocks else ""


def _run(fitted: Model, most_nodes: int = 50_000):
    def run(it):
        for b in it:
            texts, waiting, nodes = [""] * b.num_rows, [], 0

            def flush():
                nonlocal waiting, nodes
                if waiting:
                    margins, at = fitted.trees.margin(np.concatenate([features(p, fitted.weights) for _, p in waiting])), 0
                    for i, p in waiting:
                        texts[i] = "\n".join(kept(p, margins[at : at + len(p.tags)]))
                        at += len(p.tags)
                waiting, nodes = [], 0

            for i, x in enumerate(b.column(2)):
                p = Page(x.as_py() or "")
                if p.blocks:
                    waiting.append((i, p))
                    nodes += len(p.tags)
                if nodes >= most_nodes:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row."""
    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cols.mapInArrow(_run(model()), "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
