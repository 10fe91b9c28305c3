"""Main text of web pages: a bidirectional LSTM in numpy reads a page's leaf blocks in order, each
as a vector of its tag path and of its hashed words, and labels every block.

The model is fitted on the driver on pages that `training_page` makes from a seed (TRAIN_PAGES of
them, whatever the input), and sent to the tasks.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut
from ._text import words

TRAIN_PAGES, HIDDEN, EPOCHS = 1_600, 24, 5

# fixed values: HTML's elements
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")

_KNOWN = {t: i for i, t in enumerate(sorted(BLOCK | {"a", "b", "span", "em", "strong", "i", "u", "small", "code", "font"}))}
TAGS, NAMES, WORDS, MORE = len(_KNOWN) + 8, 256, 96, 6
MARKS = 2 * TAGS + NAMES
WIDTH = MARKS + WORDS + MORE


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


@lru_cache(100_000)
def _name_bits(names: str) -> int:
    bits = 0
    for w in _PART.findall(names):
        bits |= 1 << _bucket(w, NAMES)
    return bits


class Path:
    """An open element, linked to the one around it: however deep the nesting, an element takes the same
    room. tags and names are sets of buckets, as bits, of this element and all above."""

    __slots__ = ("tag", "up", "bit", "tags", "names")

    def __init__(self, tag: str, names: str, up: Path | None):
        self.tag, self.up = tag, up
        self.bit = 1 << (_KNOWN[tag] if tag in _KNOWN else TAGS - 1 - _bucket(tag, 8))
        self.tags, self.names = self.bit | (up.tags if up else 0), _name_bits(names) | (up.names if up else 0)

    def __iter__(self) -> Iterator[str]:
        """The names of the elements, innermost first."""
        at: Path | None = self
        while at:
            yield at.tag
            at = at.up

    def marks(self) -> int:
        """Bits: tags of the two innermost elements, all tags above, and the words of the names."""
        up = self.up
        far = up.up.tags if up and up.up else 0
        return self.bit | (up.bit if up else 0) | far << TAGS | self.names << 2 * TAGS


def leaf_blocks(page: str) -> list[tuple[Path | None, str, float]]:
    """(path, text, share of the text inside links) of each block that holds text.

    Scripts and styles that are not closed run to the end of the page, as in browsers; of other
    elements whose content is not text only those that are closed go, with what they hold."""
    out: list[tuple[Path | None, str, float]] = []
    stack: list[Path] = []
    is_open: Counter = Counter()
    linked = 0
    parts: list[str] = []
    never_closed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1] if stack else None, text, min(1.0, linked / len(text))))
            parts.clear()
            linked = 0

    def close(at: int) -> None:
        if any(s.tag in BLOCK for s in stack[at:]):
            flush()
        is_open.subtract(s.tag for s in stack[at:])
        del stack[at:]

    def text(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if is_open["a"] > 0:
                linked += len(s)

    last = 0
    while m := _TOKEN.search(page, last):
        if m.start() > last:
            text(page[last : m.start()])
        last = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if is_open[name] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == name))
            elif name in BLOCK:
                flush()
            continue
        if name in _END:
            if name in never_closed or name not in ("script", "style", "title", "textarea") and m[3].endswith("/"):
                continue
            end = _END[name].search(page, last)
            if end:
                last = end.end()
            elif name in ("script", "style"):
                last = len(page)
            else:
                never_closed.add(name)
            continue
        if name in BLOCK:
            flush()
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p" or stack[i].tag in BLOCK), None)
            if at is not None and stack[at].tag == "p":
                close(at)
            if name in CLOSES and any(is_open[c] > 0 for c in CLOSES[name]):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in KEEPS[name]:
                        break
                    if stack[i].tag in CLOSES[name]:
                        close(i)
                        break
        if name == "br":
            parts.append(" ")
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        names = " ".join(next(filter(None, x), "") for x in _NAMES.findall(m[3])).lower() if m[3] else ""
        stack.append(Path(name, names, stack[-1] if stack else None))
        is_open[name] += 1
    text(page[last:])
    flush()
    return out


def features(blocks: list[tuple[Path | None, str, float]]) -> np.ndarray:
    x = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return x
    size = -(-MARKS // 8)
    marks = np.frombuffer(b"".join((p.marks() if p else 0).to_bytes(size, "little") for p, _, _ in blocks), np.uint8).reshape(-1, size)
    x[:, :MARKS] = np.unpackbits(marks, axis=1, count=MARKS, bitorder="little")
    h, _, length, at = words(pa.array([t for _, t, _ in blocks], pa.string()))
    n = np.diff(at)
    block = np.repeat(np.arange(len(blocks)), n)
    counts = np.bincount(block * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    x[:, MARKS:-MORE] = np.minimum(counts / np.sqrt(np.maximum(n, 1))[:, None] * 0.5, 1)  # also for one word without end
    chars = np.array([len(t) for _, t, _ in blocks])
    x[:, -6] = np.log1p(chars) / 6
    x[:, -5] = [s for _, _, s in blocks]
    x[:, -4] = np.log1p(n) / 5
    x[:, -3] = [t[-1:] in ".!?:;\"'»”" for _, t, _ in blocks]
    x[:, -2] = ["©" in t for _, t, _ in blocks]
    x[:, -1] = 1
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool, state: tuple | None = None) -> tuple[np.ndarray, list]:
    """One direction over (time, pages, features); masked steps pass the state on. The state at the
    end comes last in the list."""
    steps, n, _ = x.shape
    h, c = state or (np.zeros((n, HIDDEN), np.float32),) * 2
    out, held = np.zeros((steps, n, HIDDEN), np.float32), []
    z = (x.reshape(-1, x.shape[2]) @ w).reshape(steps, n, -1)
    for t in range(steps):
        g = z[t] + h @ u
        i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        a = np.tanh(g[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = np.where(m, f * c + i * a, c)
        tc = np.tanh(new)
        hn = np.where(m, o * tc, h)
        if keep:
            held.append((h, c, i, f, o, a, tc, m))
        h, c = hn, new
        out[t] = h
    return out, [*held, (h, c)]


def _back(x: np.ndarray, u: np.ndarray, held: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of w and u for gradients dout of the outputs."""
    held = held[:-1]
    dz = np.zeros((len(held), x.shape[1], 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh = dc = np.zeros_like(held[0][0])
    for t in range(len(held) - 1, -1, -1):
        h, c, i, f, o, a, tc, m = held[t]
        dh = dh + dout[t]
        d = np.where(m, dh * o * (1 - tc * tc) + dc, 0)
        g = np.concatenate((d * a * i * (1 - i), d * c * f * (1 - f), np.where(m, dh * tc, 0) * o * (1 - o), d * i * (1 - a * a)), 1)
        dz[t] = g
        du += h.T @ g
        dh = np.where(m, 0, dh) + g @ u.T
        dc = np.where(m, d * f, dc)
    return x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * HIDDEN), du


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def _scores(model: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    a, held_a = _run(x, mask, model["w0"], model["u0"], keep)
    b, held_b = _run(x[::-1], mask[::-1], model["w1"], model["u1"], keep)
    both = np.concatenate((a, b[::-1], x), 2)
    return both @ model["v"], both, held_a, held_b


def label(model: dict, pages: list[np.ndarray], most: int = 16_384) -> list[np.ndarray]:
    """For each page whether each block is main text. Pages of like length run side by side."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    while order:
        longest = len(pages[order[-1]])
        own = order[-max(1, most // longest) :]
        del order[-len(own) :]
        s = _scores(model, *_batch([pages[i] for i in own]))[0]
        for k, i in enumerate(own):
            out[i] = s[: len(pages[i]), k] > 0
    return out


def label_long(model: dict, blocks: list, most: int = 16_384) -> np.ndarray:
    """The same for one page of any length: a slice of blocks at a time in each direction, the state
    passed on, so that memory holds a slice's features and a number a block."""
    total = np.zeros(len(blocks), np.float32)
    v, state = model["v"], None
    for s in range(0, len(blocks), most):
        x = features(blocks[s : s + most])[:, None]
        out, (state,) = _run(x, np.ones(x.shape[:2], bool), model["w0"], model["u0"], False, state)
        total[s : s + most] = out[:, 0] @ v[:HIDDEN] + x[:, 0] @ v[2 * HIDDEN :]
    state = None
    for s in range((len(blocks) - 1) // most * most, -1, -most):
        x = features(blocks[s : s + most])[::-1, None]
        out, (state,) = _run(x, np.ones(x.shape[:2], bool), model["w1"], model["u1"], False, state)
        total[s : s + most] += (out[:, 0] @ v[HIDDEN : 2 * HIDDEN])[::-1]
    return total > 0


def main_blocks(model: dict, pages: list[list], most: int = 16_384) -> list[np.ndarray]:
    """For each page whether each of its blocks is main text; of at most about so many blocks at once."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(pages):
        if len(pages[at]) > most:
            out.append(label_long(model, pages[at], most))
            at += 1
            continue
        end, n = at, 0
        while end < len(pages) and n + len(pages[end]) <= most:
            n += len(pages[end])
            end += 1
        out += label(model, [features(p) for p in pages[at:end]])
        at = end
    return out


# words that make up training pages: frequent ones of prose in four languages, and those of what is
# around it
_PROSE = (
    "the of and to in a is that for it was on as with his by at from they be this have are not had but which one or were when their there been more has who will would about into than its other time after only some could these two may then first any new work"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde"
    " le de un à être et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre on mais nous comme ou si leur y dire elle devoir avant deux même prendre aussi celui donner bien où fois vous"
    " el la que los se las por con una su para como más pero sus este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene"
).split()
_AROUND = {
    "menu": "home news about contact sitemap login register account products services blog archive start impressum kontakt accueil inicio contacto next previous back top help support shop cart".split(),
    "notice": "cookies cookie accept consent privacy policy browser settings improve experience agree partners newsletter subscribe email inbox unsubscribe offers akzeptieren datenschutz accepter confidentialité aceptar privacidad continue site use".split(),
    "advert": "buy now sale discount offer free shipping sponsored advertisement limited deal order today save price win click here best exclusive anzeige jetzt kaufen publicité oferta premium trial".split(),
    "comments": "comment reply replies says wrote posted ago thanks great article agree disagree lol commenter répondre antworten kommentar comentario responder user guest like report share anonymous".split(),
    "footer": "copyright rights reserved terms conditions privacy imprint legal reserved inc ltd gmbh powered theme sitemap contact cookies rechte vorbehalten tous droits réservés derechos reservados".split(),
    "side": "related popular recent posts tags categories archives author follow share twitter facebook read more also trending most viewed recommended similar stories weitere lire aussi".split(),
    "form": "search name email password message send submit enter your username remember forgot sign in required field suche absenden rechercher envoyer buscar enviar type word".split(),
}


def training_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made-up page and the texts of its main blocks, in order."""
    letters = "aaabcdeeefghiiklmnooprrsttuvéüñ"
    r = random.Random(int(rng.integers(1 << 62)))

    around: list[str] = [""]
    share = r.random() * 0.8  # how many words of this page are real ones: some pages have hardly any

    def word() -> str:
        return "".join(r.choices(letters, k=r.randrange(1, 11)))

    def token() -> str:
        if r.random() >= share:
            return word()
        common = _AROUND.get(around[-1], _PROSE) if r.random() < 0.5 else _PROSE
        return r.choice(common)

    def phrase(lo: int, hi: int) -> str:
        return " ".join(token() for _ in range(r.randrange(lo, hi))).capitalize()

    def prose() -> str:
        return " ".join(phrase(1, 14) + "." for _ in range(r.randrange(1, 7)))

    def within(kind: str):
        """A maker of boxes that hold words of their kind."""

        def wrap(f):
            def made() -> str:
                around.append(kind)
                text = f()
                around.pop()
                return text

            return made

        return wrap

    def pick(*x: str) -> str:
        return r.choice(x)

    def attr(*names: str) -> str:
        if r.random() < 0.03:
            return f' class="{word()}"'
        second = f' {pick("id", "class")}="{pick(word(), pick(*names) + "-" + str(r.randrange(99)))}"' if r.random() < 0.2 else ""
        return f' {pick("class", "id", "class")}="{pick(*names)}{pick("", "", "-" + word(), " " + word())}"{second}'

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    @within("menu")
    def nav() -> str:
        items = "".join(f"<li>{link(phrase(1, 3))}</li>" for _ in range(r.randrange(2, 9)))
        return pick(f"<nav><ul>{items}</ul></nav>", f"<ul{attr('menu', 'nav', 'navbar', 'navigation', 'links', 'topnav')}>{items}</ul>", f"<div{attr('menu', 'nav', 'breadcrumb', 'breadcrumbs', 'tabs')}>{' '.join(link(phrase(1, 3)) for _ in range(5))}</div>")

    @within("advert")
    def advert() -> str:
        return f"<{(t := pick('div', 'div', 'aside', 'section', 'p'))}{attr('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsored', 'promo', 'adsense', 'sponsor')}>{pick(phrase(2, 12) + '.', prose())}</{t}>"

    @within("notice")
    def notice() -> str:
        return f"<div{attr('cookie', 'cookie-notice', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal', 'newsletter', 'subscribe', 'privacy')}><p>{pick('We use cookies. ', 'Subscribe to our newsletter. ', 'Please accept. ', '')}{prose()}</p>{pick('', '<button>OK</button>', '<button>Accept all</button>')}</div>"

    @within("form")
    def form() -> str:
        return f"<form{pick('', attr('search', 'login', 'contact', 'signup'))}><label>{phrase(1, 4)}</label><input name=q><p>{prose()}</p><button>{pick('Search', 'Send', 'Sign in', 'Submit', phrase(1, 3))}</button></form>"

    @within("side")
    def side() -> str:
        inner = f"<h3>{pick('Related', 'Popular', 'Recent posts', 'About', phrase(1, 4))}</h3>" + pick(f"<ul>{''.join(f'<li>{link(phrase(2, 8))}</li>' for _ in range(4))}</ul>", f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{link(phrase(1, 5))}</p>")
        return pick(f"<aside>{inner}</aside>", f"<aside{attr('sidebar', 'widget')}>{inner}</aside>", f"<div{attr('sidebar', 'side', 'related', 'widget', 'widgets', 'recommended', 'popular', 'share', 'social', 'tags', 'author-bio')}>{inner}</div>")

    @within("comments")
    def comments() -> str:
        one = lambda: pick(f"<li{attr('comment', 'reply')}><b>{phrase(1, 3)}</b><p>{prose()}</p></li>", f"<div{attr('comment', 'comment-body', 'response')}><p>{prose()}</p></div>", f"<p{attr('comment')}>{prose()}</p>")
        many = "".join(one() for _ in range(r.randrange(1, 6)))
        return f"<{(t := pick('section', 'div', 'ol', 'ul', 'div'))}{attr('comments', 'comment-list', 'disqus', 'discussion', 'responses', 'respond', 'replies')}>{pick('', '<h3>Comments</h3>', f'<h2>{phrase(1, 4)}</h2>')}{many}</{t}>"

    @within("footer")
    def footer() -> str:
        inner = pick(f"&copy; {word()}.example &middot; {phrase(2, 9)}.", f"<p>&copy; 2024 {phrase(1, 4)}</p><p>{prose()}</p>", f"<ul>{''.join(f'<li>{link(phrase(1, 3))}</li>' for _ in range(3))}</ul>", phrase(3, 12))
        return pick(f"<footer>{inner}</footer>", f"<footer{attr('footer')}>{inner}</footer>", f"<div{attr('footer', 'copyright', 'legal', 'bottom', 'colophon')}>{inner}</div>")

    @within("menu")
    def header() -> str:
        inner = pick(f"<p>{phrase(1, 6)}</p>", f"<h1>{phrase(1, 4)}</h1>{nav()}", f"<div>{phrase(1, 5)}</div>{nav()}", nav())
        return pick(f"<header>{inner}</header>", f"<div{attr('header', 'masthead', 'site-header', 'top', 'logo', 'top-bar', 'topbar', 'banner', 'site-title')}>{inner}</div>")

    def junk() -> str:
        return r.choice((nav, advert, notice, form, side, advert, comments))()

    main: list[str] = []

    def content(tag: str) -> str:
        text = phrase(1, 9) if tag[0] == "h" else pick(prose(), phrase(1, 6))
        main.append(text)
        if r.random() < 0.25 and " " in text:
            a, b = text.split(" ", 1)
            text = pick(f"{a} <em>{b}</em>", f"<b>{a}</b> {b}", f"{a} {link(b)}", f"{a}\n  {b}")
        if tag in ("p", "li") and r.random() < 0.3:
            return f"<{tag}>{pick('', '<b>')}{text}{pick('', '<br>')}"  # not closed
        return f"<{tag}{pick('', '', '', attr('title', 'headline', 'heading', 'subtitle') if tag[0] == 'h' else attr('text', 'lead', 'para', 'intro', 'paragraph', 'summary'))}>{text}</{tag}>"

    body = []
    if r.random() < 0.9:
        body.append(content("h1"))
    for _ in range(r.randrange(1, 16)):
        kind = pick("p", "p", "p", "p", "p", "p", "h2", "h3", "ul", "blockquote", "pre", "table", "junk", "figure")
        if kind == "ul":
            t = pick("ul", "ol")
            body.append(f"<{t}>" + "".join(content("li") for _ in range(r.randrange(2, 6))) + f"</{t}>")
        elif kind == "blockquote":
            body.append(f"<blockquote>{content('p')}</blockquote>")
        elif kind == "table":
            body.append("<table>" + "".join(f"<tr>{content('td')}{content('td')}</tr>" for _ in range(r.randrange(1, 4))) + "</table>")
        elif kind == "figure":
            body.append(f'<figure><img src="x.png">{content("figcaption")}</figure>')
        elif kind == "junk":
            body.append(junk() if r.random() < 0.5 else "<hr>")
        else:
            body.append(content(kind))
    if r.random() < 0.15:
        body.append(comments())
    inner = "".join(body)
    box = pick("article", "article", "main", "article-main", "div", "div", "section")
    if box == "article-main":
        inner = f"<main><article>{inner}</article></main>"
    elif box in ("div", "section"):
        inner = f"<{box}{attr('content', 'post', 'entry', 'article', 'story', 'main', 'body', 'article-body', 'post-content', 'entry-content', 'single', 'text', 'page-content')}>{inner}</{box}>"
    else:
        inner = f"<{box}{pick('', attr('content', 'post', 'entry', 'story'))}>{inner}</{box}>"
    top = [f() for f in (header, nav, notice, advert, form, side) if r.random() < 0.4]
    low = [f() for f in (comments, side, advert, nav, notice, form) if r.random() < 0.35] + [footer()] * (r.random() < 0.85)
    middle = "".join(top) + inner + "".join(low)
    middle = f"<div{attr('wrapper', 'page', 'container', 'site', 'layout', 'wrap', 'outer', 'row', 'columns', 'inner')}>{middle}</div>" if r.random() < 0.3 else middle
    on_body = pick("", "", attr("home", "blog", "single", "page", "index", "site", "no-js", "theme", "logged-in", "layout"))
    return f"<!DOCTYPE html><html><head><title>{phrase(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body{on_body}>{middle}</body></html>", main


def _labelled(rng: np.random.Generator, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _ in range(n):
        page, main = training_page(rng)
        blocks, left = leaf_blocks(page), list(map(lambda s: " ".join(s.split()), main))
        y = np.zeros(len(blocks), np.float32)
        at = 0
        for i, (_, t, _) in enumerate(blocks):
            if at < len(left) and t == left[at]:
                y[i], at = 1, at + 1
        if at == len(left):
            out.append((features(blocks), y))
    return out


@cache
def trained(seed: int = 11, pages: int = TRAIN_PAGES) -> dict[str, np.ndarray]:
    """The fitted weights; made once in a process, the same in every process."""
    rng = np.random.default_rng(seed)
    data = _labelled(rng, pages)
    model = {k: (rng.normal(size=s) * 0.15).astype(np.float32) for k, s in (("w0", (WIDTH, 4 * HIDDEN)), ("u0", (HIDDEN, 4 * HIDDEN)), ("w1", (WIDTH, 4 * HIDDEN)), ("u1", (HIDDEN, 4 * HIDDEN)), ("v", (2 * HIDDEN + WIDTH,)))}
    first, second, step = {k: 0 * v for k, v in model.items()}, {k: 0 * v for k, v in model.items()}, 0
    for epoch in range(EPOCHS):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][0]) // 8)
        starts = rng.permutation(range(0, len(order), 16))
        for s in starts.tolist():
            own = [data[i] for i in order[s : s + 16]]
            x, mask = _batch([a for a, _ in own])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, b) in enumerate(own):
                y[: len(b), k] = b
            z, both, held_a, held_b = _scores(model, x, mask, True)
            d = np.where(mask, _sigmoid(z) - y, 0) / mask.sum()
            grad = {"v": both.reshape(-1, both.shape[2]).T @ d.ravel()}
            dout = d[:, :, None] * model["v"]
            grad["w0"], grad["u0"] = _back(x, model["u0"], held_a, dout[:, :, :HIDDEN])
            grad["w1"], grad["u1"] = _back(x[::-1], model["u1"], held_b, dout[::-1, :, HIDDEN : 2 * HIDDEN])
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] -= (0.01 if epoch < EPOCHS - 2 else 0.002) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _extract(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in cut(whole, 2):
            pages = [leaf_blocks(p or "") for p in b.column(2).to_pylist()]
            marks = main_blocks(model.value, pages)
            texts = ["\n".join(t for (_, t, _), m in zip(p, k) if m) for p, k in zip(pages, marks)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every row of pages.

    text: the blocks labelled main text, in page order, joined by a line feed; character references
    decoded, white space in a block (line breaks too) one space. Null or empty html gives empty text,
    and so does a page without main text. Null ids and repeated rows give a row each; an empty table
    an empty table; other columns are ignored. Broken markup is read as far as it goes."""
    model = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_extract, model=model), f"page_id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
