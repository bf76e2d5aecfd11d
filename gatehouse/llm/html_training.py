"""Labelled pages for the block classifier: made-up markup in which every main block is known.

Each page lists parts as (opening tags, texts, closing tags, is it main text). Words are numbered fillers; what counts is their number. Beside tidy
pages there are drawn ones, in which menus, related pages and headings stand in plain divisions, so that only their links tell, and
texts hold links, go on after sidebars and reader comments, and end in short paragraphs.
"""

from __future__ import annotations

import random
import re

_FILL = "brick lantern orchard ledger meadow copper violin harbour saddle kettle marble pigeon thimble walnut".split()


def _words(count: int, seed: int) -> str:
    return " ".join(_FILL[(seed * 5 + i * 3) % len(_FILL)] for i in range(count)) + f" n{seed}"


def _links(count: int, seed: int) -> str:
    return "".join(f'<li><a href="/{i}">{_words(1 + (seed + i) % 3, seed + i)}</a></li>' for i in range(count))


def _page(number: int, parts: list[tuple[str, str, str, bool]]) -> tuple[str, set[str]]:
    body = "".join(f"{a}{t}{b}" for a, t, b, _ in parts)
    head = f"<head><title>{_words(6, number)}</title><style>p{{}}</style><script>var a=1;</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>", {re.sub("<[^>]+>", "", t) for _, t, _, main in parts if main}


DRAWN = 200


def _text(rng: random.Random, count: int, linked: float = 0.0) -> str:
    """A sentence of filler words with a number of its own; about so many of its words are links."""
    words = [rng.choice(_FILL) for _ in range(count - 1)] + [f"n{rng.randrange(10**9)}"]
    if linked:
        size = max(1, round(count * linked))
        at = rng.randrange(count - size + 1)
        words[at:at + size] = [f'<a href="/x">{" ".join(words[at:at + size])}</a>']
    return " ".join(words)


def _link_list(rng: random.Random, parts: list) -> None:
    """A menu or related pages without a telling name: list items, or a line of links."""
    box, item = rng.choice([("div", "li"), ("ul", "li"), ("div", "div"), ("div", "p"), ("section", "span")])
    parts.append((f"<{box}>", "", "", False))
    if rng.random() < 0.3:
        parts.append(("<div>", _text(rng, rng.randint(2, 3)), "</div>", False))
    for _ in range(rng.randint(3, 9)):
        own = "".join(f'<a href="/y">{_text(rng, rng.randint(1, 12))}</a> ' for _ in range(1 if item != "p" else rng.randint(2, 5))).strip()
        parts.append((f"<{item}>", own, f"</{item}>", False))
    parts.append((f"</{box}>", "", "", False))


def _passage(rng: random.Random, parts: list, article: bool) -> None:
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["p", "p", "p", "div"])
        count = rng.choice([rng.randint(12, 40), rng.randint(30, 160)] + ([rng.randint(2, 9)] if article or tag == "p" else []))
        linked = rng.choice([0, 0, rng.uniform(0.05, 0.45)]) if count > 9 else 0
        parts.append((f"<{tag}>", _text(rng, count, linked), f"</{tag}>", True))
    if rng.random() < (0.5 if article else 0.2):
        parts.append(("<h2>", _text(rng, rng.randint(2, 7), rng.choice([0, 0, 0, 1])), "</h2>", True))
        parts.append(("<p>", _text(rng, rng.randint(15, 90)), "</p>", True))
    if article and rng.random() < 0.4:
        parts += [("<li>", _text(rng, rng.randint(2, 20)), "</li>", True) for _ in range(rng.randint(2, 4))]


def _aside(rng: random.Random, parts: list) -> None:
    """Something that is no main text by its tag or name, of any length."""
    name = rng.choice(["sidebar", "comments", "related", "newsletter", "ad", "cookie-notice", "share", "promo"])
    opening, closing = rng.choice([(f'<div class="{name}">', "</div>"), (f'<section id="{name}">', "</section>"), ("<aside>", "</aside>"), ("<form>", "</form>"), ("<nav>", "</nav>"),
                                   (f'<div class="{name} box">', "</div>"), ('<div hidden="">', "</div>"), ('<div style="display: none">', "</div>")])
    parts.append((opening, "", "", False))
    parts += [(f"<{t}>", _text(rng, rng.randint(3, 70)), f"</{t}>", False) for t in rng.choices(["p", "div", "h3"], k=rng.randint(1, 3))]
    parts.append((closing, "", "", False))


def drawn_page(seed: int) -> tuple[str, set[str]]:
    rng = random.Random(seed)
    article, parts = seed % 2 == 0, []
    for _ in range(rng.randint(0, 2)):
        rng.choice([_link_list, _aside])(rng, parts)
    if rng.random() < 0.5:
        parts.append(("<header><p>", _text(rng, rng.randint(2, 20)), "</p></header>", False))
    tag = rng.choice(["article", "main"])
    if article:
        parts.append((f"<{tag}>", "", "", False))
    parts.append(("<h1>", _text(rng, rng.randint(3, 12), rng.choice([0, 0, 1])), "</h1>", True))
    for _ in range(rng.randint(1, 3)):
        _passage(rng, parts, article)
        if rng.random() < 0.6:
            rng.choice([_link_list, _aside, _aside])(rng, parts)
    if article:
        parts.append((f"</{tag}>", "", "", False))
    for _ in range(rng.randint(0, 2)):
        rng.choice([_link_list, _aside])(rng, parts)
    parts.append(("<footer>", _text(rng, rng.randint(3, 40)), "</footer>", False))
    return _page(seed, parts)


def labelled_pages() -> list[tuple[str, set[str]]]:
    pages = [drawn_page(seed) for seed in range(DRAWN)]
    # article pages: paragraphs of every length between menus, adverts, notices and footers of every length
    for n, lengths in enumerate([(3, 40, 2), (60, 8, 15), (1, 1, 90), (25, 25, 25), (12, 300, 5), (7, 18, 33)]):
        s = 100 * n
        menu = ("<nav><ul>", _links(3 + n, s), "</ul></nav>", False)
        advert = (f'<div class="{["ad", "advert-box", "banner", "sponsored", "promo", "ad"][n]}">', _words(lengths[n % 3] + 3, s + 20), "</div>", False)
        title = ("<h1>", _words(4 + n, s + 30), "</h1>", True)
        texts = [("<p>", _words(k, s + 40 + i), "</p>", True) for i, k in enumerate(lengths)]
        listed = [("<li>", _words(5 + n, s + 50), "</li>", True), ("<blockquote>", _words(9, s + 51), "</blockquote>", True),
                  ("<h2>", _words(2, s + 52), "</h2>", True), ("<td>", _words(3, s + 53), "</td>", True), ("<pre>", _words(6, s + 54), "</pre>", True)]
        side = ("<aside><p>", _words(lengths[0] + 6, s + 60), "</p></aside>", False)
        form = ("<form><p>", _words(8, s + 61), "</p></form>", False)
        remarks = ('<section class="comments"><div class="comment"><p>', _words(lengths[1] + 4, s + 62), "</p></div></section>", False)
        foot = ("<footer>", _words(6 + lengths[2] // 2, s + 63), "</footer>", False)
        top = ("<header><p>", _words(3 + n, s + 64), "</p></header>", False)
        notice = ('<div id="cookie-notice"><p>', _words(14 + n, s + 65), "</p></div>", False)
        tag = ["article", "main", "article", 'article class="post"', "article", "main"][n]
        inner = [title, *texts, *(listed if n % 2 else listed[:2])]
        pages.append(_page(n, [top, menu, notice, advert, (f"<{tag}>", "", "", False), *inner, form, advert, remarks,
                               (f"</{tag.split()[0]}>", "", "", False), side, foot]))
    # pages without an article element: the text stands in plain divisions
    for n, lengths in enumerate([(45, 60, 30), (25, 80, 22), (120, 35, 50)]):
        s = 1000 + 100 * n
        pages.append(_page(10 + n, [
            ('<div class="top-menu"><ul>', _links(5, s), "</ul></div>", False), ("<ul>", _links(6, s + 10), "</ul>", False),
            ("<h1>", _words(6, s + 20), "</h1>", True),
            *[("<div><p>", _words(k, s + 30 + i), "</p></div>", True) for i, k in enumerate(lengths)],
            ("<div>", _words(lengths[0], s + 40), "</div>", True),
            ('<div class="sidebar"><p>', _words(24, s + 50), "</p></div>", False),
            ('<div id="comments"><p>', _words(32, s + 51), "</p></div>", False),
            ("<div>", f'<a href="/">{_words(4, s + 60)}</a>', "</div>", False), ("<footer><p>", _words(9, s + 61), "</p></footer>", False),
            ('<div hidden=""><p>', _words(30, s + 62), "</p></div>", False),
        ]))
    return pages
