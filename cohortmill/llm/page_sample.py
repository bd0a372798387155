"""Labelled pages on which the block classifier of operator 5 is fitted, made from a seed: no table holds labels of blocks.

Every block stands in an element that carries data-l, 1 for content and 0 for boilerplate. Layouts, element names and class
names vary on their own, so that none of them alone tells content from boilerplate; in particular, names of boilerplate
also occur as parts of names around content, and the other way round.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba be ko la mi no pu ra se ti vo zu an er in on sch qu".split()
#: Names by the part of a page that they are given to, and the elements that part is made of.
PARTS = {
    "menu": (("nav", "div", "ul", "header"), "nav navbar menu main-menu navigation breadcrumbs breadcrumb topbar toolbar pagination pager tabs skip-links"),
    "head": (("header", "div", "header"), "header site-header masthead banner page-header branding logo top"),
    "foot": (("footer", "div", "footer"), "footer site-footer page-footer copyright legal colophon contentinfo bottom imprint"),
    "side": (("aside", "div", "aside", "section"), "sidebar side-bar widget widgets related related-posts recommended more-stories trending popular most-read complementary rail tags share social share-buttons follow author-box"),
    "notice": (("div", "section", "dialog"), "cookie cookies cookie-notice cookie-banner consent gdpr notice alert popup modal overlay paywall announcement privacy-notice"),
    "advert": (("div", "aside", "section", "ins"), "ad ads advert advertisement ad-slot adsbygoogle sponsor sponsored promo promotion banner-ad partner teaser"),
    "form": (("form", "div", "form", "fieldset"), "form search search-form newsletter subscribe signup login contact-form poll comment-form"),
    "comments": (("section", "div", "ol", "article"), "comments comment comment-list commentlist disqus discussion replies reply respond responses reader-comments user-comments talkback feedback"),
}
CONTENT = "article content post entry story main body text article-body post-content entry-content story-body main-content page-content prose hentry"
_NEUTRAL = "wrapper container page row col inner outer box block section group item site app root layout grid flex home single"


def _words(r: random.Random, n: int) -> str:
    out = ["".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 2, 2, 3, 4)))) for _ in range(n)]
    for i in range(n):
        if i == 0 or out[i - 1][-1] in ".!?":
            out[i] = out[i].capitalize()
        if i == n - 1 or r.random() < 0.1:
            out[i] += r.choice(("", ",", ".", ".", ".", "?", "!")) if i < n - 1 else r.choice(".....!?")
    return " ".join(out)


def _title(r: random.Random, most: int = 4) -> str:
    return _words(r, r.randint(1, most)).rstrip(".!?,")


def _attributes(r: random.Random, names: str, label: int | None, chance: float) -> str:
    """A class or id of one of `names`, now and then with others, and a mark."""
    of = [r.choice(names.split())] if r.random() < chance else []
    if r.random() < 0.3:
        of.append(r.choice(_NEUTRAL.split()))
    if label and r.random() < 0.25:  # boilerplate's names as parts of content's
        part = r.choice(PARTS[r.choice(list(PARTS))][1].split())
        of.append(r.choice((f"has-{part}", f"with-{part}", f"no-{part}", f"{_title(r, 1).lower()}-{part}", f"{part}-{_title(r, 1).lower()}")))
    if label == 0 and r.random() < 0.15:
        of.append(f"{r.choice(CONTENT.split())}-{r.choice(('foot', 'after', 'meta', 'extra', 'side'))}")
    r.shuffle(of)
    out = f' {r.choice(("class", "class", "id"))}="{" ".join(of)}"' if of else ""
    if r.random() < 0.05:
        out += ' title="a > b"'
    return out + (f' data-l="{label}"' if label is not None else "")


def _boilerplate(r: random.Random, kind: str) -> str:
    tags, names = PARTS[kind]
    tag = r.choice(tags)
    # a plain element without a name can't be told apart, so it always has one
    a = _attributes(r, names, 0, 1.0 if tag in ("div", "section", "ul", "ol", "article", "ins") else 0.5)
    if kind in ("menu", "side") and r.random() < 0.8:
        links = "".join(f'<li><a href="/{i}">{_title(r, 5)}</a></li>' for i in range(r.randint(2, 9)))
        inner = links if tag in ("ul", "ol") else (f"<h3>{_title(r)}</h3>" if r.random() < 0.4 else "") + f"<ul>{links}</ul>"
    elif kind == "comments":
        inner = "".join(f"<{t}>{r.choice(('', f'<b>{_title(r, 2)}</b> '))}{_words(r, r.randint(4, 60))}</{t}>" for t in [r.choice(("p", "li", "div", "article"))] * r.randint(1, 6))
    elif kind == "form":
        inner = f"<label>{_title(r)}</label><input><p>{_words(r, r.randint(2, 15))}</p><button>{_title(r, 2)}</button>"
    elif kind == "foot":
        inner = r.choice(("", f"<p>{_words(r, r.randint(3, 30))}</p>")) + f"<p>© {r.randint(1999, 2030)} {_title(r)}</p>"
    else:
        inner = r.choice((_words(r, r.randint(2, 12)), f"<p>{_words(r, r.randint(3, 45))}</p>", f"<a href=x>{_title(r, 6)}</a>"))
    return f"<{tag}{a}>{inner}</{tag}>"


def _content(r: random.Random) -> str:
    kind = r.random()
    n = r.choice((2, 5, 12, 30, 60, 120))
    text = _words(r, n)
    if r.random() < 0.2:
        text = text.replace(" ", f' <a href="/x">{_title(r, 2)}</a> ', 1)
    if kind < 0.12:
        return f"<h2>{_title(r, 7)}</h2>"
    if kind < 0.2:
        return "<ul>" + "".join(f"<li>{_words(r, r.randint(2, 14))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
    if kind < 0.24:
        return f"<blockquote><p>{text}</p></blockquote>"
    if kind < 0.27:
        return f"<pre>{text}</pre>"
    if kind < 0.3:
        return "<table>" + "".join(f"<tr><td>{_title(r)}</td><td>{_words(r, 3)}</td></tr>" for _ in range(3)) + "</table>"
    if kind < 0.33:
        return f"<figure><img src=x><figcaption>{_words(r, 8)}</figcaption></figure>"
    if kind < 0.38:
        return f"<div>{text}</div>"
    return f"<p>{text}" + r.choice(("</p>", "</p>", ""))


def page(r: random.Random) -> str:
    """One page: parts around a main part, in wrappers."""
    inside = [f"<h1>{_title(r, 9)}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.randint(1, 9)):
        inside.append(_content(r))
        if r.random() < 0.2:
            inside.append(_boilerplate(r, r.choice(("advert", "side", "form", "notice", "notice"))))
    if r.random() < 0.1:
        inside.append(_boilerplate(r, "comments"))
    if r.random() < 0.12:
        inside[0] = f'<header data-l="1">{inside[0]}</header>'
    tag = r.choice(("article", "article", "main", "div", "div", "section", "td"))
    main = f"<{tag}{_attributes(r, CONTENT, 1, 0.8 if tag in ('div', 'section', 'td') else 0.4)}>{''.join(inside)}</{tag}>"
    for _ in range(r.choice((0, 0, 1, 2))):
        main = f"<{(w := r.choice(('div', 'main', 'section', 'div')))}{_attributes(r, CONTENT + ' ' + _NEUTRAL, 1, 0.6)}>{main}</{w}>"
    bare = r.random() < 0.12  # nothing stands around the text but what the whole page stands in
    if bare:
        main = "".join(inside)
    before = [_boilerplate(r, k) for k in ("notice", "head", "menu", "advert", "form", "side") if r.random() < 0.45]
    after = [_boilerplate(r, k) for k in ("side", "comments", "advert", "form", "menu", "notice") if r.random() < 0.35]
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < 0.8:
        after.append(_boilerplate(r, "foot"))
    body = "".join(before) + main + "".join(after)
    for _ in range(r.choice((0, 1, 1, 2))):
        body = f'<div class="{r.choice(_NEUTRAL.split())}">{body}</div>'
    part = r.choice(PARTS[r.choice(list(PARTS))][1].split())
    names = r.choice(("", ' class="home"', ' class="single no-js"', f' class="has-{part}"', f' class="with-{part} page"', f' class="{part}-{_title(r, 1).lower()}"', f' class="{_title(r, 1).lower()}-{part}"'))
    return f"<html><head><title>{_title(r)}</title></head><body{names}{' data-l="1"' * bare}>{body}</body></html>"


def pages(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
