"""Made-up pages with labelled blocks, from which the block labeller learns.

Layouts are drawn from the names that page authors use for the parts of a page. Words are random letters, the same for
articles and for what surrounds them, so only layout tells them apart.
"""

from __future__ import annotations

import random

from .html_extract import Paths, blocks

MAIN, REST = "", ""

#: Names that page authors use for classes and ids, by part of the page.
NAMES = {
    "main": "content main-content article article-body article-content post post-body post-content entry entry-content story story-body text body-text prose page-content main body markdown document".split(),
    "wrap": "wrapper container page site row col layout inner outer grid app root wrap center box".split(),
    "nav": "nav menu navbar main-menu navigation breadcrumb breadcrumbs topnav site-nav links tabs pagination pager toc languages skip-links nav-menu menubar".split(),
    "head": "header masthead site-header banner-top logo top-bar topbar branding tagline page-header".split(),
    "foot": "footer site-footer colophon copyright legal bottom foot page-footer credits".split(),
    "side": "sidebar aside widget related related-posts rail secondary recommended popular tags trending archive side most-read more-stories teaser author-bio".split(),
    "ad": "ad ads advert advertisement sponsored promo ad-banner adsbox ad-slot sponsor promoted commercial google-ads ad-container".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal paywall announcement banner warning disclaimer overlay".split(),
    "form": "form search search-form login signup newsletter subscribe subscription contact-form".split(),
    "talk": "comments comment-list reader-comments comment replies discussion responses comments-area thread reply user-comments feedback".split(),
    "share": "share social share-buttons byline meta post-meta author date timestamp tools print-link".split(),
}
ENTITIES = ("&amp;", "&copy;", "&nbsp;", "&middot;", "&eacute;", "&#8212;", "&quot;", "&lt;b&gt;")


class _Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.letters = self.r.choice(["aeinrstlohd", "aeinrstlouéèçq", "aeinrstlöäüßch", "aeosnrlóñcdu"])
        self.syllables = ["".join(self.r.choices(self.letters, k=self.r.randint(1, 4))) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, n: int, sentence: bool = True) -> str:
        out = [self.word() for _ in range(n)]
        if sentence:
            out[0] = out[0].capitalize()
            for i in range(1, n):
                if self.r.random() < 0.1:
                    out[i - 1] += self.r.choice(".,")
            out[-1] += "." if self.r.random() < 0.9 else ""
        if self.r.random() < 0.15:
            out.insert(self.r.randrange(n + 1), self.r.choice(ENTITIES))
        if self.r.random() < 0.06:
            out = [w + self.r.choice(("###", "&amp;&amp;", "%%%", "***", "!!")) for w in out]
        if n > 4 and self.r.random() < 0.3:
            i = self.r.randrange(n - 2)
            out[i] = self.r.choice(("<b>%s</b>", "<em>%s</em>", '<a href="/x">%s</a>', "<strong>%s</strong>", "<span>%s</span>", "<code>%s</code>", "%s<br>")) % out[i]
        return self.r.choice((" ", " ", " ", "\n")).join(out) if n < 8 else " ".join(out)

    def attr(self, part: str, bare: float = 0.15) -> str:
        if self.r.random() < bare:
            return ""
        name = self.r.choice(NAMES[part])
        if self.r.random() < 0.2:
            name += " " + self.r.choice(NAMES["wrap"])
        if self.r.random() < 0.1:
            name = name.replace("-", "_")
        if self.r.random() < 0.1:
            name += str(self.r.randint(1, 99))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def end(self, tag: str, chance: float = 0.93) -> str:
        return f"</{tag}>" if self.r.random() < chance else ""

    # parts around the article
    def items(self, mark: str, low: int = 2, high: int = 9) -> str:
        kind, n = self.r.random(), self.r.randint(low, high)
        w = lambda: mark + self.words(self.r.randint(1, 4), False)
        if kind < 0.65:
            return "<ul>" + "".join(f'<li><a href="/{i}">{w()}</a>{self.end("li")}' for i in range(n)) + "</ul>"
        if kind < 0.85:
            return " ".join(f'<a href="/{i}">{w()}</a>' for i in range(n))
        return "".join(f'<div><a href="/{i}">{w()}</a></div>' for i in range(n))

    def prose(self, mark: str, n: int) -> str:
        return "".join(f"<p>{mark}{self.words(self.length())}{self.end('p', 0.8)}" for _ in range(n))

    def length(self) -> int:
        return self.r.choice((1, 2, 3, 4, 6, 8, 12, 20, 35, 60, 90))

    def part(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            tag = r.choice(("nav", "nav", "div", "ul"))
            body = self.items(REST) if tag != "ul" else "".join(f'<li><a href="/{i}">{REST}{self.word()}</a></li>' for i in range(r.randint(2, 8)))
            return f"<{tag}{self.attr('nav', 0.5 if tag == 'nav' else 0.05)}>{body}</{tag}>"
        if kind == "head":
            tag = r.choice(("header", "header", "div"))
            body = r.choice((f"<h1>{REST}{self.words(3, False)}</h1>", f"<p>{REST}{self.words(6)}</p>", f'<a href="/">{REST}{self.word()}</a>', f"<span>{REST}{self.words(4)}</span>"))
            return f"<{tag}{self.attr('head', 0.6 if tag == 'header' else 0.0)}>{body}{self.part('nav') if r.random() < 0.3 else ''}</{tag}>"
        if kind == "foot":
            tag = r.choice(("footer", "footer", "footer", "div"))
            text = f"{REST}{r.choice(('&copy; ', '', '© 2024 '))}{self.words(self.length())}"
            return f"<{tag}{self.attr('foot', 0.6 if tag == 'footer' else 0.0)}>{r.choice((text, f'<p>{text}</p>', text + self.items(REST)))}</{tag}>"
        if kind == "side":
            tag = r.choice(("aside", "aside", "div", "section"))
            body = r.choice((f"<h3>{REST}{self.words(2, False)}</h3>{self.items(REST)}", self.prose(REST, r.randint(1, 3)), REST + self.words(self.length()), f"<h2>{REST}{self.words(2, False)}</h2>{self.prose(REST, 1)}"))
            return f"<{tag}{self.attr('side', 0.5 if tag == 'aside' else 0.0)}>{body}</{tag}>"
        if kind in ("ad", "notice"):
            tag = r.choice(("div", "div", "div", "aside", "section", "p" if kind == "ad" else "dialog"))
            text = REST + self.words(self.length())
            body = text if tag == "p" else r.choice((text, text, f"<p>{text}</p>", f"{text}<button>{REST}{self.word()}</button>", f"<h4>{REST}{self.words(2, False)}</h4><p>{text}</p>"))
            return f"<!-- {kind} --><{tag}{self.attr(kind, 0.0)}>{body}</{tag}>"
        if kind == "form":
            fields = "".join(r.choice((f"<label>{REST}{self.word()}</label><input name='q'>", f"<p>{REST}{self.words(self.length())}</p>", f"<button>{REST}{self.word()}</button>", f"<select><option>{REST}{self.word()}<option>{REST}{self.word()}</select>", "<textarea>x y</textarea>")) for _ in range(r.randint(1, 4)))
            return f"<form{self.attr('form', 0.5)}>{fields}<input type=submit></form>"
        if kind == "talk":
            tag, one = r.choice(("section", "div", "div", "ol", "aside")), r.choice(("div", "li", "article", "p", "blockquote"))
            said = "".join(f"<{one}{self.attr('talk', 0.5)}>{REST + self.words(self.length()) if one == 'p' or r.random() < 0.4 else f'<b>{REST}{self.word()}</b>' + self.prose(REST, r.randint(1, 2))}</{one}>" for _ in range(r.randint(1, 6)))
            return f"<{tag}{self.attr('talk', 0.0)}>{f'<h3>{REST}{self.words(2, False)}</h3>' if r.random() < 0.6 and tag != 'ol' else ''}{said}</{tag}>"
        return f"<div{self.attr('share', 0.0)}>{r.choice((REST + self.words(3, False), self.items(REST, 2, 4)))}</div>"

    # the article
    def inside(self) -> str:
        r, m = self.r, MAIN
        kind = r.random()
        if kind < 0.72:
            return self.prose(m, 1)
        if kind < 0.8:
            h = r.choice(("h2", "h3", "h4"))
            return f"<{h}>{m}{self.words(r.randint(1, 7), False)}</{h}>"
        if kind < 0.86:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{m}{self.words(self.length())}{self.end('li')}" for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if kind < 0.89:
            return f"<blockquote>{r.choice((m + self.words(self.length()), self.prose(m, 1)))}</blockquote>"
        if kind < 0.91:
            return "<table>" + "".join(f"<tr><td>{m}{self.word()}</td><td>{m}{self.word()}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        if kind < 0.93:
            return f"<pre>{m}{self.words(self.length())}</pre>"
        if kind < 0.95:
            return f"<figure><img src='x.png'><figcaption>{m}{self.words(self.length())}</figcaption></figure>"
        if kind < 0.97:
            return f"<div>{m}{self.words(self.length())}</div>"
        return f"<section>{self.prose(m, r.randint(1, 3))}</section>"

    def article(self) -> str:
        r = self.r
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        attr = self.attr("main", 0.6 if tag in ("article", "main") else 0.1)
        title = self.words(r.randint(1, 10), False)
        body = [self.inside() for _ in range(r.choice((1, 2, 3, 4, 5, 7, 10, 16, 30)))]
        if r.random() < 0.2:
            body[0] = f"<p><b>{MAIN}{self.words(self.length())}<br>{body[0]}"
        for kind in ("ad", "share", "side", "form", "notice", "nav"):
            if r.random() < 0.2:
                body.insert(r.randrange(len(body) + 1), self.part(kind))
        if r.random() < 0.85:
            h = f"<h1>{MAIN}{title}</h1>"
            body.insert(0, f"<header>{h}</header>" if r.random() < 0.1 else h)
        if r.random() < 0.1:
            body.append(self.part("talk"))
        if r.random() < 0.2:
            inner = r.choice(("div", "section"))
            body = [f"<{inner}{self.attr('main', 0.3)}>", *body, f"</{inner}>"]
        out = f"<{tag}{attr}>{''.join(body)}</{tag}>"
        if tag != "main" and r.random() < 0.3:
            out = f"<main{self.attr('main', 0.5)}>{out}{self.part('talk') if r.random() < 0.2 else ''}</main>"
        return out

    def page(self) -> str:
        r = self.r
        parts = [self.article()]
        before = [k for k, p in (("head", 0.5), ("nav", 0.7), ("notice", 0.25), ("ad", 0.4), ("form", 0.2), ("side", 0.15), ("share", 0.1)) if r.random() < p]
        after = [k for k, p in (("talk", 0.4), ("side", 0.3), ("ad", 0.25), ("form", 0.2), ("share", 0.15), ("nav", 0.15), ("notice", 0.15)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        parts = [self.part(k) for k in before] + parts + [self.part(k) for k in after]
        if r.random() < 0.85:
            parts.append(self.part("foot"))
        body = "".join(parts)
        if r.random() < 0.3:
            body = f"<div{self.attr('wrap', 0.1)}>{body}</div>"
        end = r.choice(("</body></html>", "</body></html>", ""))
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.words(4, False)}</title><style>p{{margin:0}}</style></head><body>{body}<script>var t='</p>';</script>{end}"


def pages(n: int, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """n pages and the label of each of their blocks, true for the article's."""
    out = []
    for k in range(n):
        marked = _Page(seed * 1_000_003 + k).page()
        labels = [MAIN in text for _, text, _ in blocks(marked, Paths())]
        out.append((marked.replace(MAIN, "").replace(REST, ""), labels))
    return out
