"""Random web pages with known main text, for training the extractor.

Words are invented; layouts vary in wrappers, semantic tags, attribute tokens, broken
markup, and in what surrounds the article: menus, headers, sidebars, notices, adverts,
forms, reader comments, related links and footers.
"""

from __future__ import annotations

import numpy as np

#: Tokens that sites put into class, id and role attributes, by what they mark.
TOKENS = {
    "nav": "nav navbar navigation menu topbar toolbar masthead breadcrumb breadcrumbs banner main-menu site-nav mega-menu".split(),
    "ad": "ad ads adv advert advertisement adbox adslot dfp sponsor sponsored sponsors promo promoted promotion banner ad-box ad-slot google-ads".split(),
    "side": "sidebar side widget widgets related recommended recommend recommendations trending teaser aside popular most-read rail secondary".split(),
    "notice": "cookie cookies notice consent alert gdpr popup modal newsletter subscribe subscription paywall cookie-banner toast privacy".split(),
    "form": "form search login signup register contact-form searchform signin".split(),
    "comments": "comments commentlist comment-list reader-comments discussion responses replies respond reader-responses disqus thread".split(),
    "comment": "comment reply comment-body response post-reply".split(),
    "header": "header masthead banner site-header top brand logo".split(),
    "share": "share sharing social tags breadcrumb pagination pager paging share-buttons follow byline-links skip".split(),
    "footer": "footer foot copyright credits site-footer bottom legal colophon contentinfo".split(),
    "heading": "h heading headline title subtitle subhead section-title h2 caption-title".split(),
    "main": "content article post entry main story prose body copy text lead column articlebody article-body entry-content post-content page".split(),
    "outer": "container wrapper page content layout site inner row has-sidebar no-ads with-nav comments-open".split(),
}

_PARTS = "an ber co di en fa gor hi il ka lo me nu or pi qu ra si ta un ver wi xe ya zo tion ing ment".split()


class _Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.main: set[str] = set()

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def word(self) -> str:
        return "".join(_PARTS[int(i)] for i in self.rng.integers(0, len(_PARTS), int(self.rng.integers(1, 5))))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high + 1)))).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.phrase(2, 16) + self.pick(".", ".", ".", "?", "!") for _ in range(int(self.rng.integers(low, high + 1))))

    def keep(self, text: str) -> str:
        self.main.add(text)
        return text

    def attrs(self, *tokens: str) -> str:
        if self.chance(0.25):
            return ""
        t = self.pick(*tokens)
        t = self.pick(t, t, f"{t}-{self.word()}", f"site-{t}", f"{self.word()} {t}")
        return self.pick(f' class="{t}"', f' id="{t}"', f" class='{t}'", f' class="{t}" data-x="1"')

    def odd(self) -> str:
        """Attributes that say nothing."""
        return self.pick("", "", f" data-{self.word()}='{self.pick('comment', 'ad', 'nav', 'x')}-{int(self.rng.integers(99))}'", f' style="margin: {int(self.rng.integers(9))}px"', f" title={self.word()}", f' lang="{self.pick("en", "fr")}"')

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/{self.word()}">{self.phrase(1, 3)}{self.pick("", "", "", ".", ",", "!", ": ", "?")}</a>{self.pick("</li>", "</li>", "")}' for _ in range(int(self.rng.integers(low, high + 1)))]
        if self.chance(0.35):
            return self.pick(" | ", " | ", "<br>", " &middot; ", " ").join(x.replace("<li>", "").replace("</li>", "") for x in items)
        return "<ul>" + "".join(items) + "</ul>"

    def boiler(self, kind: str) -> str:
        div = self.pick("div", "div", "section")
        if kind == "nav":
            tag = self.pick("nav", "nav", "div", "header")
            return f"<{tag}{self.attrs(*TOKENS['nav'])}>{self.links(3, 9)}</{tag}>"
        if kind == "ad":
            tag = self.pick("div", "div", "div", "aside", "section")
            token = f' class="{self.pick(*TOKENS["ad"])}"'
            body = self.pick(self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", f'<a href="#">{self.phrase(2, 8)}</a>')
            return f"<{tag}{token}>{body}</{tag}>"
        if kind == "side":
            tag = self.pick("aside", "aside", "div")
            token = self.attrs(*TOKENS["side"]) if tag == "aside" else f' class="{self.pick(*TOKENS["side"])}"'
            return f"<{tag}{token}><h3>{self.phrase(1, 3)}</h3>{self.pick(self.links(2, 7), f'<p>{self.sentences(1, 3)}</p>')}</{tag}>"
        if kind == "notice":
            token = self.pick(*TOKENS["notice"])
            return f'<{div} {self.pick("class", "id")}="{token}"><p>{self.sentences(1, 3)}</p><button>{self.word()}</button></{div}>'
        if kind == "form":
            return f'<form{self.attrs("search", "login", "signup")}><label>{self.phrase(1, 3)}</label> <input name=q>{self.pick("", f"<p>{self.sentences(1, 1)}</p>")}<button>{self.word()}</button></form>'
        if kind == "comments":
            tag = self.pick("div", "section", "ol")
            token = self.pick(*TOKENS["comments"])
            inner = "li" if tag == "ol" else self.pick("div", "article", "div")
            each = "".join(f'<{inner} class="{self.pick(*TOKENS["comment"])}">{self.pick("", f"<h4>{self.phrase(1, 2)}</h4>", f"<b>{self.word()}</b>: ")}<p>{self.sentences(1, 5)}</p></{inner}>' for _ in range(int(self.rng.integers(1, 6))))
            return f'<{tag} {self.pick("class", "id")}="{token}">{self.pick("", f"<h2>{self.phrase(1, 2)}</h2>")}{each}</{tag}>'
        if kind == "header":
            return f"<header{self.attrs(*TOKENS['header'])}>{self.pick(f'<h2>{self.phrase(1, 3)}</h2>', f'<p>{self.phrase(2, 6)}</p>', self.phrase(1, 4))}</header>"
        if kind == "share":
            return f'<div class="{self.pick(*TOKENS["share"])}">{self.links(2, 5)}</div>'
        tag = self.pick("footer", "footer", "div")
        token = self.attrs(*TOKENS["footer"]) if tag == "footer" else f' id="{self.pick(*TOKENS["footer"])}"'
        return f"<{tag}{token}>{self.pick(f'{self.pick("Copyright", "(c)", "&copy;")} {self.phrase(1, 4)} {1990 + int(self.rng.integers(40))}{self.pick("", " | ", ". ")}{self.sentences(0, 2)}', f'<p>{self.sentences(1, 2)}</p>', self.links(2, 6), f'<p>{self.phrase(3, 8)}</p>{self.links(2, 4)}')}</{tag}>"

    def linked(self) -> str:
        """A sentence that is mostly links, as articles have them."""
        parts, text = [], []
        for _ in range(int(self.rng.integers(2, 5))):
            lead, name = self.pick("", self.word() + " ", self.phrase(1, 3).lower() + " "), self.phrase(1, 4).lower()
            parts.append(f'{lead}<a href="/{self.word()}">{name}</a>')
            text.append(lead + name)
        first = self.phrase(1, 2) + " " if self.chance(0.7) else ""
        join = lambda items: first + ", ".join(items[:-1]) + self.pick(" and ", ", ", " or ") + items[-1]
        state = self.rng.bit_generator.state
        told = join(text) + "."
        self.rng.bit_generator.state = state  # the same words between the links
        html = join(parts) + "."
        self.keep(told)
        return html

    def block(self) -> str:
        if self.chance(0.05):
            return f"<p>{self.linked()}{self.pick('</p>', '</p>', '')}"
        r = self.rng.random()
        if r < 0.62:
            text = self.keep(self.sentences(1, int(self.pick(1, 3, 8, 20))))
            return self.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p{self.odd()}><{(i := self.pick('em', 'strong', 'span', 'font'))}>{text}{self.pick('</' + i + '>', '')}{self.pick('</p>', '')}")
        if r < 0.72 and self.chance(0.25):
            token = self.pick("", f' class="{self.pick(*TOKENS["heading"])}"', f' class="{self.pick(*TOKENS["heading"])}"', f' class="{self.word()[:2]}"')
            text = self.keep(self.phrase(1, 7))
            return f"<div{token}>{self.pick(text, text, f'<b>{text}</b>', f'<span>{text}</span>')}</div>"
        if r < 0.72:
            return f"<{(h := self.pick('h2', 'h2', 'h3', 'h4'))}>{self.keep(self.phrase(1, 7))}</{h}>"
        if r < 0.82:
            return f"<{(t := self.pick('ul', 'ol'))}>" + "".join(f"<li>{self.keep(self.pick(self.phrase(2, 9), self.sentences(1, 2)))}</li>" for _ in range(int(self.rng.integers(2, 6)))) + f"</{t}>"
        if r < 0.88:
            return f"<blockquote>{self.pick('<p>', '')}{self.keep(self.sentences(1, 3))}</blockquote>"
        if r < 0.91:
            return f"<pre>{self.keep(self.phrase(3, 12))}</pre>"
        if r < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.phrase(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(int(self.rng.integers(2, 5)))) + "</table>"
        return f'<figure><img src="x.png"><figcaption>{self.keep(self.phrase(3, 9))}</figcaption></figure>'

    def page(self) -> str:
        title = self.phrase(2, 9) + self.pick("", ".")
        body = [f"<h1>{self.keep(title)}</h1>"] if self.chance(0.9) else []
        if body and self.chance(0.15):
            body = [f"<header>{body[0]}</header>"]
        body += [self.block() for _ in range(int(self.rng.geometric(0.12)) + (0 if body else 1))]
        for kind in ("ad", "share", "notice", "form"):
            if self.chance(0.15):
                body.insert(int(self.rng.integers(0, len(body) + 1)), self.boiler(kind))
        wrap = self.pick("article", "article", "main", "div", "div", "section", "td")
        token = "" if wrap in ("article", "main") and self.chance(0.6) else self.attrs(*TOKENS["main"])
        main = "".join(body)
        top = f"<tr><td colspan=2>{self.pick('', f'<font size=5>{self.phrase(1, 3)}</font>')}{self.links(2, 5)}</td></tr>" if self.chance(0.5) else ""
        main = f"<table>{top}<tr><td>{self.links(2, 5)}</td><td{token}>{main}</td></tr></table>" if wrap == "td" else f"<{wrap}{token}{self.odd()}>{main}</{wrap}>"
        if self.chance(0.25):
            main = f"<{(o := self.pick('div', 'main'))}{self.attrs(*TOKENS['outer'])}>{main}{self.boiler('comments') if self.chance(0.4) else ''}</{o}>"
        above = [self.boiler(k) for k, p in (("notice", 0.3), ("header", 0.35), ("nav", 0.85), ("form", 0.2), ("ad", 0.5)) if self.chance(p)]
        below = [self.boiler(k) for k, p in (("side", 0.35), ("comments", 0.35), ("share", 0.25), ("ad", 0.2), ("form", 0.15), ("footer", 0.85)) if self.chance(p)]
        if self.chance(0.15):
            above.append(self.boiler("side"))
        extra = [self.pick(f'<meta name="{self.word()}" content="{self.phrase(1, 6)}">', f"<style>.{self.word()} a {{ color: #{int(self.rng.integers(999)):03d} }}</style>", f"<script>{self.word()}({{x: '<div>'}})</script>", '<link rel="stylesheet" href="s.css">') for _ in range(int(self.rng.integers(0, 5)))]
        head = f"<head><title>{title}</title>{''.join(extra)}</head>"
        return f"<!DOCTYPE html><html>{head}<body{self.attrs('page', 'home') if self.chance(0.2) else ''}>{''.join(above)}{main}{''.join(below)}" + self.pick("</body></html>", "</body></html>", "")


def make_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """(html, the texts of the main blocks)."""
    maker = _Maker(rng)
    html = maker.page()
    return html, maker.main
