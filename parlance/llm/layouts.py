"""Labelled pages for the extraction model: real pages, rebuilt in other site layouts.

A page that names its article by markup (``article`` or ``main``) is its own label.  Its texts are also put
into layouts that sites use without such markup, with menus, notices, adverts, forms and comments
around and inside the article.  In a layout ``data-label`` says what an element holds.
"""

from __future__ import annotations

import html
import random

# How sites name the parts of a page (tag and class or id), and what the parts say.
ARTICLE = ["article", "main", "article class=post", "div class=article-body", "div class=post-content", "div id=content",
           "div class='entry entry-content'", "section class=story", "div itemprop=articleBody", "td class=content",
           "div role=main", "div class=text", "div id=main-content", "article class=entry"]
MENU = ["nav", "ul class=menu", "div id=menu", "div class=navbar", "ul class=breadcrumbs", "div role=navigation", "menu",
        "div class=nav-links", "div class=topmenu"]
HEADER = ["header", "div id=header", "div class=masthead", "div class=top-bar", "div class=site-header", "div role=banner",
          "div class=logo"]
FOOTER = ["footer", "div id=footer", "div class=bottom", "div class=copyright", "div class=site-footer", "address",
          "div role=contentinfo", "div class=legal"]
SIDE = ["aside", "div class=sidebar", "div id=side", "div class=widget", "div class=related-posts", "section class=related",
        "div class=recommended", "div role=complementary", "div class=trending", "td class=right-column", "div class=tags"]
NOTICE = ["div class=notice", "div class=cookie-banner", "div id=cookie-consent", "div class=alert", "div class=popup",
          "div role=alert", "div class=modal", "p class=disclaimer", "div class=gdpr", "dialog", "div class=paywall"]
ADVERT = ["div class=ad", "div class=advert", "div class=ads", "div id=sponsored", "aside class=promo", "div class=banner",
          "div class=advertisement", "section class=sponsor", "div class=ad-slot"]
FORM = ["form", "form class=newsletter", "div class=subscribe", "form id=login", "div class=search-box", "form class=search",
        "fieldset", "div class=signup", "div class=share", "div class=social"]
COMMENTS = ["section id=comments", "div class=comments", "ol class=comment-list", "div class=comment", "ul class=replies",
            "div id=disqus", "div class=reader-comments", "article class=comment", "section class=discussion",
            "div class=reviews"]
MENU_WORDS = "Home About Contact News Sport Archive Login Shop Blog Help Start Kontakt Accueil Inicio Aktuell Noticias".split()
NOTICES = ["We use cookies to improve this site.", "This site uses cookies. Accept all", "Please enable JavaScript.",
           "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Usamos cookies.", "Subscribe to read on."]
FORMS = ["Subscribe to our newsletter", "Your e-mail", "Search", "Log in", "Password", "Send", "Sign up", "Share",
         "Suche", "Rechercher", "Buscar", "Tweet", "Leave a reply"]
FOOTERS = ["© 2020 {0}. All rights reserved.", "Copyright {0}", "Privacy policy · Terms · Contact", "© {0} · Impressum"]
REPLIES = ["{0} says:", "Reply", "3 comments", "Posted by {0} 2 days ago", "Great post, thanks!", "Report"]

#: Layouts made of each labelled page, and the share whose article is written carelessly.
VARIANTS, ROUGH = 6, 0.3


def _element(kind: str, inner: str, label: str | None = None) -> str:
    tag = kind.split()[0]
    mark = f' data-label="{label}"' if label else ""
    return f"<{kind}{mark}>{inner}</{tag}>"


class Layout:
    """Rebuilds a page from its article's blocks and its other texts, by a seeded choice of parts."""

    def __init__(self, seed: int, article: list[tuple[str, str]], other: list[str]):
        self.rng = random.Random(seed)
        self.article = [(t if t in ("h1", "h2", "h3", "p", "li", "blockquote", "pre") else "p", x) for t, x in article]
        self.other = other or ["Read more"]
        if self.rng.random() < ROUGH:
            self.article = [(t, self._rough(x)) for t, x in self.article]

    def _rough(self, text: str) -> str:
        """A text without capitals and closing marks, cut short, or of one word over and over: an
        article is told by its place, however it is written."""
        words = text.lower().rstrip(".!?").split()
        return " ".join(self.rng.choice([words, words[:self.rng.randint(1, 6)], words[:1] * self.rng.choice([2, 9, 200])]))

    def _some(self, texts: list[str]) -> str:
        return html.escape(self.rng.choice(texts).format(html.escape(self.rng.choice(self.other))[:40].replace("{", "")))

    def _sentence(self) -> str:
        """A text like the article's, which only its place tells apart."""
        words = self.rng.choice(self.article + [("p", x) for x in self.other])[1].split() or ["More"]
        at = self.rng.randrange(len(words))
        return html.escape(" ".join(words[at:at + self.rng.choice([3, 8, 20, 60])]))

    def menu(self) -> str:
        words = [self.rng.choice([html.escape(self.rng.choice(self.other))[:20], self.rng.choice(MENU_WORDS)])
                 for _ in range(self.rng.randint(2, 8))]
        if self.rng.random() < 0.3:
            return _element(self.rng.choice(MENU), " | ".join(f"<a href=/>{w}</a>" for w in words), "other")
        inner = "".join(f"<li><a href='/x'>{w}</a></li>" for w in words)
        return _element(self.rng.choice(MENU), f"<ul>{inner}</ul>", "other")

    def around(self, kinds: list[str], texts: list[str] | None) -> str:
        inner = ""
        for _ in range(self.rng.choice([1, 1, 2, 3])):
            text = self._some(texts) if texts and self.rng.random() < 0.6 else self._sentence()
            inner += self.rng.choice(["<p>{}</p>", "<div>{}</div>", "{}<br>", "<h4>{}</h4>", "<a href=#>{}</a>", "<li>{}</li>",
                                      "<p><b>{}</b></p>"]).format(text)
        return _element(self.rng.choice(kinds), inner, "other")

    def part(self) -> str:
        kinds, texts = self.rng.choice([(SIDE, None), (NOTICE, NOTICES), (ADVERT, None), (FORM, FORMS), (COMMENTS, REPLIES)])
        return self.around(kinds, texts)

    def page(self) -> str:
        rng, body = self.rng, []
        for at, (tag, text) in enumerate(self.article):
            if at and rng.random() < 0.1:
                body.append(self.part())
            text = html.escape(text)
            if rng.random() < 0.15 and " " in text:
                first, last = text.split(" ", 1)
                text = rng.choice(["<a href=/y>{}</a> {}", "<b>{}</b> {}", "<em>{}</em> {}"]).format(first, last)
            body.append(rng.choice([f"<{tag}>{text}</{tag}>", f"<{tag}>{text}"] + (
                [f"<div>{text}</div>"] if tag == "p" else [])))
        if rng.random() < 0.4:
            body.append(self.part())
        article = _element(rng.choice(ARTICLE), "".join(body), "main")
        before = [self.menu()] + [self.part() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.6:
            before.append(self.around(HEADER, MENU_WORDS))
        rng.shuffle(before)
        after = [self.part() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.6:
            after.append(self.around(COMMENTS, REPLIES))
        after.append(self.around(FOOTER, FOOTERS))
        inner = "".join(before) + article + "".join(after)
        if rng.random() < 0.4:
            inner = f"<div class={rng.choice(['wrapper', 'container', 'page', 'row', 'site'])}>{inner}</div>"
        return f"<html><body>{inner}</body></html>"
