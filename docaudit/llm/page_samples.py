"""Labelled pages for training the extractor: seeded layouts whose blocks say whether they belong to the article.

Words are random syllables, so that structure, ancestors and shape are learnt rather than a vocabulary; no feature reads
the few fixed phrases.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pa que ra so ta un ve wi zu".split()
NOTICES = ("We use cookies to improve this site.", "Accept all cookies", "This site uses cookies. Learn more", "Please update your browser.", "Nous utilisons des cookies.", "Diese Seite verwendet Cookies.")
ADVERTS = ("Advertisement", "Sponsored", "Buy now and save", "Limited offer", "Anzeige", "Publicité")
FORMS = ("Subscribe to our newsletter", "Your email", "Search", "Log in", "Sign up", "Name", "Send")
FOOTS = ("&copy; 2020 {w}", "All rights reserved.", "Privacy policy", "Contact | Imprint | Terms", "&copy; {w}.example.com &middot; {s}")
REMARKS = ("Leave a reply", "3 comments", "Reply", "{w} says:", "Posted by {w}")


class _Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.marks: list[tuple[str, int]] = []

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 4, b: int = 18) -> str:
        return self.words(a, b).capitalize() + self.r.choice("...!?")

    def fill(self, phrase: str) -> str:
        return phrase.replace("{w}", self.word()).replace("{s}", self.sentence(3, 9))

    def add(self, text: str) -> None:
        self.html.append(text)

    def block(self, tag: str, text: str, main: int, attrs: str = "") -> None:
        self.add(f"<{tag}{attrs}>{text}" + ("" if tag in ("p", "li") and self.r.random() < 0.05 else f"</{tag}>"))
        self.marks.append((text, main))

    def text(self, a: int = 1, b: int = 8) -> str:
        body = self.sentence(1, 6) if self.r.random() < 0.1 else " ".join(self.sentence() for _ in range(self.r.randint(a, b)))
        if self.r.random() < 0.2:
            i = body.find(" ")
            body = f"{body[:i]} <a href='/{self.word()}'>{self.words(1, 3)}</a>{body[i:]}" if i > 0 else body
        return body

    def links(self, a: int, b: int) -> None:
        self.add("<ul>")
        for _ in range(self.r.randint(a, b)):
            self.block("li", f'<a href="/{self.word()}">{self.words(1, 2)}</a>', 0)
        self.add("</ul>")

    def menu(self) -> None:
        kind = self.r.randrange(4)
        tag, attrs = (("nav", ""), ("div", ' class="menu"'), ("div", ' id="nav-main"'), ("nav", ' class="navbar" role="navigation"'))[kind]
        self.add(f"<{tag}{attrs}>")
        self.links(3, 8)
        self.add(f"</{tag}>")

    def header(self) -> None:
        tag, attrs = self.r.choice((("header", ""), ("div", ' id="header"'), ("div", ' class="site-header masthead"')))
        self.add(f"<{tag}{attrs}>")
        self.block(self.r.choice(("div", "p", "h2", "h1", "span")), self.words(1, 4).title(), 0, ' class="logo"' if self.r.random() < 0.4 else "")
        if self.r.random() < 0.5:
            self.block("p", self.sentence(2, 7), 0)
        if self.r.random() < 0.5:
            self.menu()
        self.add(f"</{tag}>")

    def advert(self) -> None:
        cls = self.r.choice(("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"))
        self.add(f'<{self.r.choice(("div", "aside"))} class="{cls}">')
        if self.r.random() < 0.3:
            self.block("p", self.r.choice(ADVERTS), 0)
        self.block(self.r.choice(("p", "div", "span")), self.sentence(3, 16), 0)
        self.add("</div></aside>"[: 6 if "div" in self.html[-2][:5] or "div" in self.html[-3][:5] else 14])

    def notice(self) -> None:
        cls = self.r.choice(("cookie-banner", "notice", "consent", "alert", "popup modal", "gdpr-notice", "site-notice"))
        self.add(f'<div class="{cls}">')
        self.block("p", self.r.choice(NOTICES) if self.r.random() < 0.7 else self.sentence(), 0)
        if self.r.random() < 0.5:
            self.block("button", "OK", 0)
        self.add("</div>")

    def sidebar(self) -> None:
        tag, attrs = self.r.choice((("aside", ""), ("div", ' class="sidebar"'), ("div", ' id="sidebar-right"'), ("aside", ' class="widget related"'), ("section", ' class="related-posts"')))
        self.add(f"<{tag}{attrs}>")
        self.block(self.r.choice(("h2", "h3", "h4")), self.words(1, 3).title(), 0)
        if self.r.random() < 0.6:
            self.links(2, 6)
        for _ in range(self.r.randint(0, 3)):
            self.block("p", self.sentence(4, 20), 0)
        self.add(f"</{tag}>")

    def form(self) -> None:
        self.add(f'<form action="/{self.word()}"' + self.r.choice(("", ' class="newsletter"', ' id="search"', ' class="login-form"')) + ">")
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(("label", "p", "button", "div")), self.r.choice(FORMS) if self.r.random() < 0.7 else self.words(1, 5), 0)
        self.add('<input type="text"></form>')

    def footer(self) -> None:
        tag, attrs = self.r.choice((("footer", ""), ("footer", ""), ("div", ' id="footer"'), ("div", ' class="site-footer"')))
        self.add(f"<{tag}{attrs}>")
        if self.r.random() < 0.5:
            self.add(self.fill(self.r.choice(FOOTS)))
            self.marks.append(("", 0))
        for _ in range(self.r.randint(0, 3)):
            self.block("p", self.fill(self.r.choice(FOOTS)) if self.r.random() < 0.6 else self.sentence(3, 12), 0)
        if self.r.random() < 0.4:
            self.links(2, 5)
        self.add(f"</{tag}>")

    def comments(self) -> None:
        tag, attrs = self.r.choice((("section", ' class="comments"'), ("div", ' id="comments"'), ("div", ' class="comment-list"'), ("ol", ' class="commentlist"'), ("div", ' class="discussion responses"')))
        self.add(f"<{tag}{attrs}>")
        if self.r.random() < 0.7:
            self.block(self.r.choice(("h2", "h3")), self.fill(self.r.choice(REMARKS)), 0)
        for _ in range(self.r.randint(1, 4)):
            inner = self.r.choice(("article", "div", "li"))
            self.add(f'<{inner} class="comment">')
            if self.r.random() < 0.5:
                self.block("span", self.fill(self.r.choice(REMARKS)), 0)
            self.block("p", self.text(1, 3), 0)
            self.add(f"</{inner}>")
        self.add(f"</{tag}>")

    def article(self) -> None:
        kind = self.r.randrange(8)
        opening, closing = (
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article class='post'>", "</article></main>"), ("<main>", "</main>"),
            ('<div id="content"><div class="entry-content">', "</div></div>"), ('<div class="article-body">', "</div>"), ('<div class="post story">', "</div>"), ("<div>", "</div>"),
        )[kind]
        self.add(opening)
        if self.r.random() < 0.85:
            wrap = self.r.random() < 0.15
            self.add("<header>" if wrap else "")
            self.block("h1", self.words(2, 9).capitalize(), 1)
            self.add("</header>" if wrap else "")
        for _ in range(self.r.randint(1, 9)):
            x = self.r.random()
            if x < 0.08:
                self.block(self.r.choice(("h2", "h3")), self.words(1, 6).capitalize(), 1)
            elif x < 0.13:
                self.add("<ul>")
                for _ in range(self.r.randint(2, 5)):
                    self.block("li", self.sentence(2, 12), 1)
                self.add("</ul>")
            elif x < 0.17:
                self.block("blockquote", self.sentence(), 1)
            elif x < 0.20:
                self.add("<table><tr>")
                for _ in range(3):
                    self.block("td", self.words(1, 3), 1)
                self.add("</tr></table>")
            elif x < 0.25 and self.r.random() < 0.8:
                self.r.choice((self.advert, self.notice, self.form, self.sidebar))()
            elif x < 0.32:
                self.add(f"<p><b>{(t := self.text())}<br>")
                self.marks.append((t, 1))
            else:
                self.block("p", self.text(), 1)
        if self.r.random() < 0.15:
            self.comments()
        self.add(closing)


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """html, and for each leaf block with text in page order: 1 if it belongs to the article."""
    p = _Page(seed)
    before = [x for x in (p.notice, p.header, p.menu, p.advert, p.form) if p.r.random() < 0.45]
    after = [x for x in (p.sidebar, p.comments, p.form, p.advert, p.footer, p.notice) if p.r.random() < 0.5]
    p.add("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style></head><body>")
    outer = p.r.choice(("", "", '<div id="page">', '<div class="wrapper container">'))
    p.add(outer)
    for part in before:
        part()
    if p.r.random() < 0.2:
        p.sidebar()
    if p.r.random() < 0.96:
        p.article()
    for part in after:
        part()
    p.add("</div>" if outer else "")
    p.add("</body></html>")
    return "".join(p.html), [main for _, main in p.marks]
