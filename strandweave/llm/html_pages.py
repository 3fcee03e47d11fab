"""Labelled pages for the page model: layouts of common sites with a label per block.

Every page is put together by a seeded generator from parts whose role is known. Words are made up, so the model
learns from tags, attributes and shapes of text only. Names of containers speak on some sites only: on others they are
hashed, missing (often with plain ``div`` for every tag), or mislead, so shapes have to carry the decision there.
"""

from __future__ import annotations

import random

PAGES = 1000
#: How a site names its containers, and how many sites do so.
STYLES = {"plain": 50, "hashed": 20, "missing": 22, "misleading": 8}
_SYLLABLES = "ba co di fu ge ha jo ka le mi no pu ra se ti vo wa xe yu zo an el is or un".split()
_MENU = [("nav", ""), ("nav", "navbar"), ("div", "menu"), ("div", "nav main-nav"), ("ul", "navigation"), ("div", "breadcrumb"), ("div", "topbar"), ("div", "toc")]
_TOP = [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "logo branding")]
_END = [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright legal"), ("div", "bottom")]
_SIDE = [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "recommended"), ("div", "tags"), ("div", "author-bio")]
_NOTE = [("div", "cookie-notice"), ("div", "cookie banner consent"), ("div", "notice"), ("div", "alert popup"), ("div", "gdpr modal"), ("div", "newsletter subscribe"), ("div", "warning message")]
_AD = [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "promo"), ("div", "sponsor sponsored"), ("div", "banner-ad"), ("div", "adsbygoogle")]
_TALK = [("div", "comments"), ("section", "comment-list"), ("div", "comment"), ("ol", "commentlist"), ("div", "reply responses"), ("div", "disqus discussion"), ("section", "reader-comments")]
_SHARE = [("div", "share social"), ("div", "meta byline"), ("p", "byline"), ("div", "pagination pager")]
_BODY = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("section", "story text"), ("div", "post body"), ("div", "main")]


class _Page:
    def __init__(self, seed: int, style: str | None = None):
        self.r = random.Random(seed)
        self.style = style or self.r.choices(list(STYLES), list(STYLES.values()))[0]
        self.html: list[str] = []
        self.states: list[bool] = []

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int, high: int) -> str:
        text = self.words(low, high).capitalize()
        return text + self.r.choice(["."] * 8 + ["!", "?", "", ":"])

    def block(self, tag: str, text: str, main: bool, closed: bool = True) -> None:
        self.html.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if closed else ""))
        self.states.append(main)

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(low, high)}</a>'

    def inside(self, kind: tuple[str, str], fill) -> None:
        tag, name = self.named(*kind)
        attribute = f' {self.r.choice(["class", "class", "id"])}="{name}"' if name else ""
        self.html.append(f"<{tag}{attribute}>")
        fill()
        self.html.append(f"</{tag}>")

    def named(self, tag: str, name: str) -> tuple[str, str]:
        """Tag and name of a container in the style of the site."""
        r = self.r
        if self.style == "hashed":
            name = " ".join(r.choice(["css-", "sc-", "_", "jsx-"]) + "".join(r.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(r.randint(1, 2)))
        elif self.style == "missing":
            name = ""
        elif self.style == "misleading" and r.random() < 0.5:
            name = r.choice(r.choice([_MENU, _TOP, _SIDE, _AD, _BODY, _BODY]))[1]
        if self.style in ("hashed", "missing") and tag not in ("ul", "ol", "p") and r.random() < 0.6:
            tag = "div"
        return tag, name

    def menu(self) -> None:
        for _ in range(self.r.randint(2, 8)):
            self.block("li", self.link(), False)

    def prose(self, main: bool, low: int = 1, high: int = 3, size: tuple[int, int] = (3, 40)) -> None:
        for _ in range(self.r.randint(low, high)):
            self.block(self.r.choice(["p", "p", "div"]), self.sentence(*size), main)

    def bare(self, low: int, high: int) -> None:
        self.html.append(self.sentence(low, high) + (self.link() if self.r.random() < 0.3 else ""))
        self.states.append(False)

    def small(self) -> None:
        self.bare(2, 20) if self.r.random() < 0.6 else self.prose(False, 1, 2, (2, 25))

    def foot(self) -> None:
        if self.r.random() < 0.7:
            sign = self.r.choice(["&copy; ", "&copy; 2020 ", "Copyright "])
            self.html.append(sign + self.words(1, 3) + " &middot; " + self.sentence(3, 30))
            self.states.append(False)
        if self.r.random() < 0.5:
            self.menu()
        if self.r.random() < 0.3:
            self.prose(False)

    def form(self) -> None:
        self.html.append("<form>")
        for _ in range(self.r.randint(1, 3)):
            self.block("label", self.words(1, 4), False)
        self.block("button", self.words(1, 2), False)
        self.html.append("</form>")

    def talk(self) -> None:
        if self.r.random() < 0.5:
            self.block("h3", self.words(1, 3), False)
        for _ in range(self.r.randint(1, 4)):
            if self.r.random() < 0.5:
                self.block("li", self.sentence(2, 40), False)
            else:
                self.prose(False, 1, 2)
        if self.r.random() < 0.3:
            self.form()

    def extra(self) -> None:
        """A part that is not main text."""
        kinds, fill = self.r.choice([(_AD, self.small), (_NOTE, self.small), (_SIDE, self.side), (_SHARE, lambda: self.bare(1, 8)), (_TALK, self.talk)])
        self.inside(self.r.choice(kinds), fill)

    def side(self) -> None:
        self.block(self.r.choice(["h2", "h3", "h4"]), self.words(1, 3), False)
        self.menu() if self.r.random() < 0.5 else self.prose(False)

    def text(self) -> None:
        """The article itself, sometimes with foreign parts inside."""
        if self.r.random() < 0.9:
            self.block(self.r.choice(["h1", "h1", "h2"]), self.words(2, 12).capitalize() + self.r.choice(["", "."]), True)
        for _ in range(self.r.randint(1, 12)):
            x = self.r.random()
            if x < 0.66:
                body = self.sentence(1, 80)
                if self.r.random() < 0.2:
                    body += " " + self.link() + " " + self.sentence(1, 20)
                self.block("p", self.r.choice(["", "", "", "<b>"]) + body + self.r.choice(["", "", "<br>"]), True, self.r.random() < 0.85)
            elif x < 0.73:
                self.block(self.r.choice(["h2", "h3", "h4"]), self.words(1, 6).capitalize(), True)
            elif x < 0.80:
                self.html.append("<ul>")
                for _ in range(self.r.randint(2, 4)):
                    self.block("li", self.sentence(2, 20), True)
                self.html.append("</ul>")
            elif x < 0.84:
                self.block(self.r.choice(["blockquote", "pre", "figcaption"]), self.sentence(3, 30), True)
            elif x < 0.87:
                self.html.append("<table><tr>")
                for _ in range(self.r.randint(2, 4)):
                    self.block("td", self.words(1, 4), True)
                self.html.append("</tr></table>")
            else:
                self.extra()


def labelled_page(seed: int, style: str | None = None) -> tuple[str, list[bool]]:
    """A page and the state of each of its leaf blocks."""
    p = _Page(seed, style)
    r = p.r
    p.html.append("<!DOCTYPE html><html><head>")
    if r.random() < 0.9:
        p.block("title", p.words(2, 10), False)
    p.html.append('<style>p{margin:0}</style><script>var t="<p>";</script></head><body>')
    if r.random() < 0.4:
        p.inside(r.choice(_NOTE), p.small)
    if r.random() < 0.5:
        p.inside(r.choice(_TOP), lambda: p.bare(1, 8))
    if r.random() < 0.8:
        p.inside(r.choice(_MENU), p.menu)
    if r.random() < 0.5:
        p.inside(r.choice(_AD), p.small)
    if r.random() < 0.3:
        p.inside(r.choice(_SIDE), p.side)
    if r.random() < 0.95:
        p.inside(r.choice(_BODY), p.text)
    for _ in range(r.choice([0, 0, 1, 2])):
        p.extra()
    if r.random() < 0.2:
        p.form()
    if r.random() < 0.8:
        p.inside(r.choice(_END), p.foot)
    p.html.append("</body></html>")
    return "".join(p.html), p.states


def labelled_pages(count: int = PAGES, first_seed: int = 0, style: str | None = None) -> list[tuple[str, list[bool]]]:
    return [labelled_page(first_seed + k, style) for k in range(count)]
