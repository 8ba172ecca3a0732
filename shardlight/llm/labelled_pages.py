"""Labelled training pages: seeded random layouts whose blocks are marked as article or not by construction."""

from __future__ import annotations

import random

_SYLLABLES = "ta re mi so lu ken dor vel pra chi non est ilo gar und ver que aus".split()
#: What sites call the containers of main text and of each kind of other text.
_MAIN = ["content", "post", "entry", "article", "story", "main", "post-content", "entry-content", "article-body", "text", "body-text", "page-content"]
_OTHER = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toc", "links", "pagination", "tabs"],
    "header": ["header", "masthead", "site-header", "branding", "top", "logo", "hero", "page-header"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "credits", "colophon"],
    "aside": ["sidebar", "side", "aside", "widget", "related", "recommended", "trending", "popular", "tags", "share", "social", "author-box", "more"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "adsense"],
    "notice": ["notice", "cookie", "cookies", "cookie-notice", "consent", "gdpr", "alert", "popup", "modal", "privacy", "announcement", "newsletter", "overlay", "toast"],
    "form": ["form", "search", "login", "signup", "subscribe", "contact", "comment-form", "newsletter-form"],
    "comments": ["comments", "comment", "comment-list", "replies", "discussion", "responses", "disqus", "reader-comments", "reviews", "comment-body", "thread"],
}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "ins", "section"], "notice": ["div", "section", "aside", "dialog"], "form": ["form"], "comments": ["section", "div", "ol", "article"]}


class Page:
    """html and, in the order of its leaf blocks, labels: 1 for article text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[int] = []
        r = self.r
        self.bare = r.random() < 0.12  # a page whose containers have no names
        before = [k for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < 0.45]
        after = [k for k in ("comments", "aside", "ad", "form", "notice", "nav", "footer") if r.random() < 0.45]
        r.shuffle(before)
        self.out.append("<html><head><title>x</title></head><body>")
        wrap = r.random() < 0.3
        if wrap:
            self.out.append(f"<div id={r.choice(['wrapper', 'page', 'container', 'root'])!r}>")
        for kind in before:
            self.other(kind)
        self.main()
        for kind in after:
            self.other(kind)
        self.out.append("</div></body></html>" if wrap else "</body></html>")
        self.html = "".join(self.out)

    def words(self, low: int, high: int) -> str:
        r = self.r
        n = r.randint(low, high)
        text = " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))
        if r.random() < 0.15:
            text = text.upper()
        if r.random() < 0.15:
            text = text.replace(" ", r.choice(["*** ", "!! ", " | ", "### "]))
        return text.capitalize() + r.choice([".", ".", ".", "", "!", ":"])

    def block(self, tag: str, label: int, low: int = 1, high: int = 60, link: float = 0.0) -> None:
        r, text = self.r, self.words(low, high)
        if r.random() < link:
            text = f'<a href="/x">{text}</a>'
        elif r.random() < 0.15:
            text = f"<{(t := r.choice(['b', 'em', 'span', 'strong']))}>{text}</{t}>"
        self.out.append(f"<{tag}>{text}</{tag}>")
        self.labels.append(label)

    def named(self, tag: str, names: list[str], force: bool = False) -> str:
        r = self.r
        if not force and (self.bare or tag not in ("div", "section", "ul", "ol", "ins", "article", "dialog") and r.random() < 0.6):
            return f"<{tag}>"
        name = r.choice(names)
        if r.random() < 0.2:
            name += " " + r.choice(["box", "left", "right", "clearfix", "row", "block", "inner", "wide"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">'

    def other(self, kind: str) -> None:
        r = self.r
        tag = r.choice(_TAGS[kind])
        if self.bare and tag in ("div", "section", "ul", "ol", "ins", "article", "dialog"):
            tag = {"nav": "nav", "header": "header", "footer": "footer", "form": "form"}.get(kind, "aside")
        self.out.append(self.named(tag, _OTHER[kind], tag in ("article", "ol")))
        if kind == "nav":
            inner = "" if tag == "ul" else r.choice(["ul", "ul", ""])
            if inner:
                self.out.append("<ul>")
            for _ in range(r.randint(2, 8)):
                self.block("li" if inner or tag == "ul" else "div", 0, 1, 4, 0.95)
            if inner:
                self.out.append("</ul>")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.block(r.choice(["label", "p", "div", "button", "legend"]) if r.random() < 0.5 else "p", 0, 1, 12)
        elif kind == "comments":
            if r.random() < 0.6:
                self.block(r.choice(["h2", "h3", "h4"]), 0, 1, 3)
            for _ in range(r.randint(1, 5)):
                t = "li" if tag == "ol" else r.choice(["div", "article", "p", "section"])
                if t == "p":
                    self.block("p", 0, 1, 60)
                else:
                    self.out.append(f'<{t} class="{r.choice(_OTHER["comments"])}">')
                    for _ in range(r.randint(1, 2)):
                        self.block(r.choice(["p", "p", "div", "cite", "blockquote"]) if t != "li" else "p", 0, 1, 50)
                    self.out.append(f"</{t}>")
        elif r.random() < 0.35:
            self.out.append(self.words(2, 40))
            self.labels.append(0)
        else:
            for _ in range(r.randint(1, 4)):
                self.block(r.choice(["p", "p", "div", "h2", "h3", "h1", "li"]), 0, 1, 40, 0.4 if kind in ("aside", "footer") else 0.1)
        self.out.append(f"</{tag}>")

    def main(self) -> None:
        r = self.r
        tag = "article" if r.random() < 0.55 or self.bare and r.random() < 0.7 else r.choice(["main", "div", "section", "div", "body"])
        outer = r.random() < 0.25
        if outer:
            self.out.append("<main>" if r.random() < 0.6 else self.named("div", ["content", "main", "container", "primary"]))
        if tag != "body":
            self.out.append(self.named(tag, _MAIN) if tag == "div" or r.random() < 0.4 else f"<{tag}>")
        if r.random() < 0.85:
            head = r.random() < 0.15 and tag == "article"
            self.out.append("<header>" if head else "")
            self.block(r.choice(["h1", "h1", "h2"]), 1, 1, 14)
            self.out.append("</header>" if head else "")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            if x < 0.72 or tag == "body":
                self.block("p", 1, 1, r.choice([4, 20, 80]), 0.03)
            elif x < 0.80:
                self.block(r.choice(["h2", "h3", "h4"]), 1, 1, 8)
            elif x < 0.86:
                t = r.choice(["ul", "ol"])
                self.out.append(f"<{t}>")
                for _ in range(r.randint(1, 4)):
                    self.block("li", 1, 1, 15, 0.1)
                self.out.append(f"</{t}>")
            elif x < 0.89:
                self.block(r.choice(["blockquote", "pre", "figcaption", "td", "div", "dd"]), 1, 1, 30)
            elif not self.bare:
                self.other(r.choice(["ad", "aside", "form", "notice", "nav"]))
        if r.random() < 0.12 and not self.bare and tag != "body":
            self.other("comments")
        if tag != "body":
            self.out.append(f"</{tag}>")
        if outer:
            self.out.append("</main>" if self.out and "<main>" in self.out else "</div>")
