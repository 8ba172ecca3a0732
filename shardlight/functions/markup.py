"""HTML as events and blocks, in one pass over the page whatever it holds: nothing is searched for twice."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

#: Elements without content, elements whose content is no markup, and elements that hold no text of a document.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
DROPPED = frozenset("nav footer aside form head button select svg".split()) | RAW
#: Words of a class or id that say the same of any element.
ADVERTS = frozenset("ad ads advert adverts advertisement sponsored sponsor promo banner cookie cookies newsletter".split())
#: Elements inside a line of text; all others end it.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img wbr".split())
LABELS = {"p": "text", "li": "list_item", "td": "table", "th": "table", "blockquote": "text", "pre": "code", "dt": "list_item", "dd": "list_item", "figcaption": "caption", "caption": "caption"} | {f"h{k}": f"section_header_{k}" for k in range(1, 7)}
#: What an element of the left closes when it begins, unless one of the right stands between.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_LOWER = {k: k + 32 for k in range(65, 91)}


def events(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("open", name, attributes) and ("close", name, {}) in page order, names in lower case.

    Comments, declarations and processing instructions are no events; a comment, tag or raw element that is never
    closed goes to the end of the page; a < that begins none of these is text.
    """
    lower = page.translate(_LOWER)
    at, text, n = 0, [], len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("</", lt)
        name = _NAME.match(lower, lt + 1 + closing)
        if name is None:
            if page.startswith(("<!", "<?", "</"), lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                text.append("<")
                at = lt + 1
            continue
        if joined := "".join(text):
            yield "text", references.unescape(joined), {}
        text, at, attributes = [], name.end(), {}
        while (found := _ATTRIBUTE.match(page, at)) is not None:
            at = found.end()
            attributes.setdefault(found[1].translate(_LOWER), references.unescape(found[2] or found[3] or found[4] or ""))
        end = page.find(">", at)
        at = n if end < 0 else end + 1
        if closing:
            yield "close", name[0], {}
            continue
        yield "open", name[0], attributes
        if name[0] in RAW:
            end = lower.find(f"</{name[0]}", at)
            yield "text", page[at : n if end < 0 else end], {}
            at = n if end < 0 else end
    if joined := "".join(text):
        yield "text", references.unescape(joined), {}


def advert(attributes: dict[str, str]) -> bool:
    words = re.split(r"[^a-z]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    return not ADVERTS.isdisjoint(words)


def blocks(page: str) -> list[tuple[str, str]]:
    """(label, text) of the page's blocks: headings, paragraphs, items of lists, cells of tables, captions, code, and
    what stands outside of these, as text. White space is one blank. What is dropped or an advert is left out, as is a
    page's header, but not one inside an article or main. Elements that are never closed end with what holds them."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool]] = []
    open_: Counter[str] = Counter()
    gone, labels, line = 0, [], []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append((labels[-1] if labels else "text", text))
        line.clear()

    def pop() -> str:
        nonlocal gone
        name, drops = stack.pop()
        if name not in INLINE:
            flush()
        open_[name] -= 1
        gone -= drops
        if name in LABELS:
            labels.pop()
        return name

    for kind, name, attributes in events(page):
        if kind == "text":
            if not gone:
                line.append(name)
        elif kind == "open":
            if name not in INLINE and name != "br":
                # A block ends a paragraph, and some end what stands beside them.
                if open_["p"]:
                    while pop() != "p":
                        pass
                ended, between = CLOSED_BY.get(name, ((), ()))
                if any(open_[x] for x in ended):
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] not in between:
                        if stack[k][0] in ended:
                            while len(stack) > k:
                                pop()
                            break
                        k -= 1
                if not gone:
                    flush()
            if name == "br":
                line.append(" ")
            elif name not in VOID:
                drops = name in DROPPED or advert(attributes) or (name == "header" and not open_["article"] and not open_["main"])
                stack.append((name, drops))
                open_[name] += 1
                gone += drops
                if name in LABELS:
                    # A paragraph in an item, cell or quotation belongs to it.
                    labels.append(labels[-1] if name == "p" and labels else LABELS[name])
        elif open_[name]:
            while pop() != name:
                pass
        elif name == "br":
            line.append(" ")
    flush()
    return out
