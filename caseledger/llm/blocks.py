"""Leaf blocks of HTML, and layouts from which labelled pages are made."""

from __future__ import annotations

import html
import re

import numpy as np

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr").split())
MATH = frozenset(("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt "
                  "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml").split())
INLINE |= MATH
#: These end a block only where they hold text: an icon within a sentence doesn't.
EMBEDDED = frozenset(("svg template noscript textarea select iframe object canvas audio video source track param "
                      "g defs symbol use path rect circle ellipse line polyline polygon text tspan textpath desc metadata lineargradient "
                      "radialgradient stop clippath mask pattern marker filter image view switch foreignobject").split())
#: What these hold is no markup and no text of the page, up to the end tag.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title")}

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>|([^<]++|<)", re.I | re.S)
NAMED = re.compile(r"(class|id|role|data-keep)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[^\W\d_]+")


class Node:
    """An open element and, by its parents, a tag path. Pages share the nodes of equal paths.

    ``fresh`` are the parts (name, class, id and role words) that no element around it has, so
    that the parts of a path are those of its chain, each once, however deep it is nested."""

    __slots__ = ("parent", "kids", "fresh", "tags", "length", "count", "total", "owner")

    def __init__(self, parent: "Node | None", name: str, marks: tuple[str, ...], fresh: tuple[str, ...]):
        self.parent, self.kids, self.fresh = parent, {}, fresh
        self.tags = ((name,) + parent.tags)[:3] if parent else ()  # the last names, innermost first
        self.length = parent.length + 1 + len(marks) if parent else 0
        self.count, self.total, self.owner = 0, None, None  # what a labeller remembers of the path

    def parts(self):
        node = self
        while node is not None:
            yield from node.fresh
            node = node.parent


class Paths:
    """The tree of all paths met so far; begun anew between pages when it has grown large."""

    def __init__(self, most: int = 100_000):
        self.most, self.size, self.root = most, 0, Node(None, "", (), ())

    def start(self) -> Node:
        if self.size > self.most:
            self.size, self.root = 0, Node(None, "", (), ())
        return self.root

    def child(self, node: Node, name: str, marks: tuple[str, ...], seen: dict[str, int]) -> Node:
        key = (name, marks)
        kid = node.kids.get(key)
        if kid is None:
            fresh = tuple(p for p in dict.fromkeys((name, *("." + m for m in marks))) if not seen.get(p))
            kid = node.kids[key] = Node(node, name, marks, fresh)
            self.size += 1
        return kid


_paths = Paths()


class Block:
    __slots__ = ("path", "text", "linked", "keep")

    def __init__(self, path: Node, text: str, linked: float, keep: int):
        self.path, self.text, self.linked, self.keep = path, text, linked, keep


def _marks(attributes: str, made: bool) -> tuple[tuple[str, ...], int | None]:
    marks, keep = [], None
    for m in NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() != "data-keep":
            marks += PART.findall(value.lower())
        elif made:
            keep = int(value)
    return tuple(marks), keep


class _Open:
    """An open element, with what must be known of all around it."""

    __slots__ = ("name", "parts", "node", "keep", "embedded", "anchors", "base")

    def __init__(self, name, parts, node, keep, embedded, anchors, base):
        self.name, self.parts, self.node, self.keep = name, parts, node, keep
        self.embedded, self.anchors, self.base = embedded, anchors, base


def leaf_blocks(page: str, made: bool = False) -> list[Block]:
    """Texts between block boundaries, in page order, character references decoded and
    white space made one space. A path names the open elements and their class, id and role words.
    Only comments and what script, style and title hold are no text.

    ``data-keep`` is read on ``made`` pages only; a given page may use it for anything.
    Work grows with the page's length, however deep elements are nested and whether or not
    tags and elements are closed.
    """
    bottom = _Open("", (), _paths.start(), -1, None, 0, 0)
    stack = [bottom]
    out: list[Block] = []
    held: list[str] = []
    size = linked = 0
    around = None  # what was open around the held text, once an embedded element followed it
    open_names: dict[str, int] = {}  # how many elements of a name are open
    seen: dict[str, int] = {}  # and parts of paths
    last = page.rfind(">")  # a tag that begins behind it never ends

    def flush():
        nonlocal size, linked, around
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                top = stack[-1] if around is None else around
                out.append(Block(top.node, text, linked / max(size, 1), top.keep))
            held.clear()
        size, linked, around = 0, 0, None

    def close(k: int):
        for e in stack[k:]:
            open_names[e.name] -= 1
            for p in e.parts:
                seen[p] -= 1
        del stack[k:]

    at = 0
    while at < len(page):
        m = TOKEN.match(page, at) if at <= last or page[at] != "<" or page.startswith("<!--", at) else None
        text = m[7] if m else "<"
        at = m.end() if m else at + 1
        if text is not None:
            if around is not None and not text.isspace():
                if around.embedded is not stack[-1].embedded:
                    flush()
                around = None
            held.append(text)
            size += len(text)
            if stack[-1].anchors:
                linked += len(text)
            continue
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            if name == "br":
                held.append(" ")
                continue
            if name in EMBEDDED:
                around = stack[-1] if held and around is None else around
            elif name not in RAW:
                flush()
        attributes = m[3] or m[6] or ""
        closed = attributes.rstrip().endswith("/")
        if m[1] or m[4]:
            if open_names.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
        elif name in RAW and not (closed and (open_names.get("svg") or open_names.get("math"))):
            end = RAW[name].search(page, at)
            end = page.find(">", end.end()) if end else -1
            at = end + 1 if end >= 0 else len(page)
        elif name not in VOID:
            if name not in INLINE and name not in EMBEDDED:  # a block ends an open paragraph, and an item its like
                k = stack[-1].base  # the innermost element that isn't inline
                if k and (stack[k].name == "p" or stack[k].name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    close(k)
            marks, keep = _marks(attributes, made) if "=" in attributes else ((), None)
            if not closed or name in INLINE and name not in MATH:
                top = stack[-1]
                node = _paths.child(top.node, name, marks, seen)
                parts = (name, *("." + p for p in marks))
                for p in parts:
                    seen[p] = seen.get(p, 0) + 1
                open_names[name] = open_names.get(name, 0) + 1
                stack.append(_Open(name, parts, node, top.keep if keep is None else keep, object() if name in EMBEDDED else top.embedded,
                                   top.anchors + (name == "a"), top.base if name in INLINE else len(stack)))
    flush()
    return out


# What sites call their parts. {0} is filled with blocks.
CONTENT = ("<article>{0}</article>", "<main>{0}</main>", "<div class=\"content\">{0}</div>", "<div class=\"post\"><div class=\"entry-content\">{0}</div></div>",
           "<main><article class=\"story\">{0}</article></main>", "<div id=\"main\" role=\"main\"><div class=\"article-body\">{0}</div></div>",
           "<section class=\"article text\">{0}</section>", "<body-text><article>{0}</article></body-text>")
AROUND = ("<nav>{0}</nav>", "<header>{0}</header>", "<div class=\"header\" role=\"banner\">{0}</div>", "<footer>{0}</footer>", "<div id=\"footer\">{0}</div>",
          "<aside>{0}</aside>", "<div class=\"sidebar\">{0}</div>", "<div class=\"ad\">{0}</div>", "<div class=\"advert sponsored\">{0}</div>", "<div class=\"ads promo banner\">{0}</div>",
          "<div class=\"cookie-notice\">{0}</div>", "<div class=\"notice alert\" role=\"alert\">{0}</div>", "<form>{0}</form>", "<div class=\"newsletter subscribe\"><form>{0}</form></div>",
          "<div class=\"menu\" role=\"navigation\">{0}</div>", "<ul class=\"breadcrumbs\">{0}</ul>", "<div class=\"related widget\">{0}</div>", "<div class=\"share social\">{0}</div>",
          "<div id=\"comments\">{0}</div>", "<section class=\"comments\"><div class=\"comment reply\">{0}</div></section>", "<div class=\"popup modal consent\">{0}</div>",
          "<div class=\"tags meta\">{0}</div>", "<div class=\"pagination nav\">{0}</div>", "<div class=\"login\"><form>{0}</form></div>")
TEXTUAL = ("<p>{0}</p>", "<p>{0}</p>", "<p>{0}</p>", "<p>{0}", "<p><b>{0}<br>", "<div>{0}</div>", "<blockquote>{0}</blockquote>", "<h2>{0}</h2>", "<li>{0}</li>", "<pre>{0}</pre>",
           "<p><em>{0}</em></p>", "<table><tr><td>{0}</td></tr></table>", "<p>{0} <a href=\"/x\">{1}</a></p>")
LISTED = ("<li><a href=\"/x\">{0}</a></li>", "<li>{0}</li>", "<a href=\"/x\">{0}</a><br>", "<p>{0}</p>", "<span>{0}</span> ", "<label>{0}</label>", "<h3>{0}</h3>", "<div>{0}</div>")
CUES = ("©", "All rights reserved", "Cookies", "Accept", "Subscribe", "Log in", "Reply", "Share", "Advertisement", "Read more", "Privacy", "Terms", "Search", "Menu")


def made_page(rng: np.random.Generator, words: list[str]) -> str:
    """A page of a random layout; ``data-keep`` says which blocks are its main text.
    Words come from one list everywhere, so that they alone tell nothing."""
    def phrase(least, most):
        n = int(np.exp(rng.uniform(np.log(least), np.log(most))))
        return " ".join(words[i] for i in rng.integers(0, len(words), n))

    def part(shape, keep, pieces):
        return f"<div data-keep=\"{keep}\">{shape.format(''.join(pieces))}</div>" if rng.random() < 0.15 else \
            re.sub(r"<([a-z-]+)", rf'<\1 data-keep="{keep}"', shape, count=1).format("".join(pieces))

    def around():
        pieces = []
        long = rng.random() < 0.4
        for _ in range(rng.integers(1, 9)):
            text = phrase(3, 60) if long else phrase(1, 6)
            if rng.random() < 0.15:
                text = f"{CUES[rng.integers(len(CUES))]} {text}"
            pieces.append(LISTED[rng.integers(len(LISTED))].format(text))
        return part(AROUND[rng.integers(len(AROUND))], 0, [f"<ul>{''.join(pieces)}</ul>"] if rng.random() < 0.4 else pieces)

    inside = [f"<h1>{phrase(1, 14)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(int(np.exp(rng.uniform(0, 3.4)))):
        inside.append(TEXTUAL[rng.integers(len(TEXTUAL))].format(phrase(1, 200), phrase(1, 3)))
        if rng.random() < 0.06:
            inside.append(around())
    pieces = [around() for _ in range(rng.integers(0, 5))] + [part(CONTENT[rng.integers(len(CONTENT))], 1, inside)] + [around() for _ in range(rng.integers(0, 4))]
    return f"<html><body>{''.join(pieces)}</body></html>"
