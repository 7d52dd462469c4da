"""Main content of a page: blocks, their density, the best stretch of them, and Markdown.

A page becomes a sequence of blocks (paragraphs, headings, list items, table
rows, quotes, code).  Each block has a value: its words outside links, less
three times those inside, less a fixed cost that short blocks don't earn back
(blocks of an article or main element have no such cost).  Navigation and
elements whose class or id says that they are no content have a value below
zero always.  The content is the stretch of blocks whose values add up to the
most: one pass finds it, as for a subsequence of greatest sum.  Inside it, what
consists of links alone or lies beside the content is left out.
"""

from __future__ import annotations

import re

BESIDE = ("nav", "footer", "aside", "header", "form")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
UNSEEN = ("script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "button", "textarea")
STRONG, SLANTED, CODE = ("b", "strong"), ("i", "em", "cite"), ("code", "kbd", "samp", "tt")
#: Elements that end the line of text before and after them.
FLOW = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", *HEADINGS, "header", "hr", "html", "li", "main",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption",
)
#: Of these, elements that make a table's row a piece of layout and not of data.
LAYOUT = tuple(t for t in FLOW if t not in ("tr", "tbody", "tfoot", "thead", "caption"))
#: Elements whose text is a paragraph of its own; text in others is loose.
HOLDERS = ("p", "li", "td", "th", "blockquote", "dd", "dt", "figcaption", *HEADINGS)
#: Words of a class or id that mark what is no content.
BESIDE_WORDS = frozenset(("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "cookie", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"))
COST, LINK_WEIGHT, CHARS_A_WORD = 4, 3, 6
SPACES = re.compile(r"[ \t\n\r\f]+")
SPECIAL = re.compile(r"([\\`*_\[\]<])")
LINE_HEAD, LINE_NUMBER = re.compile(r"^(#{1,6}|[>+-])( |$)"), re.compile(r"^(\d+)([.)] )")
BREAK = "\n"


class Block:
    """One block: its kind (p, h1 to h6, li, row, pre, div if loose), plain text, Markdown, weights in words, and where it lies."""

    __slots__ = ("beside", "inside", "kind", "linked", "markdown", "quotes", "text", "words")

    def __init__(self, kind: str, text: str, markdown: str, words: int, linked: int, beside: bool, inside: bool, quotes: int):
        self.kind, self.text, self.markdown, self.words, self.linked, self.beside, self.inside, self.quotes = kind, text, markdown, words, linked, beside, inside, quotes

    def value(self) -> int:
        if self.beside:
            return -COST - self.words - self.linked
        if self.kind in HEADINGS and not self.linked:
            return 0
        return self.words - LINK_WEIGHT * self.linked - (0 if self.inside else COST)


def weight(text: str) -> int:
    """Words of a text; scripts without spaces count a word for so many characters."""
    return max(len(text.split()), len(text.strip()) // CHARS_A_WORD)


def is_beside(node) -> bool:
    """Whether an element's tag, class or id says that it is no content."""
    if node.tag in BESIDE:
        return True
    named = f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}".lower()
    return named != " " and not BESIDE_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", named))


def events(root):
    """(True, node or text) on the way in and (False, node) on the way out, in the order of the document; without recursion."""
    stack = [(root, iter(root.children))]
    while stack:
        node, children = stack[-1]
        for child in children:
            if isinstance(child, str):
                yield True, child
            elif child.tag not in UNSEEN:
                yield True, child
                stack.append((child, iter(child.children)))
                break
        else:
            stack.pop()
            if stack:
                yield False, node


def layout_rows(root) -> set[int]:
    """Rows of tables that hold other blocks."""
    rows, found = [], set()
    for entering, node in events(root):
        if isinstance(node, str):
            continue
        if entering and rows and node.tag in LAYOUT:
            found.add(id(rows[-1]))
        if node.tag == "tr":
            if entering:
                rows.append(node)
            elif rows:
                rows.pop()
    return found


class Line:
    """Text with its styles, until a block ends it."""

    def __init__(self):
        self.runs: list[tuple[str, tuple[str, ...], bool]] = []

    def add(self, text: str, styles: tuple[str, ...], linked: bool) -> None:
        if self.runs and self.runs[-1][1:] == (styles, linked):
            self.runs[-1] = (self.runs[-1][0] + text, styles, linked)
        else:
            self.runs.append((text, styles, linked))

    def lines(self) -> list[list[tuple[str, tuple[str, ...], bool]]]:
        """Runs of each line, spaces collapsed across runs, none at either end."""
        out, line, spaced = [], [], True
        for text, styles, linked in self.runs:
            for i, part in enumerate(text.split("\0")):
                if i:
                    out.append(line)
                    line, spaced = [], True
                part = SPACES.sub(" ", part)
                if spaced:
                    part = part.lstrip(" ")
                if part:
                    spaced = part.endswith(" ")
                    line.append((part, styles, linked))
        out.append(line)
        for line in out:
            if line:
                line[-1] = (line[-1][0].rstrip(" "), *line[-1][1:])
        return [[r for r in line if r[0]] for line in out if any(r[0] for r in line)]

    def shown(self) -> tuple[list[str], list[str], int, int]:
        """Plain lines, Markdown lines, and the weights outside and inside links."""
        plain, marked, words, linked = [], [], 0, 0
        for line in self.lines():
            plain.append("".join(r[0] for r in line))
            marked.append(markdown_line(line))
            words += weight("".join(r[0] for r in line if not r[2]))
            linked += weight("".join(r[0] for r in line if r[2]))
        return plain, marked, words, linked


def markdown_line(runs: list[tuple[str, tuple[str, ...], bool]]) -> str:
    """Inline Markdown of one line: marks close where a style ends, spaces stay outside marks, special characters are escaped."""
    out, open_ = [], []
    for i, (text, styles, _) in enumerate(runs):
        keep = 0
        while keep < len(open_) and keep < len(styles) and open_[keep] == styles[keep]:
            keep += 1
        tail = ""
        if len(open_) > keep and out and out[-1].endswith(" "):
            out[-1], tail = out[-1][:-1], " "
        out += reversed(open_[keep:])
        open_ = open_[:keep]
        lead = " " if text.startswith(" ") else tail
        body = text.strip(" ")
        if not body:
            out.append(lead or " ")
            continue
        out += [lead, *styles[keep:]]
        open_ += styles[keep:]
        code = "`" in styles
        out.append((body if code else SPECIAL.sub(r"\\\1", body)) + (" " if text.endswith(" ") else ""))
    line = "".join([*out, *reversed(open_)])
    return LINE_NUMBER.sub(r"\1\\\2", LINE_HEAD.sub(r"\\\1\2", line))


class Walk:
    """Collects the blocks of a page."""

    def __init__(self, root):
        self.blocks: list[Block] = []
        self.line, self.styles, self.links, self.beside, self.inside, self.quotes, self.pre = Line(), [], 0, 0, 0, 0, 0
        self.lists, self.cells, self.layout = [], None, layout_rows(root)
        #: Elements that hold text, as far as they are open: [tag, blocks so far].
        self.holders: list[list] = []
        self.code: list[str] = []
        for entering, node in events(root):
            if isinstance(node, str):
                self.text(node)
            elif entering:
                self.enter(node)
            else:
                self.leave(node)
        self.flush()

    def text(self, text: str) -> None:
        if self.pre:
            self.code.append(text)
        else:
            self.line.add(text.replace("\0", " "), tuple(self.styles), self.links > 0)

    def style(self, tag: str) -> str | None:
        return "**" if tag in STRONG else "*" if tag in SLANTED else "`" if tag in CODE else None

    def enter(self, node) -> None:
        tag = node.tag
        if tag == "br":
            self.text("\n") if self.pre else self.line.add("\0" if self.cells is None else " ", tuple(self.styles), self.links > 0)
        elif tag == "a":
            self.links += "href" in node.attrs
        elif (mark := self.style(tag)) and not self.pre:
            if mark not in self.styles:
                self.styles.append(mark)
            else:
                self.styles.append("")
        if self.cells is not None:
            if tag in ("td", "th"):
                self.cell()
            return
        if tag in FLOW or tag in ("td", "th"):
            self.flush()
        if tag == "tr" and id(node) not in self.layout:
            self.cells = []
        elif tag == "pre":
            self.pre += 1
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
        elif tag == "blockquote":
            self.quotes += 1
        if tag in HOLDERS:
            self.holders.append([tag, 0])
        self.beside += is_beside(node)
        self.inside += tag in ("article", "main")

    def leave(self, node) -> None:
        tag = node.tag
        if tag == "a":
            self.links -= "href" in node.attrs
        elif self.style(tag) and not self.pre and self.styles:
            self.styles.pop()
        if self.cells is not None:
            if tag == "tr":
                self.row()
            return
        if tag in FLOW or tag in ("td", "th"):
            self.flush()
        if tag == "pre":
            self.pre -= 1
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "blockquote":
            self.quotes -= 1
        if tag in HOLDERS and self.holders:
            self.holders.pop()
        self.beside -= is_beside(node)
        self.inside -= tag in ("article", "main")

    def add(self, kind: str, text: str, markdown: str, words: int, linked: int) -> None:
        self.blocks.append(Block(kind, text, markdown, words, linked, self.beside > 0, self.inside > 0, self.quotes))

    def flush(self) -> None:
        """End the block that is open."""
        if self.code:
            text = "".join(self.code).strip("\n")
            self.code = []
            if text.strip():
                fence = "`" * max(3, 1 + max(map(len, re.findall(r"`+", text)), default=0))
                self.add("pre", text, f"{fence}\n{text}\n{fence}", weight(text), 0)
        line, self.line = self.line, Line()
        plain, marked, words, linked = line.shown()
        if not plain:
            return
        item = next((h for h in reversed(self.holders) if h[0] == "li" or h[0] in HEADINGS), None)
        kind = item[0] if item else "p" if self.holders else "div"
        if kind == "li":
            ordered, number = self.lists[-1] if self.lists else ("ul", 0)
            head = f"{number}. " if ordered == "ol" else "- "
            margin = "  " * (len(self.lists) - 1)
            marked = [margin + (" " * len(head) if item[1] else head) + marked[0], *(margin + " " * len(head) + m for m in marked[1:])]
            item[1] += 1
            self.add(kind, "\n".join(plain), "  \n".join(marked), words, linked)
        elif kind in HEADINGS:
            self.add(kind, " ".join(plain), f"{'#' * int(kind[1])} {' '.join(marked)}", words, linked)
        else:
            self.add(kind, "\n".join(plain), "  \n".join(marked), words, linked)

    def cell(self) -> None:
        """End a row's cell and begin the next; what comes before the first cell has nothing in it, or counts as one."""
        line, self.line = self.line, Line()
        if self.cells or line.lines():
            self.cells.append(line)
        elif self.cells == []:
            self.cells = [None]

    def row(self) -> None:
        if self.cells != [] or self.line.lines():
            self.cells.append(self.line)
        shown = [line.shown() for line in self.cells if line is not None]
        self.line, self.cells = Line(), None
        plain = [" ".join(s[0]) for s in shown]
        if any(plain):
            marked = " | ".join(" ".join(s[1]).replace("|", "\\|") for s in shown)
            self.add("row", "\t".join(plain), f"| {marked} |", sum(s[2] for s in shown), sum(s[3] for s in shown))


def best_stretch(values: list[int]) -> tuple[int, int]:
    """The stretch (start, end) of the greatest sum above zero, the first of equals and as far to the left as it can; (0, 0) if there is none."""
    best, found, total, start = 0, (0, 0), 0, 0
    for i, value in enumerate(values):
        if total < 0:
            total, start = 0, i
        total += value
        if total > best:
            best, found = total, (start, i + 1)
    return found


def content_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the best stretch that are content; if none pays, all that aren't loose, beside the content or links alone."""
    start, end = best_stretch([b.value() for b in blocks])
    chosen = blocks[start:end] or [b for b in blocks if b.kind != "div"]
    return [b for b in chosen if not b.beside and (b.words or b.kind in HEADINGS)]


def render(blocks: list[Block]) -> str:
    """Markdown: items of a list and rows of a table stay together, a rule follows a table's first row, quotes are marked."""
    out, last = [], None
    for b in blocks:
        lines = b.markdown.split("\n")
        if b.kind == "row" and (last is None or last.kind != "row"):
            lines.append("|" + " --- |" * (len(re.findall(r"(?<!\\)\|", b.markdown)) - 1))
        quote = "> " * b.quotes
        tight = last is not None and b.kind == last.kind and b.kind in ("li", "row") and b.quotes == last.quotes
        if last is not None:
            out.append("\n" if tight else "\n\n")
        out.append("\n".join(quote + line for line in lines))
        last = b
    return "".join(out)


def main_content(root) -> tuple[str | None, str | None]:
    """Plain text and Markdown of a page's content; null if there is none."""
    blocks = content_blocks(Walk(root).blocks)
    return "\n".join(b.text for b in blocks) or None, render(blocks) or None
