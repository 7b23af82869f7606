"""Text of web pages as a reader sees it.

A page is cut into tags and text by one pattern and built into a tree with the
tags that HTML implies: a block ends an open paragraph, an item ends the item
before it, a row ends cells and rows, and void elements have no content. A
visibility pass leaves out what a browser doesn't show: scripts, styles, heads,
templates, elements hidden by attribute, by their style or by a simple rule of a
style sheet (the cascade decides), closed details and dialogs. The rest is laid out in lines: blocks
apart, lists with marks and indents, preformatted text as it is, and tables with
cells aligned in columns, spans included.

Defined results: a null or empty page has empty text; broken markup never fails,
unknown tags are inline, and unclosed ones end with their parent; repeated rows
give equal texts; tables may be nested to any depth.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, with_columns_from

# The elements of HTML by how they are parsed and shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript title meta link base object iframe audio video canvas desc defs metadata symbol clippath mask pattern marker annotation annotation-xml datalist noembed noframes area param source track".split())
APART = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure form fieldset hr details menu dir".split())
BLOCK = APART | set("html body div section article aside header footer nav main address li dt dd tr td th thead tbody tfoot caption figcaption summary legend option optgroup center dialog search hgroup".split())
ENDS_P = (BLOCK - set("html body tr td th thead tbody tfoot caption option optgroup legend".split())) | {"xmp"}
BLOCK.add("text")  # of a drawing: each stands at its own place
#: Inputs that show no value, or dots instead.
WORDLESS = set("hidden password checkbox radio file image color range".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPES = {"table", "td", "th", "caption", "html", "body", "template", "button", "object"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PARTS = re.compile(r"([.#]?)((?:[\w-]|[^\x00-\x7f])+|\*)")
_PSEUDO = re.compile(r"::?[\w-]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?|\[[^\]]*\]")
#: A page at rest is in none of these states, and what they make is no element.
_MOMENTARY = re.compile(r"::|:(?:hover|focus|active|target|checked|visited|before|after|first-l|popover-open|fullscreen|-)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs, [], False


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page (text as str children) and its style sheets."""
    root = Node("#root", {})
    stack, sheets, at = [root], [], 0

    def close(tags: set, stop: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return close(tags, stop)
            if stack[i].tag in stop:
                return None
        return None

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        attrs = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(m[3])} if m[3].strip("/ \n\t") else {}
        if tag in ENDS_P:
            close({"p"}, SCOPES)
        if tag in CLOSES:
            close(*CLOSES[tag])
        node = Node(tag, attrs)
        node.foreign = tag in ("svg", "math") or stack[-1].foreign and tag != "foreignobject"
        stack[-1].children.append(node)
        if node.foreign and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            content = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if tag == "style":
                sheets.append(f"@media {attrs['media']}{{{content}}}" if attrs.get("media") else content)
            elif tag in ("textarea", "xmp"):
                node.children.append(html.unescape(content) if tag == "textarea" else content)
        elif tag not in VOID:
            stack.append(node)
    return root, sheets


def _blocks(sheet: str):
    """(what stands before it, body) of each block of a sheet; statements that end with ';' are left out."""
    before, at, depth = 0, 0, 0
    for m in re.finditer(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", sheet):
        if m[0] == ";" and not depth:
            before = m.end()
        elif m[0] == "{":
            depth += 1
            if depth == 1:
                at = m.end()
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                yield sheet[before : at - 1].strip(), sheet[at : m.start()]
                before = m.end()
        elif m[0] == "}":
            before = m.end()
    if depth:
        yield sheet[before : at - 1].strip(), sheet[at:]


def _own(body: str) -> str:
    """The declarations of a rule, without rules nested in it."""
    while "{" in body:
        short = re.sub(r"[^{};]*\{[^{}]*\}", "", body)
        if short == body:
            return body[: body.index("{")]
        body = short
    return body


def hiding_rules(sheets: list[str]) -> list[tuple]:
    """(weight, tag, classes, ids, property, value) of the selectors that hide or show, by falling weight.

    Where it isn't sure that a rule holds (under a condition, or with a selector
    that looks at more than the element), it may show an element but not hide it.
    """
    out: list[tuple] = []
    todo = [(_blocks(re.sub(r"/\*.*?\*/|<!--|-->", "", sheet, flags=re.S).lower()), True) for sheet in reversed(sheets)]
    while todo:
        blocks, sure = todo[-1]
        head, body = next(blocks, (None, ""))
        if head is None:
            todo.pop()
        elif head.startswith("@"):
            kind, rest = re.match(r"(@[\w-]*)(.*)", head, re.S).groups()
            media = [x.strip() for x in rest.split(",")]
            if kind == "@media" and all(re.match(r"(only\s+)?(print|speech)\b|not\s+(all|screen)\s*$", x) for x in media):
                continue
            if kind in ("@media", "@supports", "@container", "@scope", "@layer", "@document", "@starting-style"):
                holds = kind == "@layer" or kind == "@media" and any(re.fullmatch(r"(only\s+)?(all|screen)|not\s+print", x) for x in media)
                todo.append((_blocks(body), sure and holds))
        else:
            found = _declared(_own(body))
            for selector in re.split(r",(?![^(\[]*[)\]])", head) if found else ():
                selector = selector.strip()
                if not selector or _MOMENTARY.search(selector):
                    continue
                plain = _PSEUDO.sub("", selector)
                last = re.split(r"[\s>+~]+", plain)[-1]
                simple = selector == last
                parts = _PARTS.findall(last)
                if "".join(a + b for a, b in parts) != last or not simple and not parts:
                    continue
                every = _PARTS.findall(plain)
                weight = (sum(a == "#" for a, _ in every), sum(a == "." for a, _ in every) + len(_PSEUDO.findall(selector)), sum(not a and b != "*" for a, b in every))
                tag = next((b for a, b in parts if not a and b != "*"), "")
                classes, ids = [b for a, b in parts if a == "."], [b for a, b in parts if a == "#"]
                for name, (value, important) in found.items():
                    if value in ("shown", "visible") or sure and simple:
                        out.append(((important, *weight, len(out)), tag, classes, ids, name, value))
    return sorted(out, key=lambda r: r[0], reverse=True)


def _declared(style: str) -> dict[str, tuple[str, bool]]:
    """What declarations say of 'display' ('none' or 'shown') and 'visibility' ('hidden' or 'visible'), and whether it is important."""
    out: dict[str, tuple[str, bool]] = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        name, (value, _, mark) = name.strip(), value.strip().partition("!")
        value = value.strip()
        if name not in ("display", "visibility") or not value or value in ("inherit", "unset", "revert", "revert-layer") or out.get(name, ("", False))[1] and not mark:
            continue
        how = ("none" if value == "none" else "shown") if name == "display" else "hidden" if value in ("hidden", "collapse") else "visible"
        out[name] = how, bool(mark)
    return out


def state(node: Node, rules: list) -> str:
    """'none' (not shown at all), 'hidden' (own text not shown), 'visible' or '' (as its parent)."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return "none"
    own = _declared(a["style"]) if "style" in a else {}
    if rules:
        classes, name = a.get("class", "").lower().split(), a.get("id", "").lower()
        best: dict[str, tuple[str, bool]] = {}
        for weight, tag, needs, ids, what, value in rules:
            if what not in best and (not tag or tag == node.tag) and all(c in classes for c in needs) and all(i == name for i in ids):
                best[what] = value, weight[0]
        for what, (value, important) in best.items():
            if what not in own or important and not own[what][1]:
                own[what] = value, important
    if own.get("display", ("none" if "hidden" in a else "", False))[0] == "none":
        return "none"
    return own.get("visibility", ("", False))[0]


class Lines:
    """Lines of text with collapsed spaces and margins."""

    def __init__(self):
        self.lines, self.line, self.space, self.gap = [], [], False, 0

    def text(self, s: str, as_is: bool) -> None:
        if as_is:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.end_line()
                if part:
                    self.open()
                    self.line.append(part)
            return
        s = _SPACE.sub(" ", s)
        if s.startswith(" "):
            self.space = True
        if core := s.strip(" "):
            self.open()
            self.line.append((" " if self.space and self.line else "") + core)
            self.space = s.endswith(" ")

    def open(self) -> None:
        if not self.line and self.gap:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0

    def end_line(self) -> None:
        """A line break: an empty line counts."""
        self.open()
        self.lines.append("".join(self.line))
        self.line, self.space = [], False

    def block(self, margin: int) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False
        self.gap = max(self.gap, margin)

    def add(self, lines: list[str], margin: int) -> None:
        self.block(margin)
        if lines:
            self.open()
            self.lines += lines
            self.gap = margin

    def all(self) -> list[str]:
        self.block(0)
        return self.lines


def _number(value: str, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,6})", value or "")
    return int(m[1]) if m else default


def _grid(node: Node, rules: list, seen: bool):
    """A table's lines: a caption, then rows whose cells are padded to their columns' widths."""
    caption, rows, todo = [], [], [(c, seen) for c in reversed(node.children)]
    while todo:
        child, shown = todo.pop()
        if not isinstance(child, Node):
            if child.strip() and shown:  # text beside the cells is shown before the table
                caption += (yield _lines([child], rules, shown))
            continue
        how = state(child, rules)
        if how == "none":
            continue
        shown = shown if not how else how == "visible"
        if child.tag == "caption":
            caption += (yield _lines(child.children, rules, shown))
        elif child.tag == "tr":
            rows.append([(c, shown) for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and state(c, rules) != "none"])
            for c in child.children:
                if not isinstance(c, Node) and c.strip() and shown:
                    caption += yield _lines([c], rules, shown)
        elif child.tag in ("td", "th"):
            if not rows or rows[-1] is None:
                rows.append([])
            rows[-1].append((child, shown))
        elif child.tag in ("thead", "tbody", "tfoot", "form"):
            todo += [(c, shown) for c in reversed(child.children)]
        elif child.tag not in ("colgroup", "col"):
            caption += (yield _lines([child], rules, shown))
    taken, cells, width = set(), [], {}
    for r, row in enumerate(rows):
        c = 0
        for cell, shown in row:
            while (r, c) in taken:
                c += 1
            across, down = max(1, min(_number(cell.attrs.get("colspan"), 1), 1000)), max(1, min(_number(cell.attrs.get("rowspan"), 1), len(rows) - r))
            how = state(cell, rules)
            lines = (yield _lines(cell.children, rules, shown if not how else how == "visible"))
            cells.append((r, c, across, lines))
            taken.update((r + i, c + j) for i in range(down) for j in range(across))
            if across == 1:
                width[c] = max(width.get(c, 0), max(map(len, lines), default=0))
            c += across
    out, by_row, begins = [], [[] for _ in rows], [0]
    for cell in cells:
        by_row[cell[0]].append(cell)
    for j in range(max(width, default=-1) + 1 + max((c for _, c, _, _ in cells), default=0)):
        begins.append(begins[-1] + width.get(j, 0) + 2)
    for own in by_row:
        for k in range(max((len(x[3]) for x in own), default=0)):
            line = ""
            for _, c, _, lines in own:
                at = begins[c]
                line = line.ljust(at) if len(line) <= at or not line else line + "  "
                line += lines[k] if k < len(lines) else ""
            out.append(line.rstrip())
    return caption + out


def render_lines(nodes: list, rules: list, shown: bool = True) -> list[str]:
    """Lines of a run of nodes. Cells and tables ask for what is inside them by ``yield``, so that no depth exhausts Python's stack."""
    open_, lines = [_lines(nodes, rules, shown)], None
    while open_:
        try:
            open_.append(open_[-1].send(lines))
            lines = None
        except StopIteration as done:
            open_.pop()
            lines = done.value
    return lines


def _lines(nodes: list, rules: list, shown: bool):
    """Lines of a run of nodes, walked with its own stack."""
    out = Lines()
    marks: list[list] = []  # open lists: [ordered, next number, step]
    outer: list[tuple[Lines, str]] = []  # indented blocks being built: what they go to, and their mark
    todo: list[tuple] = [("enter", n, shown, False) for n in reversed(nodes)]
    while todo:
        what, node, shown, as_is = todo.pop()
        if what == "leave":
            tag = node.tag
            if tag in ("ul", "ol", "menu", "dir"):
                marks.pop()
            if tag in ("li", "blockquote", "dd"):
                inner = out.all()
                out, mark = outer.pop()
                pad = " " * len(mark)
                if inner or tag == "li" and shown:
                    inner = inner or [""]
                    out.add([(mark + inner[0]).rstrip(), *[(pad + x).rstrip() for x in inner[1:]]], 2 if tag == "blockquote" else 1)
            elif tag == "q":
                if shown:
                    out.text("”", False)
            elif tag in BLOCK:
                out.block(1 if tag not in APART or marks and tag in ("ul", "ol") else 2)
            continue
        if not isinstance(node, Node):
            if shown:
                out.text(node, as_is)
            continue
        tag, how = node.tag, state(node, rules)
        if how == "none":
            continue
        if how:
            shown = how == "visible"
        if tag == "br":
            out.end_line()
            continue
        if tag == "table":
            out.add((yield _grid(node, rules, shown)), 2)
            continue
        if tag == "input":
            if shown and node.attrs.get("type", "").lower() not in WORDLESS:
                out.text(node.attrs.get("value", ""), False)
            continue
        if tag == "select":
            options = [c for o in node.children if isinstance(o, Node) for c in ([o] if o.tag == "option" else [x for x in o.children if isinstance(x, Node)])]
            chosen = [o for o in options if "selected" in o.attrs] or options[: 1 if "multiple" not in node.attrs else None]
            for o in reversed(chosen):
                todo += [("enter", " ", shown, as_is), *[("enter", c, shown, as_is) for c in reversed(o.children)]]
            continue
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        as_is = as_is or tag in ("pre", "textarea", "xmp", "listing")
        if tag in BLOCK:
            out.block(1 if tag not in APART or marks and tag in ("ul", "ol") else 2)
        if tag in ("ul", "ol", "menu", "dir"):
            marks.append([tag == "ol", _number(node.attrs.get("start"), 1), -1 if "reversed" in node.attrs else 1])
        if tag in ("li", "blockquote", "dd"):
            mark = "  "
            if tag == "li":
                mark = "- "
                if marks and marks[-1][0]:
                    number = _number(node.attrs.get("value"), marks[-1][1])
                    mark, marks[-1][1] = f"{number}. ", number + marks[-1][2]
            outer.append((out, mark))
            out = Lines()
        if tag == "q" and shown:
            out.text("“", False)
        if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        todo.append(("leave", node, shown, as_is))
        todo += [("enter", c, shown, as_is) for c in reversed(children)]
    return out.all()


def visible_text(page: str) -> str:
    """All visible text of a page, laid out in lines."""
    root, sheets = parse(page)
    lines = [x.replace("\xa0", " ").rstrip() for x in render_lines(root.children, hiding_rules(sheets))]
    return "\n".join(lines).strip("\n")


def rendered(pages: DataFrame, column: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with a column of visible text; and that column's name."""
    out, (name,) = with_columns_from(pages, column, lambda: lambda texts: [pa.array([visible_text(t) for t in texts], pa.string())], [("visible_text", "string")])
    return out, name


def op7_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, n_chars, n_lines and text of every page."""
    out, name = rendered(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.col(name)
    return out.select("page_id", "url", F.length(text).cast("long").alias("n_chars"), F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"), text.alias("text"))
