"""Layout of web pages: implied tags, visibility, lists and tables."""

import pytest

from tessera.llm.layout import op7_layout, rendered, visible_text

CASES = {
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\nd",
    "x <b>y</b>\n  z<br>w": "x y z\nw",
    "<ul><li>one<li>two<ul><li>in</ul><li>three</ul>": "- one\n- two\n  - in\n- three",
    "<ol start=3><li>c<li value=7>g<li>h</ol>": "3. c\n7. g\n8. h",
    "<table><caption>T</caption><tr><th>name<th>n<tr><td>apple<td>12<tr><td>fig<td>3</table>": "T\nname   n\napple  12\nfig    3",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide<td>z</table>": "a  b\n   c\nwide  z",
    "<table><tr><td>1<br>2<td>x</table>": "1  x\n2",
    "<pre>\n a  b\n  c</pre>t": " a  b\n  c\n\nt",
    "<p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p>": "yes",
    "<style>.x{display:none} #i,em{visibility:hidden}</style><p class='a x'>no</p><p id=i>no</p>y<em>no</em>": "y",
    "<head><title>no</title></head><body>yes<script>var a='<p>no</p>'</script><noscript>no</noscript>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>": "s\n\nt\nu",
    "<dl><dt>k<dd>v<dt>l<dd>w</dl>": "k\n  v\nl\n  w",
    "a &amp; b&nbsp;c &lt;d&gt;": "a & b c <d>",
    "<select><option>p<option selected>q</select><input type=submit value=Go><input type=hidden value=no>": "q Go",
    "<blockquote>q1<p>q2</blockquote>r": "  q1\n\n  q2\n\nr",
    "": "",
    "a < b <!-- no --> c <": "a < b c <",
    "<p>unclosed <b>bold<br><p>next": "unclosed bold\n\nnext",
    "<q>w</q>": "“w”",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert visible_text(page) == CASES[page]


def test_deep_and_long_pages():
    assert visible_text("<div>" * 20000 + "x") == "x"
    assert visible_text("<table><tr><td>" * 200 + "x") == "x"
    assert len(visible_text("<p>word " * 50000).split()) == 50000


def test_rows(spark, tmp_path):
    rows = [(1, "u", "<p>a<p>b", "k"), (1, "u", "<p>a<p>b", "k"), (2, None, None, None), (None, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, visible_text string")
    out, name = rendered(df)
    assert name == "_visible_text" and [r[name] for r in out.collect()] == ["a\n\nb", "a\n\nb", "", ""]
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r["page_id"], r["n_chars"], r["n_lines"], r["text"]) for r in op7_layout(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, 4, 3, "a\n\nb"), (1, 4, 3, "a\n\nb"), (2, 0, 0, ""), (None, 0, 0, "")]
    assert rendered(df.limit(0))[0].collect() == []


@pytest.mark.parametrize(
    "page, text",
    {
        "<style>.x{display:none}</style><p class=x style='display:block'>yes</p>": "yes",
        "<style>.tab{display:none} .tab.active{display:block}</style><p class='tab active'>yes<p class=tab>no": "yes",
        "<style>.tab.active{display:flex} .tab{display:none}</style><p class='tab active'>yes<p class=tab>no": "yes",
        "<style>.x{display:none} .x{display:grid}</style><p class=x>yes": "yes",
        "<style>.x{display:none!important}</style><p class=x style='display:block'>no": "",
        "<style>@media print{.nav{display:none}} .y{display:none}</style><p class=nav>yes<p class=y>no": "yes",
        "<style>@media (max-width:600px){.nav{display:none} a{color:red}}</style><p class=nav>yes": "yes",
        "<style media=print>.nav{display:none}</style><p class=nav>yes": "yes",
        "<style>@charset 'a'; @media screen{.nav{display:none}}</style><p class=nav>no": "",
        "<style>.m{display:none} .m:hover{display:block} .open .m{display:block}</style><p class=m>may be": "may be",
        "<style>.m{display:none} li:hover .m{display:block}</style><p class=m>no": "",
        "<svg><defs><text>no</text></defs><path d='M0'/><title>no</title><text>Sales</text><text>2019</text></svg>a<math><mi>x</mi><mo>+</mo><mn>1</mn></math>": "Sales\n2019\nax+1",
        "<input type=email value=a@b><input type=tel value=' 12'><input type=password value=no><input type=checkbox value=no>": "a@b 12",
    }.items(),
)
def test_shown_unless_surely_hidden(page, text):
    assert visible_text(page) == text


def test_tables_nested_to_any_depth_keep_their_columns():
    inner = "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>"
    for depth in (1, 19, 20, 21, 60):
        page = "<table><tr><td>" * depth + inner + "</td></tr></table>" * depth
        assert visible_text(page) == "a    bb\nccc  d"
    assert visible_text("<table><tr><td>" * 3000 + "deep") == "deep"


class Reader:
    """A second reader, of trees instead of tags: blocks as lists of lines, joined with the blank lines between them."""

    APART = {"p", "ul", "ol", "blockquote", "table", "h2"}

    def lines(self, nodes, lists=()):
        done, line, gap, open_ = [], "", 0, False

        def flush():
            nonlocal line, open_
            if open_:
                done.append(line.rstrip())
            line, open_ = "", False

        def put(text):
            nonlocal line, gap, open_
            if not open_:
                if gap and done:
                    done.extend([""] * (gap - 1))
                gap, open_ = 0, True
            line += text

        def margin(n):
            nonlocal gap
            flush()
            gap = max(gap, n)

        def whole(inner, n):
            nonlocal gap
            margin(n)
            if inner:
                if gap and done:
                    done.extend([""] * (gap - 1))
                done.extend(inner)
                gap = n

        def walk(nodes, lists):
            for k in nodes:
                if isinstance(k, str):
                    for word in k.split():
                        put(word if not open_ or not line else " " + word)
                    continue
                tag, children = k
                if tag == "hidden":
                    continue
                if tag == "br":
                    put("")
                    flush()
                elif tag in ("b", "i"):
                    walk(children, lists)
                elif tag in ("ul", "ol"):
                    n = 1 if lists else 2
                    margin(n)
                    for number, item in enumerate(children, 1):
                        mark = f"{number}. " if tag == "ol" else "- "
                        inner = self.lines(item[1], (*lists, tag)) or [""]
                        whole([(mark + inner[0]).rstrip(), *[(" " * len(mark) + x).rstrip() for x in inner[1:]]], 1)
                    margin(n)
                elif tag == "blockquote":
                    whole([("  " + x).rstrip() for x in self.lines(children, lists)], 2)
                elif tag == "table":
                    cells = [[self.lines(c[1]) for c in row[1]] for row in children]
                    width = [max((len(x) for row in cells for x in row[j : j + 1] for x in x), default=0) for j in range(max(map(len, cells)))]
                    grid = []
                    for row in cells:
                        for at in range(max((len(x) for x in row), default=0)):
                            grid.append("  ".join((x[at] if at < len(x) else "").ljust(w) for x, w in zip(row, width)).rstrip())
                    whole(grid, 2)
                else:
                    n = 2 if tag in self.APART else 1
                    margin(n)
                    walk(children, lists)
                    margin(n)

        walk(nodes, lists)
        flush()
        return done


def html_of(nodes):
    out = []
    for k in nodes:
        if isinstance(k, str):
            out.append(k)
        elif k[0] == "br":
            out.append("<br>")
        elif k[0] == "hidden":
            out.append(f"<div hidden>{html_of(k[1])}</div>")
        else:
            out.append(f"<{k[0]}>{html_of(k[1])}</{k[0]}>")
    return "".join(out)


def a_tree(rng, depth=0, block=True):
    out = []
    for _ in range(rng.randrange(1, 4)):
        kinds = ["text", "text", "b", "br"] + (["div", "p", "h2", "ul", "ol", "blockquote", "hidden", "table"] if block and depth < 4 else [])
        kind = rng.choice(kinds)
        if kind == "text":
            out.append(" " + " ".join(rng.choice(["one", "two", "three", "x"]) for _ in range(rng.randrange(1, 4))) + " ")
        elif kind in ("b", "p", "h2"):
            out.append((kind, [f" w{rng.randrange(9)} "] if kind == "b" else a_tree(rng, depth + 1, False)))
        elif kind == "br":
            out.append(("br", []))
        elif kind in ("ul", "ol"):
            out.append((kind, [("li", a_tree(rng, depth + 1)) for _ in range(rng.randrange(1, 4))]))
        elif kind == "table":
            columns = rng.randrange(1, 4)
            out.append((kind, [("tr", [("td", a_tree(rng, depth + 2, rng.random() < 0.3)) for _ in range(columns)]) for _ in range(rng.randrange(1, 3))]))
        else:
            out.append((kind, a_tree(rng, depth + 1)))
    return out


def test_generated_trees_against_a_second_reader():
    import random

    rng = random.Random(11)
    for _ in range(1500):
        tree = a_tree(rng)
        page = html_of(tree)
        assert visible_text(page) == "\n".join(Reader().lines(tree)).strip("\n"), page
