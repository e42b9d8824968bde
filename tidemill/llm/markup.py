"""Markup residue: HTML, Markdown, wiki and LaTeX to clean text that keeps headings, lists, code and formulas.

Each field is parsed into a document tree, written as its blocks in order with their path and presentation. Method for
what to keep: a site style tree. The trees of all fields of one source are merged element by element; an element's importance is
composed of the entropy of its presentations and that of the contents below it over the source's pages, and branches of
low importance, which look and say the same on nearly every page, are removed. Headings, list items, code blocks and formulas are structure that is
always kept: repeated code would otherwise be taken for page furniture.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import bounded_broadcast, written

# Element names, wiki and LaTeX words that the parser knows.
BLOCK_TAGS = frozenset("p div ul ol li h1 h2 h3 h4 h5 h6 pre hr table tr td th blockquote section article header footer dl dt dd body html nav aside main figure".split())
INLINE_TAGS = frozenset("a b i u s em strong span br img code math ref sub sup small big font del ins mark q cite abbr kbd tt var samp nowiki syntaxhighlight source strike center label input button script style head title meta link form".split())
LATEX_BLOCKS = "section|subsection|subsubsection|paragraph|subparagraph|chapter|part"
LATEX_WORDS = frozenset("textbf textit texttt textsc emph em underline href url footnote cite ref label item section subsection subsubsection paragraph chapter begin end caption frac sqrt noindent bf it tt".split())
LATEX_CODE, LATEX_MATH = "verbatim|lstlisting|minted|Verbatim", "equation|align|gather|multline|displaymath|math|eqnarray"

#: A cheap test, by Spark, that a field can hold markup at all; what it passes is parsed, so it takes all that the parser does.
MAY_HOLD = r"[<&*`\[{$\\~_=#']|(?m)^ {0,3}>[ \t]+\S|^[ \t]*(?:[-+]|\p{Nd}{1,9}[.)])[ \t]|^ {0,3}-[ \t]*-[ \t]*-"
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
TAG = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*|/)?)>", re.S)
OPEN_TAG = re.compile(TAG.pattern.removeprefix("<!--.*?-->|"))
FENCE = re.compile(r"^(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<body>.*?)(?:^(?P=f)[`~]*[ \t]*$|\Z)", re.S | re.M)
PRE = re.compile(r"<(pre|syntaxhighlight|source)\b[^<>]*>(?P<body>.*?)(?:</\1\s*>|\Z)", re.S | re.I)
TEX_CODE = re.compile(rf"\\begin\{{(?P<e>{LATEX_CODE})\*?\}}(?P<body>.*?)(?:\\end\{{(?P=e)\*?\}}|\Z)", re.S)
MATH = re.compile(
    r"<math\b[^<>]*>(?P<a>.*?)</math\s*>|\$\$(?P<b>[^$]+?)\$\$|\\\[(?P<c>.+?)\\\]|\\\((?P<d>.+?)\\\)"
    rf"|\\begin\{{(?P<e>{LATEX_MATH})\*?\}}(?P<f>.*?)\\end\{{(?P=e)\*?\}}|(?<![\\$\w])\$(?=[^\s$])(?P<g>[^$\n]*?[^\s$\\])\$(?![\d$])",
    re.S | re.I,
)
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
MD_LINK = re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"]*\")?\)")
MD_MARKS = re.compile(r"\*\*(?=\S)[^\n]+?(?<=\S)\*\*|__(?=\S)[^\n]+?(?<=\S)__|~~(?=\S)[^\n]+?(?<=\S)~~|(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])")
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]")
WIKI_URL = re.compile(r"\[(?:https?:)?//\S+?(?:[ \t]+([^\[\]]*))?\]")
WIKI_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
BRACES = re.compile(r"[{}]")
WIKI_QUOTE = re.compile(r"'{2,5}(?=[^'])(.+?)'{2,5}")
WIKI_REF = re.compile(r"<ref\b[^<>]*?(?:/>|>.*?</ref\s*>)", re.S | re.I)
WIKI_LONE_REF = re.compile(r"<ref\b[^<>]*?/>", re.I)
WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$")
TEX_WORD = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?(\{)?")
TEX_HEAD = re.compile(rf"\\(?:{LATEX_BLOCKS})\*?\{{")
ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
LIST = re.compile(r"^[ \t]*(?:[-+*]|\d{1,9}[.)])[ \t]+(\S.*)$")
WIKI_LIST = re.compile(r"^([*#:;]+)[ \t]*(\S.*)$")
RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
STRUCTURE = ("heading", "list_item", "code_block", "formula")


@dataclass
class Node:
    kind: str  # heading, list_item, code_block, formula, text or rule
    path: str
    style: str
    text: str
    inline: bool = False


def known_tag(name: str) -> bool:
    return name.lower() in BLOCK_TAGS or name.lower() in INLINE_TAGS


def has_entity(text: str) -> bool:
    return any(m[0][1] == "#" or m[0][1:] in html5 for m in ENTITY.finditer(text))


def find_tags(text: str) -> Iterator[re.Match]:
    """Comments and tags; after the last end of a comment none is looked for, so that open ones cost no time."""
    cut = text.rfind("-->") + 3 if "-->" in text else 0
    yield from TAG.finditer(text, 0, cut)
    yield from OPEN_TAG.finditer(text, cut)


def sub_tags(to: Callable[[re.Match], str], text: str) -> str:
    out, at = [], 0
    for m in find_tags(text):
        out += [text[at : m.start()], to(m)]
        at = m.end()
    return "".join([*out, text[at:]])


def sub_closed(rx: re.Pattern, to: str, text: str, end: str) -> str:
    """Like ``sub``, looking no further than the last ``end``, without which the pattern does not match."""
    cut = text.lower().rfind(end)
    stop = text.find(">", cut) + 1 if cut >= 0 else 0
    return rx.sub(to, text[:stop]) + text[stop:] if stop else text


def without_templates(text: str) -> str:
    """Without wiki templates, innermost first, to any depth; in one pass."""
    out: list[str] = []
    braces: list[int] = []  # where in ``out`` there are single braces
    at = i = 0
    for m in BRACES.finditer(text):
        i = m.start()
        if i < at:
            continue
        out.append(text[at:i])
        at = i + 1
        if m[0] == "}" and text[i + 1 : i + 2] == "}" and len(braces) > 1:
            p, q = braces[-2:]
            if out[p] == out[q] == "{" and not any(out[p + 1 : q]):
                del out[p:], braces[-2:]
                at = i + 2
                continue
        braces.append(len(out))
        out.append(m[0])
    return "".join([*out, text[at:]])


class Parser:
    """One field. ``nodes`` are its blocks in order; ``marked`` says whether it holds any markup or character entity."""

    def __init__(self, text: str) -> None:
        self.nodes: list[Node] = []
        self.held: list[Node] = []
        self.marked = has_entity(text)
        body = self._carve(text)
        tags = {m[2].lower() for m in find_tags(body) if m[2] and known_tag(m[2])}
        self.marked |= bool(tags) or "<!--" in body and "-->" in body
        tex = bool(TEX_HEAD.search(body) or re.search(r"\\begin\{|\\item\b", body))
        if tags & BLOCK_TAGS:
            self._html(body)
        elif tex:
            self._tex(body)
        else:
            self._lines(body)

    def _hold(self, node: Node) -> str:
        self.held.append(node)
        self.marked = True
        return f"\ue000{len(self.held) - 1}\ue001"

    def _carve(self, text: str) -> str:
        """Code blocks first, as what stands inside them is code only, then formulas."""
        text = text.replace("\ue000", "").replace("\ue001", "")
        code = lambda kind: lambda m: "\n\n" + self._hold(Node("code_block", kind, "", m["body"])) + "\n\n"
        for rx, kind in ((FENCE, "fence"), (PRE, "pre"), (TEX_CODE, "verbatim")):
            text = rx.sub(code(kind), text)
        for n in self.held:
            t = n.text
            if n.path == "pre":
                t = html.unescape(re.sub(r"</?code\b[^<>]*>", "", t, flags=re.I))
            n.text = t.strip("\n")
        text = INLINE_CODE.sub(lambda m: self._hold(Node("inline_code", "code", "", m[2])), text)

        def formula(m: re.Match) -> str:
            body = next(x for x in (m["a"], m["b"], m["c"], m["d"], m["f"], m["g"]) if x is not None)
            if m["g"] is not None and not re.search(r"[A-Za-z\\=^_+<>/]", body):
                return m[0]  # amounts of money
            return self._hold(Node("formula", "math", "", html.unescape(body).strip(), inline=True))

        return MATH.sub(formula, text)

    def _put(self, kind: str, path: str, style: str, text: str) -> None:
        """Adds a block, with what was carved out of it in place."""
        blocks = "|".join(str(i) for i, n in enumerate(self.held) if n.kind == "code_block")
        for part in re.split(rf"(\ue000(?:{blocks})\ue001)", text) if kind == "text" and blocks else [text]:
            m = re.fullmatch(r"\ue000(\d+)\ue001", part)
            if m and self.held[int(m[1])].kind == "code_block":
                n = self.held[int(m[1])]
                self.nodes.append(Node("code_block", f"{path}/{n.path}", style, n.text))
                continue
            extra: list[Node] = []

            def fill(x: re.Match, extra: list[Node] = extra) -> str:
                n = self.held[int(x[1])]
                if n.kind == "formula":
                    extra.append(n)
                    return f"${n.text}$"
                return n.text

            clean = self._inline(part)
            clean = re.sub(r"\ue000(\d+)\ue001", fill, clean)
            clean = re.sub(r"[ \t]+", " ", clean).strip()
            if kind != "text" or clean:
                self.nodes.append(Node(kind, path, style, clean))
            self.nodes += extra

    def _inline(self, t: str) -> str:
        def sub(rx: re.Pattern, to: str | type(None), t: str) -> str:  # type: ignore[valid-type]
            while True:  # nested marks, to any depth
                new = rx.sub(lambda m: (m[1] or "") if to is None else to, t)
                if new == t:
                    return t
                self.marked = True
                t = new
            return t

        if "<" in t:
            new = sub_closed(WIKI_REF, "", t, "</ref") if "</ref" in t.lower() else WIKI_LONE_REF.sub("", t)
            self.marked |= new != t
            t = sub_tags(lambda m: ("" if m[0].startswith("<!--") else " " if m[2].lower() == "br" else "") if not m[2] or known_tag(m[2]) else m[0], new)
        if "{{" in t:
            new = without_templates(t)
            self.marked |= new != t
            t = new
        if "[" in t:
            while True:
                before = t
                t = sub(MD_LINK, None, sub(WIKI_URL, None, sub(WIKI_LINK, None, t)))
                if t == before:
                    break
        if "''" in t:
            t = sub(WIKI_QUOTE, None, t)
        if any(c in t for c in "*_~"):
            while True:
                new = MD_MARKS.sub(lambda m: m[0].strip("*_~") if m[0][0] in "*_~" else m[0], t)
                if new == t:
                    break
                self.marked = True
                t = new
        if "\\" in t:
            t = self._tex_inline(t)
        if "&" in t:
            t = html.unescape(t)
            if "<" in t:  # tags that were escaped once more
                t = sub_tags(lambda m: " " if m[2] and m[2].lower() == "br" else "" if m[2] and m[2].lower() in INLINE_TAGS else m[0], t)
        return t

    def _tex_inline(self, t: str) -> str:
        out, i, ends = [], 0, []
        while i < len(t):
            m = TEX_WORD.match(t, i)
            if m and (m[2] or m[1] in LATEX_WORDS):
                self.marked = True
                i = m.end()
                if m[1] in ("href", "footnote", "label", "ref", "cite") and m[2]:
                    depth = 1  # the first argument is no text
                    while i < len(t) and depth:
                        depth += {"{": 1, "}": -1}.get(t[i], 0)
                        i += 1
                    if m[1] == "href" and t[i : i + 1] == "{":
                        ends.append("")
                        i += 1
                elif m[2]:
                    ends.append("")
                elif t[i : i + 1] == " ":
                    i += 1
                continue
            if t[i] == "{" and re.match(r"\{\\(?:em|bf|it|tt)\b", t[i:]):
                ends.append("")
            elif t[i] == "}" and ends:
                out.append(ends.pop())
            else:
                out.append(t[i])
            i += 1
        return "".join(out)

    def _html(self, body: str) -> None:
        stack: list[tuple[str, str]] = []
        at, held, kind, style = 0, [], "text", ""

        def flush() -> None:
            nonlocal kind
            t = "".join(held)
            held.clear()
            path = "/".join(f"{n}[{a}]" if a else n for n, a in stack) or "body"
            if t.strip() or kind in ("heading", "list_item"):
                if kind == "text":
                    self._put("text", path, style, t)
                else:
                    head = t
                    for part in re.split(r"(\ue000\d+\ue001)", t):  # code inside an item is a block of its own
                        m = re.fullmatch(r"\ue000(\d+)\ue001", part)
                        if m and self.held[int(m[1])].kind == "code_block":
                            head = head.replace(part, "")
                    self._put(kind, path, style, head)
                    for m in re.finditer(r"\ue000(\d+)\ue001", t):
                        n = self.held[int(m[1])]
                        if n.kind == "code_block":
                            self.nodes.append(Node("code_block", f"{path}/{n.path}", style, n.text))
            kind = "text"

        for m in find_tags(body):
            if m.lastindex is None or m[2] is None or not known_tag(m[2]) or m[2].lower() not in BLOCK_TAGS:
                continue
            held.append(body[at : m.start()])
            at = m.end()
            name = m[2].lower()
            flush()
            if m[1]:
                names = [n for n, _ in stack]
                if name in names:
                    del stack[len(names) - 1 - names[::-1].index(name) :]
                continue
            if name == "hr" or m[3] == "/":
                self.nodes.append(Node("rule", "/".join([*(n for n, _ in stack), name]), "", ""))
                continue
            if name in ("li", "p") and stack and stack[-1][0] == name:
                stack.pop()  # left open
            style = re.sub(r"\d+", "9", " ".join(sorted(re.findall(r"([a-zA-Z-]+)\s*=", m[3]))))
            stack.append((name, style))
            kind = "heading" if re.fullmatch(r"h[1-6]", name) else "list_item" if name == "li" else "text"
        held.append(body[at:])
        flush()

    def _tex(self, body: str) -> None:
        self.marked = True
        at = 0
        env: list[str] = []
        rx = re.compile(rf"\\begin\{{([A-Za-z]+\*?)\}}(?:\[[^\]\n]*\])?|\\end\{{([A-Za-z]+\*?)\}}|\\item\b(?:\[[^\]\n]*\])?[ \t]*|\\(?:{LATEX_BLOCKS})\*?\{{|\n[ \t]*\n")
        kind = "text"
        i = 0

        def flush(end: int) -> None:
            nonlocal kind
            t = body[at:end]
            if t.strip() or kind == "list_item":
                self._put(kind, "/".join(["tex", *env]), "", t)
            kind = "text"

        while m := rx.search(body, i):
            flush(m.start())
            i = at = m.end()
            if m[1]:
                env.append(m[1])
            elif m[2]:
                if m[2] in env:
                    del env[len(env) - 1 - env[::-1].index(m[2]) :]
            elif m[0].startswith("\\item"):
                kind = "list_item"
            elif m[0].strip():
                depth = 1
                while i < len(body) and depth:
                    depth += {"{": 1, "}": -1}.get(body[i], 0)
                    i += 1
                self._put("heading", "tex/head", "", body[at : i - 1])
                at = i
        flush(len(body))

    def _lines(self, body: str) -> None:
        lines = body.split("\n")
        wiki = bool(WIKI_LINK.search(body) or WIKI_TEMPLATE.search(body) or WIKI_URL.search(body) or any(WIKI_HEAD.match(x) for x in lines) or re.search(r"'''|<ref\b", body))
        para: list[str] = []

        def flush() -> None:
            if para:
                self._put("text", "p", "", " ".join(para))
                para.clear()

        for k, line in enumerate(lines):
            before, after = lines[k - 1] if k else "", lines[k + 1] if k + 1 < len(lines) else ""
            if not line.strip():
                flush()
                continue
            if m := WIKI_HEAD.match(line):
                flush()
                self.marked = True
                self._put("heading", f"wiki/h{len(m[1])}", "", m[2])
            elif (m := WIKI_LIST.match(line)) and line[0] in "*#" and (wiki and (len(m[1]) > 1 or line[len(m[1]) : len(m[1]) + 1] in " \t") or (line[0] == "#" and any(x.startswith("# ") or x.startswith("## ") for x in (before, after)) and line[len(m[1])] in " \t")):
                flush()
                self.marked = True
                self._put("list_item", f"wiki/{m[1]}", "", m[2])
            elif (m := re.match(r"^(\*{2,}|#{2,})[ \t]+(\S.*)$", line)) and m[1][0] == "*":
                flush()
                self.marked = True
                self._put("list_item", f"wiki/{m[1]}", "", m[2])
            elif m := ATX.match(line):
                flush()
                self.marked = True
                self._put("heading", f"md/h{len(m[1])}", "", m[2])
            elif SETEXT.match(line) and len(line.strip()) >= 3 and para and not LIST.match(before):
                t = para.pop()
                flush()
                self.marked = True
                self._put("heading", "md/setext", "", t)
            elif RULE.match(line):
                flush()
                self.marked = True
                self.nodes.append(Node("rule", "md/hr", "", ""))
            elif m := re.match(r"^ {0,3}>[ \t]+(\S.*)$", line):
                flush()
                self.marked = True
                self._put("text", "md/quote", "", m[1])
            elif m := LIST.match(line):
                flush()
                self.marked = True
                self._put("list_item", "md/li", "", m[1])
            else:
                para.append(line)
        flush()


def parse(text: str | None) -> tuple[bool, list[Node]]:
    """(whether the field holds any markup or entity, its blocks in order); null and empty fields hold nothing."""
    if not text:
        return False, []
    p = Parser(text)
    return p.marked, p.nodes


NODES = "key string, field_name string, page string, site string, ord int, kind string, path string, style string, text string, inline boolean"


def branches(nodes: list[Node]) -> dict[str, str]:
    """The inner elements of a page's tree, by path, with their presentation: the kinds of their children in order, runs as one."""
    out: dict[str, list[str]] = {}
    for n in nodes:
        parts = n.path.split("/")
        for k in range(1, len(parts)):
            children = out.setdefault("/".join(parts[:k]), [])
            if children[-1:] != [parts[k]]:
                children.append(parts[k])
    return {p: " ".join(c) for p, c in out.items()}


def parse_fields(df: DataFrame, key: str, fields: list[str], site: str | None = None, tree: bool = False) -> DataFrame:
    """(key, field_name, page, site, ord, kind, path, style, text, inline): the blocks of every field with markup.

    Fields that are null, empty or hold no markup give no rows. A field's first row has ord 0 and kind 'markup'. With
    ``tree`` there is also a row of kind 'branch' for each inner element, whose style is its presentation.
    ``page`` tells repeated keys with different fields apart.
    """
    at = F.col(site).cast("string") if site else F.lit(None).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("f")
    t = df.select(F.col(key).cast("string").alias("key"), at.alias("site"), each).select("key", "site", "f.*").where(F.col("text").rlike(MAY_HOLD))
    t = t.withColumn("page", F.md5("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]
        for pdf in batches:
            rows = []
            for k, s, f, text, page in zip(pdf.key, pdf.site, pdf.field_name, pdf.text, pdf.page, strict=True):
                marked, nodes = parse(text)
                if marked:
                    rows.append((k, f, page, s, 0, "markup", "", "", "", False))
                    rows += [(k, f, page, s, i + 1, n.kind, n.path, n.style, n.text, n.inline) for i, n in enumerate(nodes)]
                    if tree:
                        rows += [(k, f, page, s, 0, "branch", p, x, "", False) for p, x in branches(nodes).items()]
            yield pd.DataFrame(rows, columns=names)

    return t.select("key", "site", "field_name", "text", "page").mapInPandas(run, NODES)


def found_elements(nodes: DataFrame) -> DataFrame:
    """(key, field_name, element, seq): one row for the markup of a field and each element, numbered per element."""
    own = nodes.where(F.col("kind").isin("markup", *STRUCTURE))
    w = Window.partitionBy("key", "field_name", "page", "kind").orderBy("ord")  # of one field; its repeated rows share their places
    return own.select("key", "field_name", F.col("kind").alias("element"), F.dense_rank().over(w).cast("bigint").alias("seq")).distinct()


LOW, LEAST_PAGES, MAX_LOW = 0.1, 20, 100_000
WEIGHT = 0.9  # of what lies below an element, to the power of the number of its presentations


def _entropy(e: Column, m: Column) -> Column:
    """Of counts with sum m and sum e of n ln n, by the logarithm to m: 0 if all are alike, 1 if all differ or there is one."""
    return F.when(m > 1, F.try_divide(F.ln(m) - e / m, F.ln(m))).otherwise(F.lit(1.0))


def _counted(t: DataFrame, what: str) -> DataFrame:
    """(site, path, pages, kinds, entropy) over the distinct pages at each path, of which each value of ``what`` counts its pages.

    Counts are taken per distinct value first, so that no source's pages are brought together.
    """
    n = t.select("site", "path", what, "page").distinct().groupBy("site", "path", what).agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("site", "path").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.ln("n")).alias("e"))
    pages = t.select("site", "path", "page").distinct().groupBy("site", "path").agg(F.count(F.lit(1)).alias("pages"))
    pages = pages.select(F.col("site").alias("s1"), F.col("path").alias("p1"), "pages")
    g = g.join(pages, F.col("site").eqNullSafe(F.col("s1")) & (F.col("path") == F.col("p1")))
    return g.select("site", "path", "pages", "kinds", _entropy(F.col("e"), F.col("m")).alias("entropy"))


def _above(t: DataFrame) -> DataFrame:
    """Each path with ``branch``, once for each inner element above it."""
    parts = F.split("path", "/")
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return t.withColumn("branch", F.explode(up))


def style_tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, branches) of the sites' style trees: the merged trees of all pages of a site.

    leaves: (site, path, pages, content): content is the entropy of the texts at the path over the site's pages. branches:
    (site, path, pages, presentation, below, importance): presentation is the entropy of an element's presentations,
    below the mean content of the leaves under it by pages, and the composite importance is (1 - g) presentation + g below
    with g = WEIGHT to the number of presentations. A page counts once for each content, its copies under other keys not at
    all; ``pages`` are the distinct ones. Headings and list items count as leaves; code and formulas do not.
    """
    t = nodes.where(F.col("kind").isin("text", "rule", "heading", "list_item")).withColumn("h", F.xxhash64("text"))
    leaves = _counted(t, "h").select("site", "path", "pages", F.col("entropy").alias("content"))
    below = _above(leaves).groupBy("site", "branch").agg((F.sum(F.col("content") * F.col("pages")) / F.sum("pages")).alias("below"))
    below = below.select(F.col("site").alias("s2"), F.col("branch").alias("p2"), "below")
    own = _counted(nodes.where(F.col("kind") == "branch"), "style").select("site", "path", "pages", "kinds", F.when(F.col("kinds") > 1, F.col("entropy")).otherwise(F.when(F.col("pages") > 1, 0.0).otherwise(1.0)).alias("presentation"))
    g = F.pow(F.lit(WEIGHT), F.col("kinds"))
    both = own.join(below, F.col("site").eqNullSafe(F.col("s2")) & (F.col("path") == F.col("p2")))
    return leaves, both.select("site", "path", "pages", "presentation", "below", ((1 - g) * F.col("presentation") + g * F.col("below")).alias("importance"))


def clean_fields(df: DataFrame, key: str, fields: list[str], site: str, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(key, field_name, clean): the clean text of every field with markup, by the site style tree.

    Headings are written as '# ', list items as '- ', code between fences and formulas between dollar signs. Text and rules
    are removed if an element above them stands on at least ``least_pages`` distinct pages of its site and its composite
    importance is below ``low``, or if that holds for their own place and the importance of its content; structure is
    never removed. Fields without markup give no rows: they are clean as they are.
    """
    nodes = written(parse_fields(df, key, fields, site, tree=True).distinct(), "markup-nodes")
    leaves, inner = (written(t, "markup-tree") for t in style_tree(nodes))
    enough = F.col("pages") >= least_pages
    poor = inner.where(enough & (F.col("importance") < low)).select(F.col("site").alias("s2"), F.col("path").alias("p2"))
    under = _above(leaves).join(poor, F.col("site").eqNullSafe(F.col("s2")) & (F.col("branch") == F.col("p2"))).select("site", "path")
    gone = leaves.where(enough & (F.col("content") < low)).select("site", "path").unionByName(under).distinct()
    gone = bounded_broadcast(gone, MAX_LOW).withColumnsRenamed({"site": "s2", "path": "p2"})
    keep = F.col("kind").isin(*STRUCTURE, "markup")
    kept = nodes.where(F.col("kind") != "branch").join(gone, F.col("site").eqNullSafe(F.col("s2")) & (F.col("path") == F.col("p2")), "left").where(keep | F.col("p2").isNull())
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("# "), "text"))
        .when(F.col("kind") == "list_item", F.concat(F.lit("- "), "text"))
        .when(F.col("kind") == "code_block", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when((F.col("kind") == "text"), F.col("text"))
    )
    rows = kept.where(~F.col("inline")).select("key", "field_name", "page", "ord", line.alias("line"))
    parts = rows.groupBy("key", "field_name", "page").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("ord", "line")))).alias("l"))
    return parts.select("key", "field_name", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("clean"))
