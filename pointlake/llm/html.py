"""Main text of web pages by wrappers inferred per host.

Every page is read as a stream of structural tokens: opening and closing block elements, and text. The streams of a host
are aligned one after the other into one union-free regular expression, its wrapper: siblings that repeat become a
repeated group, tokens that one side lacks become optional, and text becomes a slot. A slot remembers on how many pages
it stood, its length, its share of link text and whether its text ever changed. What a slot is follows from the elements
around it and, where they say nothing, from these figures; a page's text is what stands in its content slots.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pointlake.llm.common import by_bytes, partitions, session, staged
from pointlake.llm.url_filter import url_host

BATCH_BYTES = 4 << 20
#: Partial wrappers of a host that a first round of folding deals out, so that no task folds a hot host alone.
SALTS = 64
#: Siblings of a period up to this are found as repeated groups.
PERIOD = 4
#: A slot whose text never changed on so many pages is part of the template; more than this share of link text is a menu.
TEMPLATE_PAGES, LINK_SHARE = 3, 0.5
#: Wrappers that a task keeps parsed.
REMEMBERED = 2000
#: Elements nested deeper than this still part blocks but count as part of the one at this depth, or as dropped.
DEPTH = 200
#: Characters of the label of a container's first child that are kept as they are in its own.
LABEL = 40

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
#: Opening one of the keys closes an open element of the values, up to the nearest container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body", "aside", "nav", "header", "footer", "form", "blockquote"}
REPEATING = set("p li tr td th dt dd option h2 h3 h4 h5 h6 pre blockquote".split())
BARE = {"div", "section", "table", "tbody", "tr", "td", "ul", "ol", "center"}

# What words of tags, classes, ids and roles say about an element.
DROPPED_TAGS = set("nav footer aside form script style noscript template button select textarea iframe svg dialog menu head title object canvas audio video fieldset".split())
DROPPED_WORDS = set(
    "ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription paywall nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar "
    "share sharing social related recommended recommendations comment comments discussion disqus reply replies respond login signup register search "
    "pagination pager complementary contentinfo form copyright skip".split()
)
CONTENT_WORDS = set("article articlebody post entry story content main body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|textarea|title|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    # Quoted values may hold ">"; where quotes do not pair, the tag ends at the next one. Nothing here backtracks.
    r"|<(/?+)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?+)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _label(tag: str, attributes: str) -> str:
    """Tag and the words of its class, id, role and itemprop; numbers do not count."""
    if not attributes.strip():
        return tag
    words = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            words.append("!hidden")
        elif name != "style":
            words += [w.lower() for w in _WORDS.findall(value)]
    return tag + "".join(f".{w}" for w in words)


# A node is [label, optional, repeated, children]; a slot ["#", optional, repeated, figures]. Figures are pages,
# characters, characters in links, and smallest and largest hash of the text. While a page is read, a slot has a fifth
# entry: the numbers of its texts.


def read_page(html: str) -> tuple[list, list[list]]:
    """(token tree, texts as [block, text]) of a page; the block number grows where a block element begins or ends."""
    root = ["", 0, 0, []]
    stack, texts, block, links, at = [root], [], 0, 0, 0
    deeper: list[tuple[str, bool]] = []  # tag, and whether its text or that of one around it is dropped

    def say(raw):
        nonlocal texts
        text = entities.unescape(raw)
        if not text or deeper and deeper[-1][1]:
            return
        here = stack[-1][3]
        if not here or here[-1][0] != "#":
            if text.isspace() and (not texts or texts[-1][0] != block):
                return
            here.append(["#", 0, 0, [1, 0, 0, 0, 0], []])
        slot = here[-1]
        slot[4].append(len(texts))
        texts.append([block, text])
        slot[3][1] += len(text)
        slot[3][2] += len(text) if links > 0 else 0

    for found in _TOKEN.finditer(html):
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        closing_tag, tag, attributes = (found[2], found[3], found[4]) if found[3] else (found[5], found[6], found[7])
        if not tag:
            if found[0].startswith("<![CDATA["):
                say(entities.escape(found[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if tag in INLINE:
            links += (tag == "a") * (-1 if closing_tag else 1)
            links = max(links, 0)
            continue
        if tag == "br":
            say(" ")
            continue
        block += 1
        if tag in VOID:
            continue
        if closing_tag:
            if deeper:
                place = next((k for k in range(len(deeper) - 1, -1, -1) if deeper[k][0] == tag), None)
                if place is not None:
                    del deeper[place:]
                    continue
                if tag in REPEATING:
                    continue
                deeper.clear()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0].split(".", 1)[0] == tag:
                    del stack[k:]
                    break
                if tag in ("p", "li") and stack[k][0].split(".", 1)[0] in SCOPES:
                    break
            continue
        if stack[-1][0].split(".", 1)[0] == "p":
            stack.pop()
        closing = CLOSES.get(tag)
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0].split(".", 1)[0]
                if name in closing:
                    del stack[k:]
                    break
                if name in SCOPES:
                    break
        if len(stack) > DEPTH:
            if not found[0].endswith("/>"):
                deeper.append((tag, bool(deeper and deeper[-1][1]) or _says(_label(tag, attributes or ""), True)[0]))
            continue
        node = [_label(tag, attributes or ""), 0, 0, []]
        stack[-1][3].append(node)
        if not found[0].endswith("/>"):
            stack.append(node)
    if at < len(html):
        say(html[at:])
    _close(root, texts)
    return root, texts


def _close(root: list, texts: list) -> None:
    """Hashes of slots, labels of bare containers and repeated groups, from the leaves up without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node[3] if c[0] != "#"]
    for node in reversed(order):
        for slot in node[3]:
            if slot[0] == "#":
                content = " ".join("".join(texts[i][1] for i in slot[4]).split())
                slot[3][3] = slot[3][4] = zlib.crc32(content.encode("utf-8", "surrogatepass"))
        node[3] = [c for c in node[3] if c[0] != "#" or _has_text(c, texts)]
        node[3] = _grouped(node[3])
        if node[0] in BARE:
            first = node[3][0][0] if node[3] else ""
            node[0] += ":" + (first if len(first) <= LABEL else f"{first[:LABEL]}~{zlib.crc32(first.encode()):x}")


def _has_text(slot: list, texts: list) -> bool:
    return any(not texts[i][1].isspace() for i in slot[4])


def _alike(a: list, b: list) -> bool:
    if a[0] != b[0]:
        return False
    tag = a[0].split(".", 1)[0]
    return a[0] == "#" or tag in REPEATING or [c[0] for c in a[3]] == [c[0] for c in b[3]]


def _grouped(nodes: list) -> list:
    """Siblings with neighbouring repeats of up to PERIOD nodes merged into one repeated group."""
    out = list(nodes)
    for period in range(1, PERIOD + 1):
        done = []
        for node in out:
            done.append(node)
            tail, head = done[-period:], done[-2 * period : -period]
            if len(head) == period and all(map(_alike, head, tail)):
                del done[-2 * period :]
                for a, b in zip(head, tail):
                    merged = merge(a, b)
                    merged[2] = 1
                    done.append(merged)
        out = done
    return out


def merge(a: list, b: list) -> list:
    """One node for two of the same label: figures of slots are added, children aligned."""
    if a[0] == "#":
        x, y = a[3], b[3]
        figures = [max(x[0], y[0]) if len(a) > 4 and len(b) > 4 else x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4])]
        return ["#", a[1] | b[1], a[2] | b[2], figures, *([a[4] + b[4]] if len(a) > 4 and len(b) > 4 else [])]
    return [a[0], a[1] | b[1], a[2] | b[2], align(a[3], b[3])]


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions with equal labels, a longest common subsequence."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i][0] == b[j][0] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """Two rows of siblings as one: matching nodes are merged, the others become optional."""
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        for node in a[i:x] + b[j:y]:
            out.append([node[0], 1, *node[2:]])
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return _grouped(out)


def bare(node: list) -> list:
    """The tree without the numbers of texts."""
    return node[:4] if node[0] == "#" else [*node[:3], [bare(c) for c in node[3]]]


def expression(node: list) -> str:
    """The wrapper as a regular expression over tokens."""
    body = "#text" if node[0] == "#" else f"<{node[0]}>" + "".join(map(expression, node[3])) + f"</{node[0].split('.')[0]}>"
    mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[node[1], node[2]]
    return f"({body}){mark}" if mark else body


def _says(label: str, inside: bool) -> tuple[bool, int]:
    """(what is in it is dropped, how strongly it says that it holds the content)."""
    tag, *words = label.split(":", 1)[0].split(".")
    if tag in DROPPED_TAGS or "!hidden" in words:
        return True, 0
    if tag not in ("body", "html", "article", "main") and DROPPED_WORDS.intersection(words):
        return True, 0
    if tag == "header" or "header" in words:
        return not inside, 0
    if tag == "article":
        return False, 3
    if tag == "main" or "main" in words or "articlebody" in words or {"article", "body"} <= set(words):
        return False, 2
    return False, 1 if CONTENT_WORDS.intersection(words) and tag != "body" else 0


def slot_kinds(page: list, wrapper: list) -> list[tuple[list[int], int, bool]]:
    """(numbers of texts, level, template) of the slots of a page that are not dropped, in page order.

    ``level``: how strongly an element around the slot says content. ``template``: the wrapper's figures say menu or
    fixed text.
    """
    varied = next(_varying(wrapper), None) is not None
    out, todo = [], [(page, wrapper, 0)]
    while todo:
        node, model, level = todo.pop()
        if node[0] == "#":
            figures = (model or node)[3]
            fixed = varied and figures[0] >= TEMPLATE_PAGES and figures[3] == figures[4]
            out.append((node[4], level, fixed or figures[2] > LINK_SHARE * figures[1]))
            continue
        dropped, says = _says(node[0], level >= 2)
        if dropped:
            continue
        level = max(level, says)
        pairs = dict(matches(node[3], model[3])) if model else {}
        for i in range(len(node[3]) - 1, -1, -1):
            todo.append((node[3][i], model[3][pairs[i]] if i in pairs else None, level))
    return out


def _varying(wrapper: list):
    todo = [wrapper]
    while todo:
        node = todo.pop()
        if node[0] == "#":
            if node[3][0] >= TEMPLATE_PAGES and node[3][3] != node[3][4]:
                yield node
        else:
            todo += node[3]


def page_text(html: str, wrapper: list | None) -> str:
    """The text of the page's content slots, a line per block."""
    page, texts = read_page(html)
    slots = slot_kinds(page, wrapper or bare(page))
    top = max((level for _, level, _ in slots), default=0)
    chosen = [numbers for numbers, level, template in slots if level == top and (top > 0 or not template)]
    blocks: dict[int, list[str]] = {}
    for i in sorted(i for numbers in chosen for i in numbers):
        blocks.setdefault(texts[i][0], []).append(texts[i][1])
    return "\n".join(line for parts in blocks.values() if (line := " ".join("".join(parts).split())))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of (host, html): each task folds its pages per host, two rounds fold what they return."""
    session(pages)
    n = partitions(pages)

    def first(batches):
        salt = TaskContext.get().partitionId() % SALTS
        for batch in by_bytes(batches, "html", BATCH_BYTES):
            found: dict[str, list] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                tree = bare(read_page(html)[0])
                found[host] = merge(found[host], tree) if host in found else tree
            yield pa.RecordBatch.from_pydict(
                {"host": list(found), "salt": pa.array([salt] * len(found), pa.int32()), "wrapper": [json.dumps(w) for w in found.values()]}
            )

    def fold(batches):
        host = salt = wrapper = None
        for batch in batches:
            hosts, salts, trees = [], [], []
            for h, s, w in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper"))):
                if (h, s) != (host, salt):
                    if wrapper is not None:
                        hosts, salts, trees = [*hosts, host], [*salts, salt], [*trees, json.dumps(wrapper)]
                    host, salt, wrapper = h, s, json.loads(w)
                else:
                    wrapper = merge(wrapper, json.loads(w))
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "salt": pa.array(salts, pa.int32()), "wrapper": pa.array(trees, pa.string())})
        if wrapper is not None:
            yield pa.RecordBatch.from_pydict({"host": [host], "salt": pa.array([salt], pa.int32()), "wrapper": [json.dumps(wrapper)]})

    schema = "host string, salt int, wrapper string"
    rows = pages.mapInArrow(first, schema)
    for keys in (["host", "salt"], ["host"]):
        dealt = rows.repartition(n, *keys).select("host", (F.col("salt") if len(keys) > 1 else F.lit(0)).cast("int").alias("salt"), "wrapper")
        rows = dealt.sortWithinPartitions("host", "salt", "wrapper").mapInArrow(fold, schema)
    return rows.select("host", "wrapper")


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row: the main text of the whole page.

    Elements that say so (article, main, content classes) hold the text; menus, headers, footers, side bars, notices,
    adverts, forms, scripts, styles, comments of readers and hidden elements inside are left out. Where no element says
    so, the wrapper of the host decides: text that never changes on its pages and lists of links are left out. Null and
    empty pages give the empty text; pages without a host share one wrapper; repeated rows each give a row, a null id or
    URL stays null, an empty table gives none; other columns are never read.
    """
    session(df)
    pages = df.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        url_host(F.col(url_col)).alias("host"),
    )
    known = staged(wrappers(pages.select("host", "html")))

    def extract(batches):
        models: dict[str, list] = {}
        for batch in by_bytes(batches, "html", BATCH_BYTES):
            texts = []
            for html, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
                if wrapper not in models:
                    if len(models) > REMEMBERED:
                        models.clear()
                    models[wrapper] = json.loads(wrapper) if wrapper else None
                texts.append(page_text(html, models[wrapper]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    found = pages.join(known, "host", "left").select("page_id", "url", "html", "wrapper")
    out = found.mapInArrow(extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
