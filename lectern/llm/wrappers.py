"""Main text of pages by wrapper induction.

Pages are parsed to trees, in which runs of like siblings are folded into one node. Elements that are no content by
themselves (navigation, hidden ones and the like) are left out, so they never share a node with content. The trees
of a host's pages are aligned by simple tree matching and merged to a template. Per node it counts the pages that have
it and whether its text was ever different: a node of constant text is template, one that varies is a content slot.
The text of a folded run is that of all its elements, so runs are compared between pages, not within one. Templates
merge like the trees they are made of, so every task makes one for each host it meets, and those are merged in two
steps.

A template node of very many children forgets those that cannot be on most pages, by lossy counting: what is on most
pages is never forgotten, whatever the order of the pages. The pages of hosts whose templates forgot something are then
read once more and counted against the nodes that are left, so counts and constant texts are exact there too.

A page is then aligned with its host's template and its nodes take the roles of the nodes they match. Constant text
goes at any depth, but a block's own text only if the inline elements in it are constant too, and inside article and
main elements inline ones only with their block. Pages of equal text count as one page, so copies do not make their
content a template.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_batches, text_of
from lectern.session import cut_lineage

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset(
    "nav header footer aside form script style noscript template iframe button select option textarea input menu "
    "dialog svg math canvas audio video object head title xmp noembed".split()
)
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted promotion related search share "
    "sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words that may stand beside such a name in a compound; with any other word it names something else.
BESIDE_NAMES = frozenset(
    "area bar block blog body bottom box btn bubble button buttons column component container content desktop fixed "
    "form global google group holder icon icons inline inner item items left link links list listing lower main mini "
    "mobile module outer page panel primary region reply right row secondary section site slot sticky sub tertiary "
    "top unit upper user users wide wp wrap wrapper zone".split()
)
CONTENT = frozenset(("article", "main"))
#: Elements that names alone never mark as no content.
UNNAMED = CONTENT | {"html", "body"}
#: A start tag of the first kind ends an open element of the second.
CLOSES = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "option": frozenset(("option",)),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_WORD = re.compile(r"[a-z]+")
#: Children of a template node from which on those that cannot be on most pages are forgotten; the others all stay.
MOST_CHILDREN = 256
#: Pages from which a template is believed, and the share of them that a template node needs.
LEAST_PAGES = 3
SHARE = 0.6


#: Calls that a level of a tree takes at most; pages may be nested as deep as they are long.
FRAMES = 12

#: ``[label, pages, hash of a constant text or None, some pages by their texts, children, before, gone, loose]``: at most
#: ``before`` more pages had the node and were forgotten, at most ``gone`` pages had any one forgotten child, and
#: ``loose`` says that an inline child was forgotten.
Template = list


class Node:
    """An element of a page: its texts and child elements in order, and its folded form once that is known."""

    __slots__ = ("label", "parts", "chrome", "fold")

    def __init__(self, label: str, chrome: bool = False):
        self.label, self.chrome = label, chrome
        self.parts: list[Node | str] = []
        self.fold: Template | None = None


def is_chrome_name(token: str) -> bool:
    """Whether a class, id or role is a name of no content, or a compound of such names and words beside them."""
    if token in CHROME_NAMES:
        return True
    words = [word for word in _WORD.findall(token) if len(word) > 1]
    return any(word in CHROME_NAMES for word in words) and all(
        word in CHROME_NAMES or word in BESIDE_NAMES for word in words
    )


def attributes(raw: str) -> tuple[str, bool, bool]:
    """Class names as part of a node's label, whether names mark it as no content, and whether it is hidden."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), value.strip("\"'").lower())
    named = any(is_chrome_name(token) for k in ("class", "id", "role") for token in found.get(k, "").split())
    return " ".join(sorted(found.get("class", "").split())), named, "hidden" in found


class Scanner:
    """Texts and tags of a page, ``(text, closing, name, attributes)``, every byte looked at a fixed number of times.

    A tag ends at the first ``>`` outside quotes. Once a quote turns out to be open to the end of the page, tags end at
    their first ``>``. Where no ``>`` follows, ``<`` is text, but the last tag of a page that breaks off is left out.
    """

    def __init__(self, source: str):
        self.source, self.at, self.quoted = source, 0, True
        self.last_end, self.last_open = source.rfind(">"), source.rfind("<")

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` of a tag whose attributes start at ``at``."""
        source, start = self.source, at
        while self.quoted:
            stop = _STOP.search(source, at)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.start()
            at = source.find(stop[0], stop.end()) + 1
            if not at:
                self.quoted = False
        return source.find(">", start)

    def skip_raw(self, name: str) -> None:
        """Go behind the end tag of an element whose content is no markup, or to the end."""
        stop = re.compile(rf"</{name}\b", re.I).search(self.source, self.at)
        end = self.source.find(">", stop.end()) if stop else -1
        self.at = end + 1 if end >= 0 else len(self.source)

    def __iter__(self) -> Iterator[tuple[str, bool, str | None, str]]:
        source, size = self.source, len(self.source)
        while self.at < size:
            at = self.at
            if source[at] != "<":
                stop = source.find("<", at)
                self.at = size if stop < 0 else stop
                yield source[at : self.at], False, None, ""
                continue
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 4)
                self.at = size if stop < 0 else stop + 3
                continue
            closing = source.startswith("</", at)
            name = _NAME.match(source, at + 1 + closing)
            if name is None:
                if closing or source[at + 1 : at + 2] in ("!", "?"):
                    stop = source.find(">", at + 2)
                    self.at = size if stop < 0 else stop + 1
                else:
                    self.at = at + 1
                    yield "<", False, None, ""
                continue
            stop = self.tag_end(name.end()) if name.end() <= self.last_end else -1
            if stop >= 0:
                self.at = stop + 1
                yield "", closing, name[0], source[name.end() : stop]
            elif at < self.last_open:
                self.at = at + 1
                yield "<", False, None, ""
            else:
                self.at = size


def parse(source: str) -> Node:
    """Tree of a page. Text keeps its character references until it is read; broken markup never fails.

    Names do not mark what holds a main element, nor what holds an article if the page has no other.
    """
    root = Node("")
    stack = [root]
    named_nodes: set[int] = set()
    doubtful: list[Node] = []
    elsewhere = False
    scan = Scanner(source)
    for text, closing, name, raw in scan:
        if name is None:
            stack[-1].parts.append(text)
            continue
        name = name.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].label.split(".", 1)[0]
                if open_tag == name:
                    del stack[depth:]
                    break
                if open_tag in CONTENT and name not in BLOCK:
                    break
            continue
        if name in BLOCK:
            close_open(stack, frozenset(("p",)), name)
        if name in CLOSES:
            close_open(stack, CLOSES[name], name)
        classes, named, hidden = attributes(raw) if raw else ("", False, False)
        named = named and name not in UNNAMED
        node = Node(f"{name}.{classes}" if classes else name, named or hidden or name in CHROME)
        stack[-1].parts.append(node)
        if named and not hidden and name not in CHROME:
            named_nodes.add(id(node))
        if name in CONTENT and not hidden:
            chrome = [above for above in stack if above.chrome]
            by_name = [above for above in chrome if id(above) in named_nodes]
            if name == "main":
                for above in by_name:
                    above.chrome = False
            elif len(by_name) == len(chrome):
                doubtful += by_name
            elsewhere = elsewhere or not any(above.chrome for above in chrome)
        if name in RAW:
            scan.skip_raw(name)
        elif name not in VOID and not raw.endswith("/"):
            stack.append(node)
            if len(stack) * FRAMES > sys.getrecursionlimit():
                sys.setrecursionlimit(2 * len(stack) * FRAMES)
    for above in () if elsewhere else doubtful:
        above.chrome = False
    return root


def close_open(stack: list[Node], tags: frozenset[str], by: str) -> None:
    """End the innermost open element of ``tags``, unless a container stands between."""
    for depth in range(len(stack) - 1, 0, -1):
        tag = stack[depth].label.split(".", 1)[0]
        if tag in tags:
            del stack[depth:]
            return
        if tag in BLOCK and tag != "p":
            return


def folded(node: Node, page: int = 0) -> Template:
    """Template of one page's tree: runs of like siblings are one node, whose children are theirs merged."""
    if node.fold:
        return node.fold
    own, children = [], []
    for part in node.parts:
        if isinstance(part, str):
            own.append(part.strip())
            continue
        if part.chrome:
            continue
        child = folded(part, page)
        if children and children[-1][0] == child[0]:
            children[-1] = merged(children[-1], child, True)
        else:
            children.append(child)
    node.fold = [node.label, 1, zlib.crc32(" ".join(own).encode()), [page], children, 0, 0, False]
    return node.fold


def matching(left: list[Template], right: list[Template], known: dict | None = None) -> list[tuple[int, int]]:
    """Simple tree matching of two sequences of siblings: the pairs, in order, of the heaviest alignment.

    ``known`` keeps weights of pairs of nodes over the levels of one comparison.
    """
    rows, columns = len(left), len(right)
    if rows == columns and all(a[0] == b[0] for a, b in zip(left, right)) and len({a[0] for a in left}) == rows:
        return [(i, i) for i in range(rows)]
    known = {} if known is None else known
    weights: dict[tuple[int, int], int] = {}
    best = heaviest(left, right, known, weights)
    pairs, i, j = [], rows, columns
    while i and j:
        weight = weights.get((i - 1, j - 1), 0)
        if weight and best[i][j] == best[i - 1][j - 1] + weight:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def heaviest(left: list[Template], right: list[Template], known: dict, weights: dict | None = None) -> list[list[int]]:
    """Weights of the heaviest alignments of the beginnings of two sequences of siblings, those of like labels looked at."""
    places: dict[str, list[int]] = {}
    for j, node in enumerate(right):
        places.setdefault(node[0], []).append(j)
    best = [[0] * (len(right) + 1)]
    for i, node in enumerate(left):
        above = best[-1]
        if node[0] in places:
            row = above[:]
            for j in places[node[0]]:
                weight = weight_of(node, right[j], known)
                row[j + 1] = max(row[j + 1], above[j] + weight)
                if weights is not None:
                    weights[i, j] = weight
            above = list(accumulate(row, max))
        best.append(above)
    return best


def weight_of(a: Template, b: Template, known: dict | None = None) -> int:
    """Nodes that two trees have in common; roots of unlike labels have none."""
    known = {} if known is None else known
    if a[0] != b[0]:
        return 0
    if not a[4] or not b[4]:
        return 1
    pair = id(a), id(b)
    weight = known.get(pair)
    if weight is None:
        if [c[0] for c in a[4]] == [c[0] for c in b[4]] and not any(c[4] for c in a[4]):
            weight = 1 + len(a[4])
        else:
            weight = 1 + heaviest(a[4], b[4], known)[-1][-1]
        known[pair] = weight
    return weight


def merged(
    a: Template, b: Template, siblings: bool = False, known: dict | None = None, depth: int = 0
) -> Template:
    """Two aligned templates as one: those of different pages, or of like siblings of one page."""
    known = {} if known is None else known
    if siblings:
        pages, some, text = a[1], a[3], zlib.crc32(b"%d" % b[2], a[2])
    else:
        pages, some, text = a[1] + b[1], a[3], a[2] if a[2] == b[2] else None
        if len(some) < LEAST_PAGES and some != b[3]:
            some = [*some, *(page for page in b[3] if page not in some)][:LEAST_PAGES]
    pairs = matching(a[4], b[4], known)
    children, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[4]), len(b[4]))]:
        children += missed_by(a[4][i:x], b[6]) + missed_by(b[4][j:y], a[6])
        if x < len(a[4]):
            children.append(merged(a[4][x], b[4][y], siblings, known, depth + 1))
        i, j = x + 1, y + 1
    both = [a[0], pages, text, some, children, a[5] + b[5], a[6] + b[6], a[7] or b[7]]
    if not siblings and len(children) > MOST_CHILDREN:
        forget(both, depth)
    return both


def missed_by(children: list[Template], gone: int) -> list[Template]:
    """Children that another template has not, whose pages may have had them before it forgot them."""
    return [[*child[:5], child[5] + gone, *child[6:]] for child in children] if gone else children


def forget(node: Template, depth: int) -> None:
    """Forget the children that had too few of the node's pages so far, at most ``SHARE / ((depth + 1) * (depth + 2))``.

    These shares sum up to less than ``SHARE`` from the root down, so a node that is on as many pages is in the end
    still there. No more children stay than so many pages have at a time.
    """
    least = SHARE * node[1] / ((depth + 1) * (depth + 2))
    kept = []
    for child in node[4]:
        if child[1] + child[5] > least:
            kept.append(child)
        else:
            node[6] = max(node[6], child[1] + child[5])
            node[7] = node[7] or tag_of(child[0]) not in BLOCK
    node[4] = kept


def packed(template: Template) -> str:
    """A template as a flat list of nodes, each behind its parent, with the parents' places."""
    nodes, waiting = [], [(template, -1)]
    while waiting:
        node, parent = waiting.pop()
        waiting += [(child, len(nodes)) for child in reversed(node[4])]
        nodes.append([parent, *node[:4], *node[5:]])
    return json.dumps(nodes)


def unpacked(raw: str) -> Template:
    nodes: list[Template] = []
    for parent, *own in json.loads(raw):
        nodes.append([*own[:4], [], *own[4:]])
        if parent >= 0:
            nodes[parent][4].append(nodes[-1])
    if len(nodes) * FRAMES > sys.getrecursionlimit():
        sys.setrecursionlimit(2 * len(nodes) * FRAMES)
    return nodes[0]


def host_of(url: str) -> str:
    try:
        return (urlsplit(url.strip()).hostname or "").lower()
    except ValueError:
        return ""


def grouped(templates: Iterator[tuple[str, Template]], known: dict[str, Template]) -> None:
    for host, template in templates:
        known[host] = merged(known[host], template) if host in known else template


def induce(pages: DataFrame) -> DataFrame:
    """``host, template`` of ``host, html`` rows: pages of equal text count once in a task.

    How many distinct texts a node was seen with is exact over all tasks, up to as many as are asked for.
    """

    def first(batches):
        known: dict[str, Template] = {}
        seen: set[int] = set()
        task = TaskContext.get().partitionId()

        def out():
            kinds = [pa.int32(), pa.string(), pa.string()]
            columns = [[task] * len(known), list(known), [packed(t) for t in known.values()]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["task", "host", "template"]
            )

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not source:
                    continue
                tree = parse(source)
                page = page_key(written(tree, set()))
                key = hash((host, page))
                if key not in seen:
                    seen.add(key)
                    grouped([(host, folded(tree, page))], known)
            if len(known) > 2000:
                yield out()
                known, seen = {}, set()
        if known:
            yield out()

    def again(part: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, Template] = {}
        grouped(((h, unpacked(t)) for h, t in zip(part["host"], part["template"])), known)
        rows = [(int(part["task"].min()), h, packed(t), has_gaps(t)) for h, t in known.items()]
        return pd.DataFrame(rows, columns=["task", "host", "template", "gaps"])

    schema = "task int, host string, template string, gaps boolean"
    partial = map_batches(pages.select("host", "html"), first, "task int, host string, template string")
    partial = cut_lineage(partial, "templates")
    tasks = partial.agg(F.max("task").alias("n")).first()["n"] or 0
    width = max(1, round((tasks + 1) ** 0.5))
    some = partial.groupBy("host", F.floor(F.col("task") / width)).applyInPandas(again, schema)
    whole = some.groupBy("host").applyInPandas(again, schema)
    known = cut_lineage(whole.select("host", "template", "gaps"), "templates")
    if known.filter("gaps").isEmpty():
        return known.select("host", "template")
    counted = recounted(pages.join(known.filter("gaps"), "host").select("host", "html", "template"))
    return known.filter("not gaps").select("host", "template").unionByName(cut_lineage(counted, "templates"))


def has_gaps(template: Template) -> bool:
    """Whether a template forgot something."""
    waiting = [template]
    while waiting:
        node = waiting.pop()
        if node[6]:
            return True
        waiting += node[4]
    return False


def count_page(page: Node, template: Template, key: int) -> None:
    """Add a page to the counts of the template nodes that match its nodes."""
    waiting = [(folded(page, key), template)]
    while waiting:
        own, role = waiting.pop()
        role[2] = own[2] if not role[1] or role[2] == own[2] else None
        role[1] += 1
        if len(role[3]) < LEAST_PAGES and key not in role[3]:
            role[3].append(key)
        waiting += [(own[4][i], role[4][j]) for i, j in matching(own[4], role[4])]


def recounted(pages: DataFrame) -> DataFrame:
    """``host, template`` of ``host, html, template`` rows: the nodes of the templates with the counts of all pages.

    Counts of tasks meet node by node, so no task holds more than one page and the templates of the hosts it meets.
    """
    schema = "host string, node int, nodes string, pages long, same long, text long, some array<long>"
    names = ["host", "node", "nodes", "pages", "same", "text", "some"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def work(batches):
        held: dict[str, tuple[str, Template]] = {}
        seen: set[int] = set()

        def out():
            rows = []
            for host, (raw, template) in held.items():
                for k, (_, _, n, text, some, *_) in enumerate(json.loads(packed(template))):
                    # Where the text differs within the task, it is no text at all.
                    rows.append((host, k, raw if k == 0 else None, n, int(n > 0 and text is not None), text, some))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for host, source, raw in zip(*(column.to_pylist() for column in batch.columns)):
                if not source:
                    continue
                tree = parse(source)
                page = page_key(written(tree, set()))
                key = hash((host, page))
                if key in seen:
                    continue
                seen.add(key)
                if host not in held:
                    if len(held) > 2000:
                        yield out()
                        held.clear(), seen.clear()
                        seen.add(key)
                    held[host] = raw, emptied(unpacked(raw))
                count_page(tree, held[host][1], page)
        if held:
            yield out()

    parts = map_batches(pages, work, schema)
    met = F.col("pages") > 0
    nodes = parts.groupBy("host", "node").agg(
        F.max("nodes").alias("nodes"),
        F.sum("pages").alias("pages"),
        F.when(
            F.bool_and(F.when(met, F.col("same") > 0)) & (F.min(F.when(met, F.col("text"))) == F.max(F.when(met, F.col("text")))),
            F.max("text"),
        ).alias("text"),
        F.slice(F.array_distinct(F.flatten(F.collect_list("some"))), 1, LEAST_PAGES).alias("some"),
    )
    whole = nodes.groupBy("host").agg(
        F.max("nodes").alias("nodes"), F.sort_array(F.collect_list(F.struct("node", "pages", "text", "some"))).alias("counts")
    )

    def join(batches):
        for batch in batches:
            rows = []
            for host, raw, counts in zip(*(column.to_pylist() for column in batch.columns)):
                nodes = json.loads(raw)
                for node, own in zip(nodes, counts):
                    node[2:5] = own["pages"], own["text"], own["some"]
                rows.append((host, json.dumps(nodes)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["host", "template"])

    return map_batches(whole, join, "host string, template string")


def emptied(template: Template) -> Template:
    """A template without its counts."""
    waiting = [template]
    while waiting:
        node = waiting.pop()
        node[1:4] = 0, None, []
        waiting += node[4]
    return template


def tag_of(label: str) -> str:
    return label.split(".", 1)[0]


def page_key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=6).digest())


def text_of_node(node: Node, into: list[str], bare: set[int]) -> None:
    """Append a node's blocks; an empty string ends a block. The own texts of ``bare`` nodes are left out."""
    waiting: list[tuple[Node | str, bool]] = [(part, id(node) in bare) for part in reversed(node.parts)]
    while waiting:
        part, silent = waiting.pop()
        if isinstance(part, str):
            into.append(" " if silent and part else part)
        elif part.chrome or part.label == "br" or part.label.startswith("br."):
            into.append(" ")
        else:
            block = tag_of(part.label) in BLOCK
            if block:
                into.append("")
                waiting.append(("", False))
            inside = id(part) in bare
            waiting += [(own, inside) for own in reversed(part.parts)]


def contents(node: Node) -> list[Node]:
    """Outermost article and main elements."""
    found, waiting = [], [node]
    while waiting:
        inner = [part for part in waiting.pop().parts if isinstance(part, Node) and not part.chrome]
        for part in reversed(inner):
            waiting.append(part)
        while waiting and tag_of(waiting[-1].label) in CONTENT:
            found.append(waiting.pop())
    return found


def constant(template: Template, pages: int) -> bool:
    """Whether a node has one text on most of a host's pages, and on several that differ elsewhere."""
    return template[2] is not None and len(template[3]) >= LEAST_PAGES and template[1] >= SHARE * pages


def constant_block(template: Template, pages: int) -> bool:
    """Whether the own text and all inline elements are constant."""
    waiting = [template]
    while waiting:
        node = waiting.pop()
        if not constant(node, pages) or node[7]:
            return False
        waiting += [child for child in node[4] if tag_of(child[0]) not in BLOCK]
    return True


def aligned(node: Node, template: Template, pages: int, inside: bool, goes: bool, bare: set[int]) -> None:
    """Collect the nodes of a page whose own text is template, as the template nodes say that they match.

    ``inside`` an article or main element, inline elements go or stay with their block, as ``goes`` says of ``node``.
    """
    runs: list[tuple[Template, list[Node]]] = []
    for part in node.parts:
        if isinstance(part, Node) and not part.chrome:
            own = folded(part)
            if runs and runs[-1][0][0] == own[0]:
                runs[-1] = (merged(runs[-1][0], own, True), [*runs[-1][1], part])
            else:
                runs.append((own, [part]))
    for i, j in matching([own for own, _ in runs], template[4]):
        role = template[4][j]
        tag = tag_of(role[0])
        within = inside or tag in CONTENT
        gone = goes if within and tag not in BLOCK else constant_block(role, pages)
        for part in runs[i][1]:
            if gone:
                bare.add(id(part))
            aligned(part, role, pages, within, gone, bare)


def written(page: Node, bare: set[int]) -> str:
    """Text of the article or main elements, else of the page, in blocks."""
    pieces: list[str] = []
    for node in contents(page) or [page]:
        text_of_node(node, pieces, bare)
        pieces.append("")
    blocks, block = [], []
    for piece in [*pieces, ""]:
        if piece:
            block.append(piece)
        elif block:
            blocks.append(" ".join(entities.unescape("".join(block)).split()))
            block = []
    return "\n\n".join(b for b in blocks if b)


def extract(source: str, template: Template | None) -> str:
    """Main text of a page: the slots that vary in its article or main elements, else in all of it."""
    page = parse(source)
    bare: set[int] = set()
    if template and len(template[3]) >= LEAST_PAGES:
        if constant_block(template, template[1]):
            bare.add(id(page))
        aligned(page, template, template[1], False, False, bare)
    return written(page, bare)


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text`` of every row; the text is empty if there is none.

    A missing page or URL is an empty one; pages without a host share a template. Rows may repeat and ids be null.
    """
    named = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        text_of(html_col).alias("html"),
    )

    def hosts(batches):
        for batch in batches:
            host = pa.array([host_of(url or "") for url in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, host], names=["page_id", "url", "html", "host"])

    hosted = map_batches(named, hosts, "page_id long, url string, html string, host string")
    templates = induce(hosted)

    def work(batches):
        read: dict[str, Template] = {}
        for batch in batches:
            texts = []
            for source, host, raw in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if host not in read:
                    if len(read) > 5000:
                        read.clear()
                    read[host] = unpacked(raw) if raw else None
                texts.append(extract(source, read[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    joined = hosted.join(templates, "host", "left").select("page_id", "url", "html", "host", "template")
    return map_batches(joined, work, "page_id long, url string, text string")
