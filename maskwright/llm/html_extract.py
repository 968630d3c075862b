"""Main text of web pages by wrapper induction over the pages of one host.

A page becomes a tree of block containers labelled by tag and class words; siblings of one label are one node, whose text
blocks keep their place in the page. The pages of a host are told apart by template: by the labels at the first level of
the body that has several. The most common tree of a template is its wrapper, and every page is aligned with it by simple
tree matching (the largest order-keeping match of equally labelled nodes; siblings' labels differ, so that the best match
of a node's children is a heaviest increasing subsequence and costs n log n). Aligned nodes are slots. Over the template's
distinct pages, a text block that its slot has on ``CONSTANT`` of them or more is template, also within an article; what
varies is content. Pages with the same text in every slot have one vote, so that copies make nothing constant.

Slots whose text varies and is yet no content (a menu of related pages, adverts, readers' comments) are told by tag, role
or class words. Where a page has an article or a main part, nothing else is content. On templates with fewer than
``LEAST_PAGES`` distinct pages there is nothing to induce, and only these marks decide. From its ``TEMPLATES`` commonest
templates on, a host's others share one wrapper.

Defined cases: null or empty html and pages without content give the empty text; very long and very deep pages are parsed
whole, in steps that grow with their length (no recursion); unclosed and truncated elements end where their parent or the
page ends; repeated rows give equal results; null urls are one host; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialise, table, tidy

#: Distinct pages a slot must be on, and the share of them from which on a block that all have is template.
LEAST_PAGES, CONSTANT = 8, 0.8
#: Templates of a host that have a wrapper of their own; the others share one.
TEMPLATES, OTHERS = 16, "*"

# HTML element kinds.
BREAK = frozenset(("br", "hr"))
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe object svg select option button canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NO_CONTENT_TAGS = frozenset("nav footer aside form menu dialog head search".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Class and id words of what is no content, and words that may stand beside them in one name.
NO_CONTENT_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus discussion footer header login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
BESIDE_WORDS = frozenset("area article articles bar block body bottom box bottombar center col column consent container content fixed global group head inner item items left link links list main mobile outer page panel post posts primary reader readers right row secondary section site sticky story thread top topbar unit user users wrap wrapper".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+)""")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^a-z]+")
_raw_end = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


class Tree:
    """Containers in order of their begin; a parent's number is less than its children's.

    ``kids[i]``: children by label. ``blocks``: (node, text) in page order.
    """

    def __init__(self):
        self.label, self.parent, self.kids = ["#"], [-1], [{}]
        self.skip, self.main, self.blocks = [False], [False], []

    def child(self, at: int, label: str, skip: bool = False, main: bool = False) -> int:
        found = self.kids[at].get(label)
        if found is None:
            found = self.kids[at][label] = len(self.label)
            self.label.append(label)
            self.parent.append(at)
            self.kids.append({})
            self.skip.append(skip)
            self.main.append(main)
        return found

    def skeleton(self) -> str:
        return "\n".join(f"{p} {x}" for p, x in zip(self.parent[1:], self.label[1:], strict=True))

    @classmethod
    def of(cls, skeleton: str) -> Tree:
        tree = cls()
        for line in skeleton.split("\n") if skeleton else ():
            p, _, label = line.partition(" ")
            tree.child(int(p), label)
        return tree

    def template(self) -> str:
        """What tells the templates of a host apart: the content labels of the first level that has several."""
        at = 0
        while True:
            own = [(x, k) for x, k in self.kids[at].items() if not self.skip[k]]
            if len(own) != 1:
                return "|".join(sorted(x for x, _ in own))
            at = own[0][1]


def _is_no_content(name: str) -> bool:
    """Whether a class or id name says no content, in full: ``comment-list`` does, ``post-comment-free`` does not."""
    parts = [w for w in _PART.split(name) if w]
    return any(w in NO_CONTENT_WORDS for w in parts) and all(w in NO_CONTENT_WORDS or w in BESIDE_WORDS for w in parts)


def _kind(tag: str, rest: str, in_main: bool) -> tuple[str, bool]:
    """(label, whether it is no content) of an element."""
    names, ids, role = [], [], ""
    for m in _ATTR.finditer(rest) if "=" in rest else ():
        key = m[1].lower()
        if key in ("class", "id", "role"):
            value = _html.unescape(m[2].strip("\"'")).lower()
            if key == "role":
                role = value.strip()
            else:
                (names if key == "class" else ids).extend(value.split())
    skip = tag in NO_CONTENT_TAGS or role in NO_CONTENT_ROLES or (tag == "header" and not in_main)
    skip = skip or (tag not in ("html", "body", "article", "main") and any(map(_is_no_content, names + ids)))
    return tag + "".join(f".{n}" for n in sorted(set(names))) + "!" * skip, skip


def parse(text: str) -> Tree:
    """The page's tree of block containers with its text blocks."""
    tree = Tree()
    stack, opened, buffer, at = [("#", 0)], Counter(), [], 0

    def flush():
        if buffer:
            block = _SPACE.sub(" ", _html.unescape("".join(buffer))).strip()
            buffer.clear()
            if block:
                tree.blocks.append((stack[-1][1], block))

    def pop():
        opened[stack.pop()[0]] -= 1

    find = _TAG.search
    while True:
        m = find(text, at)
        if m is None:
            buffer.append(text[at:])
            break
        if m.start() > at:
            buffer.append(text[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            continue
        if tag in RAW:
            end = _raw_end[tag].search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag not in BLOCK:
            if tag in BREAK:
                flush()
                if tag in CLOSES_P and stack[-1][0] == "p":
                    pop()
            continue
        flush()
        if tag in CLOSES_P and stack[-1][0] == "p":
            pop()
        elif tag in ("li", "dt", "dd", "tr", "td", "th"):
            same = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            if stack[-1][0] == "p":
                pop()
            if tag == "tr" and stack[-1][0] in ("td", "th"):
                pop()
            if stack[-1][0] in same:
                pop()
        if m[3].endswith("/") and not m[3].endswith("=/"):
            continue
        up = stack[-1][1]
        label, skip = _kind(tag, m[3], tree.main[up])
        node = tree.child(up, label, tree.skip[up] or skip, tree.main[up] or tag in ("article", "main"))
        opened[tag] += 1
        stack.append((tag, node))
    flush()
    return tree


def _heaviest(place: list[int], weight: list[int]) -> list[int]:
    """Numbers of the heaviest strictly increasing subsequence of distinct places."""
    if all(a < b for a, b in zip(place, place[1:], strict=False)):
        return list(range(len(place)))
    rank = sorted(place)
    best: list[tuple[int, int]] = [(0, -1)] * (len(place) + 1)  # Fenwick tree of (weight, last item)
    before, total = [], []
    for i, p in enumerate(place):
        r = bisect_left(rank, p)
        got, k = (0, -1), r
        while k:
            got = max(got, best[k])
            k -= k & -k
        before.append(got[1])
        total.append(got[0] + weight[i])
        k = r + 1
        while k <= len(place):
            best[k] = max(best[k], (total[i], i))
            k += k & -k
    out, i = [], max(range(len(place)), key=lambda i: (total[i], -i))
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def match(wrapper: Tree, page: Tree) -> tuple[int, list[int]]:
    """Simple tree matching from the roots down: (matched nodes, the wrapper's node for each of the page's or -1)."""
    n = len(page.label)
    partner = [0] + [-1] * (n - 1)
    for i in range(1, n):  # siblings' labels differ, so a node has one possible partner
        up = partner[page.parent[i]]
        if up >= 0:
            partner[i] = wrapper.kids[up].get(page.label[i], -1)
    weight, chosen = [1] * n, [()] * n
    for i in range(n - 1, -1, -1):
        if partner[i] >= 0 and page.kids[i]:
            kids = [k for k in page.kids[i].values() if partner[k] >= 0]
            pick = _heaviest([partner[k] for k in kids], [weight[k] for k in kids])
            chosen[i] = tuple(kids[x] for x in pick)
            weight[i] = 1 + sum(weight[k] for k in chosen[i])
    kept = [-1] * n
    kept[0] = 0
    for i in range(n):
        if kept[i] >= 0:
            for k in chosen[i]:
                kept[k] = partner[k]
    return weight[0], kept


def slots_of(page: Tree, partner: list[int]) -> list[int]:
    """Each node's slot: that of the wrapper's node it matches; others have one of their own under their parent."""
    out = [0]
    for i in range(1, len(page.label)):
        own = "/" if partner[i] >= 0 else "~"
        out.append(xxhash.xxh64_intdigest(f"{out[page.parent[i]]}{own}{page.label[i]}") - (1 << 63))
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def content(page: Tree, slots: list[int], constant: set[int]) -> str:
    """The text of the blocks that are no template. ``constant``: keys of constant blocks (``block_keys``)."""
    blocks = [(i, t) for i, t in page.blocks if not page.skip[i]]
    if any(page.main[i] for i, _ in blocks):
        blocks = [(i, t) for i, t in blocks if page.main[i]]
    if constant:
        blocks = [(i, t) for i, t in blocks if _hash(f"{slots[i]} {t}") not in constant]
    return " ".join(t for _, t in blocks)


def _skeletons(batches):
    for batch in batches:
        trees = [parse(t or "") for t in batch.column(1).to_pylist()]
        cols = [pa.array([t.template() for t in trees], pa.string()), pa.array([t.skeleton() for t in trees], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["host", "template", "tree"])


class Wrappers:
    """The wrappers that come with a row's host: the page's tree, its slots, and its template's constant blocks."""

    def __init__(self):
        self.known: dict[str, Tree] = {}

    def align(self, text: str | None, wrappers: list[dict]) -> tuple[Tree, list[int], dict]:
        page, by_name = parse(text or ""), {w["template"]: w for w in wrappers}
        own = by_name.get(page.template()) or by_name[OTHERS]
        if len(self.known) > 2000:
            self.known.clear()
        if own["tree"] not in self.known:
            self.known[own["tree"]] = Tree.of(own["tree"])
        return page, slots_of(page, match(self.known[own["tree"]], page)[1]), own


def _slot_texts(batches):
    """(host, html, wrappers) to (host, template, slot, block, page): the blocks that could be content."""
    known = Wrappers()
    for batch in batches:
        rows = set()
        for host, text, wrappers in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrappers")), strict=True):
            page, slots, own = known.align(text, wrappers)
            found = {(slots[i], _hash(f"{slots[i]} {t}")) for i, t in page.blocks if not page.skip[i]}
            vote = _hash(repr(sorted(found)))
            rows.update((host, own["template"], s, b, vote) for s, b in found)
        rows = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "template", "slot", "block", "page"])


def _extract(batches):
    known = Wrappers()
    for batch in batches:
        out = []
        for text, wrappers in zip(batch.column("html").to_pylist(), batch.column("wrappers").to_pylist(), strict=True):
            page, slots, own = known.align(text, wrappers)
            out.append(content(page, slots, set(own["constant"] or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _by_host(rows: DataFrame, *fields: str) -> DataFrame:
    """At most ``TEMPLATES`` + 1 wrappers a host, as one row: ``_h``, ``wrappers``."""
    return rows.groupBy(F.col("host").alias("_h")).agg(F.collect_list(F.struct(*fields)).alias("wrappers"))


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(_h, wrappers): per host and template its most common tree, and the blocks that are constant over distinct pages."""
    trees = pages.select("host", "html").mapInArrow(tidy(_skeletons), "host string, template string, tree string").groupBy("host", "template", "tree").agg(F.count("*").alias("n"))
    best = trees.groupBy("host", "template").agg(F.max(F.struct("n", "tree")).alias("top"), F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "template"))
    common = best.withColumn("_rank", place).filter(F.col("_rank") <= TEMPLATES).select("host", "template", F.col("top.tree").alias("tree"))
    common = materialise(common, "templates")
    rest = best.join(common.select("host", "template"), ["host", "template"], "left_anti").groupBy("host").agg(F.max("top").alias("top")).select("host", F.lit(OTHERS).alias("template"), F.col("top.tree").alias("tree"))
    wrappers = materialise(common.unionByName(rest), "wrappers")
    texts = pages.join(_by_host(wrappers, "template", "tree"), F.col("host") == F.col("_h")).select("host", "html", "wrappers")
    texts = texts.mapInArrow(tidy(_slot_texts), "host string, template string, slot long, block long, page long").select(F.xxhash64("host", "template").alias("g"), "slot", "block", "page").distinct()
    texts = materialise(texts, "slots")
    size = texts.select("g", "slot", "page").distinct().groupBy("g", "slot").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    block = texts.groupBy("g", "slot", "block").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES * CONSTANT)
    constant = block.join(size, ["g", "slot"]).filter(F.col("n") >= F.col("pages") * CONSTANT)
    lists = constant.groupBy("g").agg(F.collect_list("block").alias("constant"))  # at most 1 / CONSTANT times a page's blocks
    full = wrappers.join(lists, F.xxhash64("host", "template") == F.col("g"), "left")
    return materialise(_by_host(full, "template", "tree", "constant"), "by_host")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars of its main text."""
    own = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").alias("html")).withColumn("host", host_of(F.col("url")))
    wrappers = induce_wrappers(own)
    both = own.join(wrappers, F.col("host") == F.col("_h")).select("page_id", "url", "html", "wrappers")
    return both.mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")


def op4_query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
