"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: a style node is a path of elements with their classes. For every style node the tree
knows on how many pages it stands, how their child sequences are distributed (presentation) and how their texts are (content). The
entropy of a distribution, over the logarithm of the number of pages, is 0 if all pages agree and 1 if all differ; the importance of a
branch is the highest found in it. Branches of low importance repeat what the site always says and are removed from each page.
Every branch is counted, also those that the markup declares to be no article (navigation, footers, forms and the like). Those go in any
case, as a host may have one page only. A class or id is a weaker sign: it counts if it is made of words for such parts and of neutral ones,
and the element neither holds an article nor the larger part of the page's text.

Style nodes are counted over the different pages of a host, as copies of one page would agree in everything, by grouping on host and path,
so a host is never held together; a page is read twice (a third time if nothing would be left of it), and no markup is shuffled unless the table of branches to remove is larger than the session broadcasts.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .shipping import by_value
from .url_aliases import parts

#: Elements and class or id words that are no article.
OUTSIDE = set("head nav header footer aside form script style noscript template iframe object embed svg canvas button select option textarea dialog menu audio video".split())
OUTSIDE_WORDS = set("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead sidebar aside widget comment comments disqus replies
    respond share sharing social related newsletter subscribe subscription signup login popup modal overlay skip hidden pagination pager""".split())
COMMENT_WORDS = set("comment comments disqus replies respond".split())
NEUTRAL_WORDS = set("""site page global top bottom left right primary secondary upper lower box block area bar list item items link links section wrap wrapper container
    inner outer slot unit zone panel row col column group region holder fixed sticky mobile desktop btn button icon icons js""".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
BLOCKS = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup
    hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Left out also when branches are counted, as they are never shown.
UNREAD = set("head script style noscript template iframe object embed svg canvas audio video".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: An opening element closes an open one of these, looked for up to a boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
MAIN = {"article", "main"}

LEAST_PAGES = 20
LOW = 0.1

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Za-z0-9]+")


def attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def outside(tag: str, own: dict[str, str], in_main: bool) -> bool:
    """Whether an element is declared to be no article. A header inside the article holds its headline and stays."""
    if tag in OUTSIDE and not (tag == "header" and in_main):
        return True
    if not own or tag in ("html", "body"):
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in OUTSIDE_ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")))


def named_outside(tag: str, own: dict[str, str], in_main: bool) -> set[str]:
    """The words by which a class or the id of an element names a part that is no article: ``cookie-notice`` and ``site-menu`` do,
    ``has-sidebar`` and ``article-header`` do not. A header inside the article is no site header."""
    if not own or tag in ("html", "body") or tag in MAIN:
        return set()
    for name in [*own.get("class", "").split(), own.get("id", "")]:
        words = {w.lower() for w in WORDS.findall(name)}
        found = words & OUTSIDE_WORDS - ({"header", "masthead"} if in_main else set())
        if found and words <= OUTSIDE_WORDS | NEUTRAL_WORDS:
            return found
    return set()


class Page:
    """One pass over a page's markup. ``number`` names style nodes; ``removed`` has those whose branches are left out.

    After the pass ``blocks`` has (text, inside the article, the named branches it is in) in page order, and ``nodes`` for each style node the
    child sequences and texts of its elements and the style node above it. When counting, branches that are declared to be no article are
    read like any other.
    """

    def __init__(self, markup: str, number, removed=frozenset(), count: bool = False):
        self.blocks: list[tuple[str, bool, tuple]] = []
        self.nodes: dict[int, tuple[list, list, int]] = {}
        self._number, self._removed, self._count = number, removed, count
        self._stack: list[tuple[str, int, bool, tuple]] = []  # element, style node, inside the article, named branches
        self._named, self._lifted, self._firm = 0, set(), set()
        self._buffer: list[str] = []
        self._skip = 0  # depth of the stack at which a branch that is left out began, or 0
        self._read(markup)
        self._flush()

    def text(self) -> str:
        """The blocks that are left. A named branch that holds an article is none; nor is one with over half of the text, unless it is named
        for readers' comments or an article has text beside it."""
        size: dict[int, int] = {}
        for t, _, names in self.blocks:
            for n in names:
                size[n] = size.get(n, 0) + len(t)

        def kept(gone):
            return [(t, inside) for t, inside, names in self.blocks if not gone.intersection(names)]

        gone = size.keys() - self._lifted
        left = kept(gone)
        if not any(inside for _, inside in left):
            total = sum(len(t) for t, *_ in self.blocks)
            left = kept({n for n in gone if n in self._firm or 2 * size[n] <= total})
        has_main = any(inside for _, inside in left)
        return "\n".join(t for t, inside in left if inside or not has_main)

    def _flush(self) -> None:
        if self._buffer:
            words = "".join(self._buffer).split()
            self._buffer = []
            if words:
                self.blocks.append((" ".join(words), *(self._stack[-1][2:] if self._stack else (False, ()))))

    def _characters(self, raw: str) -> None:
        if self._skip or not raw:
            return
        decoded = entities.unescape(raw) if "&" in raw else raw
        self._buffer.append(decoded)
        if self._count and self._stack and not decoded.isspace():
            self.nodes[self._stack[-1][1]][1].append(decoded)

    def _pop(self, upto: int) -> None:
        """Close elements until ``upto`` are left open."""
        while len(self._stack) > upto:
            if self._stack[-1][0] in BLOCKS and not self._skip:
                self._flush()
            self._stack.pop()
            if len(self._stack) < self._skip:
                self._skip = 0

    def _open(self, tag: str, source: str) -> None:
        if tag in BLOCKS:
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i][0] == "p":
                    self._pop(i)
                    break
                if self._stack[i][0] in BLOCKS:
                    break
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i][0] in bounds:
                    break
                if self._stack[i][0] in ends:
                    ended = self._stack[i][0]
                    self._pop(i)
                    if tag != "tr" or ended == "tr":  # a new row ends the open cell and then the open row
                        break
        if tag in BLOCKS and not self._skip:
            self._flush()
        if tag == "br" and not self._skip:
            self._buffer.append("\n")
        if tag in VOID:
            return
        above, inside, names = self._stack[-1][1:] if self._stack else (0, False, ())
        if self._skip:
            self._stack.append((tag, above, inside, names))
            return
        own = attributes(source)
        node = self._number(above, tag, own.get("class", ""))
        out = tag in UNREAD if self._count else node in self._removed or outside(tag, own, inside)
        if not out and (why := named_outside(tag, own, inside)):
            self._named += 1
            names = (*names, self._named)
            if why & COMMENT_WORDS:
                self._firm.add(self._named)
        if tag in MAIN and not out:
            inside = True
            self._lifted.update(names)
        self._stack.append((tag, node, inside, names))
        if out:
            self._skip = len(self._stack)
        elif self._count:
            if above in self.nodes:
                self.nodes[above][0].append(node)
            self.nodes.setdefault(node, ([], [], above))

    def _close(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                if tag in BLOCKS or i == len(self._stack) - 1:
                    self._pop(i)
                elif i + 1 > self._skip:
                    del self._stack[i]
                return
            if tag not in BLOCKS and self._stack[i][0] in BLOCKS:
                return

    def _read(self, markup: str) -> None:
        at, end = 0, len(markup)
        while at < end:
            lt = markup.find("<", at)
            if lt < 0:
                self._characters(markup[at:])
                return
            if lt > at:
                self._characters(markup[at:lt])
            m = TAG.match(markup, lt) or PLAIN_TAG.match(markup, lt)
            if m:
                at, tag = m.end(), m[2].lower()
                if m[1]:
                    self._close(tag)
                    continue
                self._open(tag, m[3])
                if tag in RAW:
                    close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(markup, at)
                    if not close:
                        return
                    if tag == "title" and not self._skip:
                        self._characters(markup[at:close.start()])
                    at = close.start()
            elif markup.startswith("<!--", lt):
                close = markup.find("-->", lt + 4)
                if close < 0:
                    return
                at = close + 3
            elif markup.startswith(("<!", "<?"), lt) or markup.startswith("</", lt):
                close = markup.find(">", lt)
                if close < 0:
                    return
                at = close + 1
            elif lt + 1 < end and markup[lt + 1].isalpha():
                return  # the page ends inside a tag
            else:
                self._characters("<")
                at = lt + 1


def numbering():
    """Numbers of style nodes: a hash of the node above, the element and its classes."""
    import xxhash

    known: dict[tuple, int] = {}

    def number(above: int, tag: str, classes: str) -> int:
        key = (above, tag, classes)
        if key not in known:
            if len(known) > 200_000:
                known.clear()
            known[key] = xxhash.xxh64_intdigest(f"{above}/{tag}/{' '.join(sorted(classes.split()))}".encode()) >> 1 or 1
        return known[key]

    return number


def page_nodes(pages: DataFrame) -> DataFrame:
    """``host, page, nodes``: one row for each page that has a style node, ``page`` a hash of its markup, ``nodes`` the style nodes with the
    style node above and the hashes of the child sequences and of the texts of the page's elements there (0: none)."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("node", "above", "shape", "content")]))

    def run(batches):
        import xxhash

        number = numbering()
        digest = lambda x: xxhash.xxh64_intdigest(x.encode()) >> 1
        for batch in batches:
            hosts, marks, rows = [], [], []
            for host, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Page(markup or "", number, count=True).nodes
                if found:
                    hosts.append(host)
                    marks.append(digest(markup))
                    rows.append([{"node": node, "above": above, "shape": digest(",".join(map(str, shape))) if shape else 0,
                                  "content": digest(" ".join(" ".join(content).split())) if content else 0} for node, (shape, content, above) in found.items()])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(marks, pa.int64()), pa.array(rows, kind)], names=["host", "page", "nodes"])

    return pages.select("host", "html").mapInArrow(run, "host string, page long, nodes array<struct<node: long, above: long, shape: long, content: long>>")


def style_nodes(pages: DataFrame, distinct: bool = False) -> DataFrame:
    """``host, node, above, shape, content``: one row for each page and style node, or for each ``distinct`` markup of a host and style node."""
    rows = page_nodes(pages)
    if distinct:
        rows = rows.dropDuplicates(["host", "page"])
    return rows.select("host", F.inline("nodes"))


def importance(nodes: DataFrame) -> DataFrame:
    """``host, node, above, pages, importance`` of every style node: the larger of the two normalised entropies."""
    def entropy(column: str) -> DataFrame:
        counts = nodes.groupBy("host", "node", "above", column).agg(F.count(F.lit(1)).alias("n"))
        total, spread = F.sum("n"), F.sum(F.col("n") * F.log(F.col("n").cast("double")))
        return counts.groupBy("host", "node", "above").agg(
            total.alias("pages"), F.when(total > 1, (F.log(total.cast("double")) - spread / total) / F.log(total.cast("double"))).otherwise(1.0).alias(column))
    return (entropy("shape").join(entropy("content").drop("above", "pages"), ["host", "node"])
            .select("host", "node", "above", "pages", F.greatest("shape", "content").alias("importance")))


def low_branches(nodes: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW) -> DataFrame:
    """``host, nodes``: the topmost style nodes of each host whose whole branch is of low importance.

    A branch is important if any node of it is; importance is handed upwards level by level, as far as it changes anything.
    """
    tree = cut_lineage(importance(nodes))
    vital = tree.where((F.col("importance") >= low) | (F.col("pages") < least_pages)).select("host", "node", "above")
    known = cut_lineage(vital)
    fresh = known
    while not fresh.isEmpty():
        up = fresh.select("host", F.col("above").alias("node")).distinct().join(tree.select("host", "node", "above"), ["host", "node"])
        fresh = cut_lineage(up.join(known.select("host", "node"), ["host", "node"], "left_anti"))
        known = known.unionByName(fresh)
    poor = cut_lineage(tree.join(known.select("host", "node"), ["host", "node"], "left_anti").select("host", "node", "above"))
    topmost = poor.join(poor.select("host", F.col("node").alias("above")), ["host", "above"], "left_anti")
    return topmost.groupBy("host").agg(F.collect_list("node").alias("nodes"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page: the article's blocks in page order, joined by a line feed; text is empty if there is none.

    Null markup gives empty text; pages with a null URL, or one without a host, are merged as one site. Repeated rows give repeated rows; pages of a
    host with the same markup count as one page. Where the branches to remove are all that a page says, the page keeps them. A null key stays null, an empty table gives an empty result; other columns play no part.
    """
    import pyarrow as pa

    rows = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    hosted = rows.withColumn("host", parts(F.col("url"))[0])
    branches = cut_lineage(low_branches(style_nodes(hosted, distinct=True)))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches):
        number = numbering()
        for batch in batches:
            texts = []
            for markup, removed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = Page(markup or "", number, frozenset(removed or ())).text()
                texts.append(text or (Page(markup or "", number).text() if removed else ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["k", "url", "text", "n_chars"])

    return hosted.join(branches, "host", "left").select("k", "url", "html", "nodes").mapInArrow(run, schema).withColumnRenamed("k", key)


by_value(__name__)
