"""Main text of web pages by site style trees: pages of one host are laid over each other, and branches that say
the same on many pages are noise."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow
from millrace.session import written

# HTML element names by kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search"
    " section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
NOISE_TAGS = frozenset(
    "head script style noscript template textarea title iframe object svg canvas select button nav header footer aside"
    " form menu dialog search".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation"
    " newsletter notice notices pagination pager popup promo promoted promotion related respond replies share sharing"
    " sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
# Words that an article's own parts are called by too, in labels of several words: there they are evidence only.
DOUBTFUL_WORDS = frozenset(
    "banner consent cookie cookies copyright header login notice notices promoted related respond share sharing skip social"
    " subscribe widget widgets".split()
)
ARTICLE_WORDS = frozenset("article content entry post story body text title headline main".split())
MAIN_TAGS = frozenset(("article", "main"))
FIXED_TAGS = frozenset(("html", "body", "article", "main"))
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
DEEPEST = 512
OUTWEIGHS = 2

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _words(value: str) -> set[str]:
    return {part.lower() for part in PARTS.findall(value)}


class Element:
    """One element of a page: its path in the site's style tree and what its tag and attributes say of it."""

    __slots__ = ("above", "children", "depth", "doubtful", "labelled", "main", "noise", "path", "tag")

    def __init__(self, tag: str, attributes: str, above: Element | None) -> None:
        self.tag, self.above, self.children = tag, above, []
        self.depth = above.depth + 1 if above else 0
        self.noise, self.labelled, self.main = tag in NOISE_TAGS, False, tag in MAIN_TAGS
        self.doubtful = False
        sign = tag
        if attributes and not attributes.isspace():
            found = {}
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), a or b or c)
            label = f"{found.get('class', '')} {found.get('id', '')}"
            role = found.get("role", "").lower()
            self.labelled = bool(label.strip() or role)
            if self.labelled:
                sign = f"{tag} {role} {re.sub('[0-9]+', '0', label)}"
            words = _words(label)
            if tag not in FIXED_TAGS:
                named = bool(words & NOISE_WORDS and not words & ARTICLE_WORDS)
                self.doubtful = named and words & NOISE_WORDS <= DOUBTFUL_WORDS and not words <= NOISE_WORDS
                self.noise = self.noise or role in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
                self.noise = self.noise or bool(HIDDEN.search(found.get("style", "")))
                self.doubtful = self.doubtful and not self.noise
                self.noise = self.noise or named
                # Comments stay reader comments whatever else the label says.
                self.noise = self.noise or bool(words & {"comment", "comments", "commentlist", "disqus"})
            elif words & {"comment", "comments"}:
                self.noise = True
            self.main = self.main or role == "main"
        self.path = xxhash.xxh3_64_intdigest(sign, seed=above.path if above else 0)


def parse(source: str) -> list[tuple[str, Element]]:
    """The text blocks of a page in order, each with the element that holds it.

    A block ends where a block element starts or ends; ``br`` is white space. Elements nested deeper than
    ``DEEPEST`` count as of that depth, as in browsers. Character references are decoded once.
    """
    blocks: list[tuple[str, Element]] = []
    root = Element("#page", "", None)
    stack, parts, owner = [root], [], [None]

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text and owner[0] is not None:
                blocks.append((text, owner[0]))
            parts.clear()
        owner[0] = None

    def add(segment: str) -> None:
        parts.append(html.unescape(segment) if "&" in segment else segment)
        if owner[0] is None and not segment.isspace():
            holder = next((e for e in reversed(stack) if e.tag in BLOCK or e.noise), stack[-1])
            owner[0] = holder

    # No tag ends after the last ``>``: what opens after it is text, but for a comment, and isn't looked through again.
    at, last = 0, source.rfind(">") + 1
    while match := TOKEN.search(source, at, last):
        if match.start() > at:
            add(source[at : match.start()])
        at = match.end()
        if at == last and match[0].startswith("<!--") and not match[0].endswith("-->"):
            at = len(source)
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if tag:
            tag = tag.lower()
            if closing:
                _close(stack, tag, flush)
            elif tag == "br":
                parts.append(" ")
            else:
                if tag in BLOCK:
                    flush()
                    _imply(stack, tag)
                above = stack[-1]
                element = Element(tag, attributes, above)
                above.children.append(tag)
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                    at = end.end() if end else len(source)
                elif tag not in VOID and not attributes.endswith("/"):
                    if element.noise and tag not in BLOCK:
                        flush()
                    if len(stack) >= DEEPEST:
                        stack.pop()
                    stack.append(element)
    end = source.find("<!--", at)
    rest = source[at:] if end < 0 else source[at:end]
    if rest:
        add(rest)
    flush()
    return blocks


def _imply(stack: list[Element], tag: str) -> None:
    """Close what the start of a block closes without being told: paragraphs, list items, cells."""
    for place in range(len(stack) - 1, 0, -1):
        open_ = stack[place].tag
        if open_ == "p" or open_ in CLOSES.get(tag, ()):
            del stack[place:]
            if open_ == "p" or tag not in ("tr", "tbody", "tfoot"):
                return
        elif open_ in BLOCK and open_ not in ("td", "th", "tr"):
            return


def _close(stack: list[Element], tag: str, flush) -> None:
    for place in range(len(stack) - 1, 0, -1):
        if stack[place].tag == tag:
            if tag in BLOCK or stack[place].noise:
                flush()
            del stack[place:]
            return
        if tag not in BLOCK and stack[place].tag in BLOCK:
            return
    if tag in BLOCK:
        flush()


def chain(element: Element) -> list[Element]:
    out = []
    while element is not None:
        out.append(element)
        element = element.above
    return out


def said_at(path: int, text: str) -> int:
    """The key of a text at a node of the style tree."""
    return xxhash.xxh3_64_intdigest(text, seed=path)


def main_text(
    source: str, noise: frozenset[int], vital: frozenset[int] = frozenset(), dull: frozenset[int] = frozenset()
) -> str:
    """The page's blocks without noise, joined by line feeds.

    ``noise`` holds keys (``said_at``) of texts that a site repeats at a node, ``vital`` the nodes of high importance,
    ``dull`` those of low. Elements whose tag, role or label tells menus, headers, footers, adverts, forms and comments go;
    in an article a label of several words, one of them doubtful ("related-work"), gives way to a high importance. Of the
    rest a text goes that is noise at any node above it, in an article (or main) element and outside, with labels or
    without; other texts of the same node stay. Outside an article, where a page has one, a text stays if its own node is
    vital. Where the tree knows too little of the nodes outside, their texts stay if together they are more than
    ``OUTWEIGHS`` times as long as the article: that is a teaser then. Bare paragraphs and headings right in an article are
    its text even if other pages say the same.
    """
    kept = []
    for text, owner in parse(source):
        above = chain(owner)
        within = any(e.main for e in above)
        if not any(e.noise and not (within and e.doubtful and e.path in vital) for e in above):
            kept.append((text, above))
    held = any(e.main for _, above in kept for e in above)
    out, unknown, marked = [], set(), [0, 0]
    for text, above in kept:
        nodes = []
        for element in above:
            if element.tag in FIXED_TAGS or element.main:
                break
            nodes.append(element)
        inside = any(e.main for e in above)
        aside = held and not inside and above[0].path not in vital
        if aside and above[0].path in dull:
            continue
        if inside and all(e.tag in PROSE_TAGS and not e.labelled for e in nodes):
            nodes = []
        if not any(said_at(e.path, text) in noise for e in nodes):
            marked[aside] += len(text)
            if aside:
                unknown.add(len(out))
            out.append(text)
    if marked[1] <= OUTWEIGHS * marked[0]:
        out = [text for place, text in enumerate(out) if place not in unknown]
    return "\n".join(out)


def host_of(url: str | None) -> str:
    """Lower-case host of a url; empty where there is none."""
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def style_tree(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path, kind, feature, pages): the merged trees, one row per thing that pages say at a path.

    Kind 0 is the node itself (pages that have it), kind 1 a presentation (the order of its child elements), kind 2 a
    text below it. Pages of a host with the same blocks count once, so copies of an article don't make it noise.
    """

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            out = {"host": [], "page": [], "path": [], "kind": [], "feature": []}
            for address, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = parse(value or "")
                page = xxhash.xxh3_64_intdigest("\n".join(t for t, _ in blocks))
                host = host_of(address)
                rows = set()
                for text, owner in blocks:
                    for element in chain(owner):
                        if element.tag in FIXED_TAGS or element.above is None:
                            continue
                        rows.add((element.path, 0, 0))
                        rows.add((element.path, 2, said_at(element.path, text)))
                        if element.children:
                            rows.add((element.path, 1, xxhash.xxh3_64_intdigest(" ".join(element.children))))
                for path, kind, feature in rows:
                    out["host"].append(host)
                    out["page"].append(page - (1 << 63))
                    out["path"].append(path - (1 << 63))
                    out["kind"].append(kind)
                    out["feature"].append(feature - (1 << 63) if kind else 0)
            kinds = {"host": pa.string(), "kind": pa.int32()}
            yield pa.table({name: pa.array(column, kinds.get(name, pa.int64())) for name, column in out.items()})

    rows = map_arrow(pages.select(url, source), work, "host string, page long, path long, kind int, feature long")
    return rows.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("pages"))


def importance(tree: DataFrame, decay: float = 0.9) -> DataFrame:
    """(host, path, pages, importance): 0 for a node that says the same on all pages, 1 for one that never repeats.

    With m pages that have the node, the content's importance is 1 less the mean entropy (base m) of its texts over
    pages, log(n) / log(m) for a text on n pages. The presentation's is the entropy of its forms. The node's is the
    presentation's with a weight that grows with the number of forms, 1 - decay ^ forms, and the content's with the
    rest; a node on a single page has 1.
    """
    node = tree.where("kind = 0").select("host", "path", F.col("pages").alias("m"))
    each = tree.where("kind > 0").join(node, ["host", "path"])
    base = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    share = F.col("pages") / F.col("m")
    sums = each.groupBy("host", "path", "m").agg(
        F.avg(F.when(F.col("kind") == 2, F.log(F.col("pages").cast("double")) / base)).alias("same"),
        F.sum(F.when(F.col("kind") == 1, -share * F.log(share) / base)).alias("forms"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("count"),
    )
    content = 1 - F.coalesce("same", F.lit(0.0))
    weight = F.when(F.col("count") > 1, 1 - F.pow(F.lit(decay), F.col("count") - 1)).otherwise(0.0)
    both = weight * F.least(F.coalesce("forms", F.lit(0.0)), content) + (1 - weight) * content
    return sums.select("host", "path", F.col("m").alias("pages"), F.when(F.col("m") > 1, both).otherwise(1.0).alias("importance"))


def repeated(tree: DataFrame, threshold: float, least_pages: int) -> DataFrame:
    """(host, key): texts of less than ``threshold`` importance at a node of ``least_pages`` pages or more.

    A text on n of the node's m pages has 1 - log(n) / log(m), its share of the node's content importance. Texts of one
    page never are among them, whatever the rest of the node says.
    """
    node = tree.where(F.col("kind") == 0).where(F.col("pages") >= least_pages).select("host", "path", F.col("pages").alias("m"))
    said = tree.where((F.col("kind") == 2) & (F.col("pages") > 1)).join(node, ["host", "path"])
    own = 1 - F.log(F.col("pages").cast("double")) / F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    return said.where(own < threshold).select("host", F.col("feature").alias("key"))


def extract(
    pages: DataFrame, keep: list[str], url: str = "url", source: str = "html", threshold: float = 0.35, least_pages: int = 4
) -> DataFrame:
    """Columns ``keep`` and text: the main text of every page, empty where there is none.

    Null html is empty; a null url belongs to the host without a name. On nodes of ``least_pages`` pages or more, texts
    of less than ``threshold`` importance are noise, the nodes of that importance or more are vital and the others dull;
    fewer pages tell nothing. What is known of a host is one row: at most the number of distinct labels its templates use (digits in
    labels count as one) and, for each of them and each text of a page, some pages^(1/3) texts that repeat. Spark decides
    by its size whether to broadcast that table; pages of one large host stay split over many tasks either way. Whole
    pages are read.
    """
    tree = written(style_tree(pages, url, source), "style-tree")
    nodes = importance(tree).where(F.col("pages") >= least_pages)
    which = F.when(F.col("importance") >= threshold, "vital").otherwise("dull")
    known = repeated(tree, threshold, least_pages).withColumn("which", F.lit("noise"))
    known = known.unionByName(nodes.select("host", F.col("path").alias("key"), which.alias("which")))
    kinds = ("noise", "vital", "dull")
    sets = [F.collect_set(F.when(F.col("which") == kind, F.col("key"))).alias(kind) for kind in kinds]
    # Written first: its size is then known when the join with whole pages is planned.
    known = written(known.groupBy("host").agg(*sets), "noise")
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    # Kept columns go by their place on the way, so that none of them can clash with those added.
    places = [f"kept_{i}" for i in range(len(keep))]
    rows = pages.select(*(F.col(c).alias(p) for c, p in zip(keep, places, strict=True)), F.col(source).alias("html"), F.lower(host).alias("host"))
    rows = rows.join(known, "host", "left").select(*places, "html", *kinds)
    schema = pages.select(*keep).schema

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = []
            given = (batch.column(len(keep) + i).to_pylist() for i in range(4))
            for value, *known in zip(*given, strict=True):
                found.append(main_text(value or "", *(frozenset(p + (1 << 63) for p in keys or ()) for keys in known)))
            out = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(found, pa.string())], names=[*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_arrow(rows, work, f"{fields}, text string")
