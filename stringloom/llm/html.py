"""Main text of web pages by paths on which the pages of a host agree.

Every page scores its containers (text in blocks, less links and markup) and votes with the generalised tag-class path of each good one. Spark adds the votes
up per host; the best path of a host is then used to extract all its pages again. A page without the winning path, or of a
host without votes, uses its own best container.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, written

#: Elements without content, elements whose content is never text, and elements that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas video audio textarea title annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the first kind ends when one of the second begins.
CLOSED_BY = {
    "p": BLOCKS - {"html", "body", "head"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"}), "head": frozenset({"body"}),
}
#: Elements that are never the article, and words in class, id or role that mark what may not be.
BOILERPLATE = frozenset("nav header footer aside form menu button select dialog".split())
_UNWANTED = (r"ads?|advert\w*|banner|sponsor\w*|promo\w*|breadcrumbs?|comments?|replies|respond|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
             r"footer|header|masthead|nav\w*|menu\w*|topbar|toolbar|side(?:bar|nav)?|widget\w*|related|recommend\w*|newsletter|subscri\w*|signup|login|search\w*|share|"
             r"sharing|social|pag(?:er|ination)|copyright|legal|skip\w*|hidden")
NOT_ARTICLE = re.compile(rf"(?:^|[-_\s])(?:{_UNWANTED})(?=$|[-_\s\d])", re.I)
_UNWANTED_WORD = re.compile(_UNWANTED, re.I)
#: Words of the list for inserted units, which are no part of an article that they stand in either, and those of them for what readers wrote.
_THREAD = r"comments?|replies|respond|disqus"
_INSERTED_WORD = re.compile(rf"ads?|advert\w*|sponsor\w*|promo\w*|breadcrumbs?|{_THREAD}|newsletter|signup|login|popup|hidden", re.I)
_THREAD_WORD = re.compile(_THREAD, re.I)
#: Units of which a list of readers' texts consists; so many of one shape make a list.
UNITS = frozenset("li article div section dd blockquote".split())
LIKE_SHAPED = 2
#: Words that only say where an element is or what kind of box.
LAYOUT = frozenset(
    "js is has slot anchor box container wrap wrapper block blocks area section list bar unit inner outer content site page top bottom left right main primary secondary global "
    "button buttons btn link links icon icons item items form panel row col column module component posts articles stories title message body text thread threads entry".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("input textarea select button".split())
#: A marked element in doubt goes when links make this share of its text, or a form control stands for every so many characters.
LINK_SHARE = 0.5
CONTROL_CHARS = 80
#: Words in class, id or role that mark the article.
ARTICLE = re.compile(r"(?:^|[-_\s])(?:article\w*|content|main|post\w*|entry|body|story|text)(?=$|[-_\s\d])", re.I)
#: Longer paths are named by a digest of the parent's name and the element.
LONG_PATH = 400
CONTAINERS = frozenset("article main section div td body blockquote".split())

# A comment may end at once; a quote opens a value only behind an equals sign, anywhere else it is a character like any other.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
_HEADING_PARENTS = ("article", "main", "section")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[-_\d]+")


@lru_cache(10_000)
def named_for(name: str) -> str:
    """What a name is made for that has no words but listed and layout ones: "inserted", "unwanted" or nothing; slugs of headings have others."""
    parts = [p for p in _PARTS.split(name) if p]
    unwanted = [p for p in parts if _UNWANTED_WORD.fullmatch(p)]
    if not unwanted or any(p not in unwanted and p.lower() not in LAYOUT and len(p) > 1 for p in parts):
        return ""
    return "inserted" if any(_INSERTED_WORD.fullmatch(p) for p in unwanted) else "unwanted"


class Node:
    __slots__ = ("tag", "mark", "parent", "path", "barred", "linked", "inside", "suspect")

    def __init__(self, tag: str, mark: str, parent: Node | None, barred: bool, inline: bool = False):
        self.tag, self.mark, self.parent, self.barred = tag, mark, parent, barred
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.suspect: Suspect | None = None if parent is None else parent.suspect  # the nearest element in doubt around this one
        if inline or tag == "html":
            self.path = parent.path
        else:
            own = tag + "".join("." + c for c in sorted(set(re.sub(r"\d+", "0", mark).split())))
            path = own if parent is None else f"{parent.path}/{own}"
            self.path = path if len(path) <= LONG_PATH else "#" + hashlib.md5(path.encode("utf-8", "replace")).hexdigest()
        self.linked = 0  # characters of link texts


class Suspect:
    """A marked element that may still belong to the article, with what its text consists of."""

    __slots__ = ("outer", "alone", "thread", "units", "headings", "controls", "chars", "linked", "out")

    def __init__(self, outer: Suspect | None, alone: bool, thread: bool = False):
        self.outer, self.alone = outer, alone  # alone: the mark suffices unless there is a heading
        self.thread, self.units = thread, {}  # thread: units of one shape, counted by their paths, suffice
        self.headings = self.controls = self.chars = self.linked = 0

    def settle(self) -> None:
        dense = self.linked > 0 and self.linked >= LINK_SHARE * self.chars or self.controls * CONTROL_CHARS > self.chars
        listed = self.thread and max(self.units.values(), default=0) >= LIKE_SHAPED
        self.out = dense or listed or self.alone and not self.headings or self.outer is not None and self.outer.out


class Page:
    """Elements of a page in document order and its text pieces, each a block's text or a part of one."""

    def __init__(self, source: str):
        self.root = Node("", "", None, False)
        self.nodes = [self.root]
        self.pieces: list[tuple[int, Node, str]] = []  # (block number, element, text)
        self.suspects: list[Suspect] = []  # outer ones first
        self._read(source)
        if self.suspects:
            self._settle()

    def _read(self, source: str) -> None:
        here, block, skip, links = self.root, 0, "", 0
        pieces, nodes = self.pieces, self.nodes
        position, end = 0, len(source)
        while position < end:
            if skip:  # nothing counts before the end tag of a raw element
                found = re.compile(rf"</{re.escape(skip)}\s*(?=[\s>])[^>]*>", re.I).search(source, position)
                position, skip = (found.end() if found else end), ""
                continue
            token = _TOKEN.search(source, position)
            stop = token.start() if token else end
            if stop > position and not here.barred:
                text = source[position:stop]
                if links and text.strip():
                    here.linked += len(text.strip())
                pieces.append((block, here, text))
            if not token:
                break
            position = max(token.end(), stop + 1)
            name = token[2]
            if name is None:
                continue
            tag = name.lower()
            if token[1]:
                if tag == "a" and links:
                    links -= 1
                block += tag in BLOCKS
                open_ = here
                while open_.parent is not None and open_.tag != tag:
                    open_ = open_.parent
                if open_.parent is not None:  # an end tag without its start is ignored
                    here = open_.parent
                continue
            if tag == "br" or tag == "hr":
                if tag == "hr":
                    block += 1
                elif not here.barred:
                    pieces.append((block, here, " "))
                continue
            if tag in CONTROLS and here.suspect is not None:
                here.suspect.controls += 1
            if tag in VOID:
                continue
            if tag in RAW:
                skip = "" if token[3].endswith("/") else tag
                continue
            if tag in BLOCKS:
                block += 1
                while here.tag in CLOSED_BY and tag in CLOSED_BY[here.tag]:
                    here = here.parent
                inline = here  # a block ends a paragraph around inline elements too
                while inline.parent is not None and inline.tag not in BLOCKS:
                    inline = inline.parent
                if inline.tag == "p" and tag in CLOSED_BY["p"]:
                    here = inline.parent
            if tag == "a":
                links += 1
            elif tag not in BLOCKS:
                here = Node(tag, "", here, here.barred, inline=True)
                continue
            attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(token[3])} if "=" in token[3] else {}
            mark = " ".join(entities.unescape(attributes[k]) for k in ("class", "id", "role") if k in attributes)
            hidden = "hidden" in token[3] and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", token[3]) is not None or attributes.get("aria-hidden") == "true" \
                or "display:none" in attributes.get("style", "").replace(" ", "")
            barred = here.barred or hidden or self._barred(tag, here)
            doubt = None if barred or not mark else self._doubt(tag, attributes, here)
            here = Node(tag, mark if tag != "a" else "", here, barred or doubt == "sure")
            if here.suspect is not None and here.suspect.thread and tag in UNITS:
                here.suspect.units[here.path] = here.suspect.units.get(here.path, 0) + 1
            if doubt in ("alone", "dense"):
                thread = all(map(_THREAD_WORD.fullmatch, filter(None, _PARTS.split(entities.unescape(attributes.get("id", "")).strip()))))
                here.suspect = Suspect(here.suspect, doubt == "alone", "id" in attributes and thread)
                self.suspects.append(here.suspect)
            if tag in HEADINGS and here.suspect is not None:
                here.suspect.headings += 1
            if tag in CONTAINERS:
                nodes.append(here)

    @staticmethod
    def _barred(tag: str, parent: Node) -> bool:
        if tag == "header":  # an article's own header is part of it
            up = parent
            while up.parent is not None and up.tag not in _HEADING_PARENTS:
                up = up.parent
            return up.tag not in ("article", "main")
        return tag in BOILERPLATE

    @staticmethod
    def _doubt(tag: str, attributes: dict[str, str], parent: Node) -> str | None:
        """What class, role and id say against an element: "sure", "alone" (enough without a heading), "dense" (only with links or forms) or nothing.

        An id counts only where all its words are of the lists, since most ids are slugs of headings; one that names readers' texts also with units of
        one shape in its element.
        """
        if tag in ("article", "main", "body", "html") or tag in HEADINGS:
            return None
        classes = entities.unescape(attributes.get("class", "")).split()
        if any(named_for(c) == "inserted" for c in classes):
            return "sure"
        if tag == "a":  # a link within a sentence
            return "sure" if any(map(named_for, classes)) else None
        if tag == "p":
            return None
        names = classes + entities.unescape(attributes.get("role", "")).split()
        if any(map(named_for, names)):
            return "dense" if parent.inside else "sure"
        if named_for(entities.unescape(attributes.get("id", "")).strip()):
            return "dense" if parent.inside else "alone"
        return "dense" if any(NOT_ARTICLE.search(n) for n in names) else None

    def _settle(self) -> None:
        """Leave out what stands in suspects that their links, forms or marks speak against."""
        counted = set()
        for _, node, text in self.pieces:
            if node.suspect is not None:
                node.suspect.chars += len(text.strip())
                if node not in counted:
                    counted.add(node)
                    node.suspect.linked += node.linked
        for inner in reversed(self.suspects):
            if inner.outer is not None:
                for what in ("headings", "controls", "chars", "linked"):
                    setattr(inner.outer, what, getattr(inner.outer, what) + getattr(inner, what))
        for one in self.suspects:
            one.settle()
        out = lambda node: node.suspect is not None and node.suspect.out
        self.pieces = [p for p in self.pieces if not out(p[1])]
        for node in self.nodes:
            node.barred = node.barred or out(node)

    def scores(self) -> dict[Node, float]:
        """How much each container looks like the article: text of its own blocks, less that of links."""
        length: dict[Node, float] = {}
        for _, node, text in self.pieces:
            size = len(text.strip())
            if not size:
                continue
            weight = float(size) if node.linked == 0 else max(0.0, size - 2.0 * node.linked)
            share, up = 1.0, node
            while up.parent is not None:
                if up.tag in CONTAINERS:
                    length[up] = length.get(up, 0.0) + weight * share
                    share *= 0.9  # the smallest container of the whole text wins
                up = up.parent
        return {n: s * (1.5 if n.tag in ("article", "main") else 1.2 if ARTICLE.search(n.mark) else 1.0) for n, s in length.items() if s > 0}

    def text_of(self, chosen: list[Node]) -> str:
        """Blocks below the chosen elements (below the page if there are none): white space closed up, one line each."""
        inside: dict[Node, bool] = {n: True for n in chosen}

        def within(node: Node) -> bool:
            way = []
            while node is not None and node not in inside:
                way.append(node)
                node = node.parent
            found = node is not None and inside[node]
            inside.update(dict.fromkeys(way, found))
            return found

        out, last, parts = [], None, []
        for block, node, text in self.pieces:
            if not within(node):
                continue
            if block != last:
                out.append("".join(parts))
                last, parts = block, []
            parts.append(text)
        out.append("".join(parts))
        lines = (_SPACE.sub(" ", entities.unescape(x)).strip() for x in out)
        return "\n".join(x for x in lines if x)


def votes_of(source: str) -> list[tuple[str, float]]:
    """(path, score) of the containers of a page that score at least half of its best one, sharing one vote."""
    best: dict[str, float] = {}
    for node, score in Page(source).scores().items():
        best[node.path] = best.get(node.path, 0.0) + score
    if not best:
        return []
    top = max(best.values())
    return [(p, s / top) for p, s in sorted(best.items()) if 2 * s >= top]


def main_text(source: str, path: str | None) -> str:
    """Text below all containers on ``path``; without one, below the page's best container."""
    page = Page(source)
    chosen = [n for n in page.nodes if n.path == path and not n.barred] if path else []
    if not chosen or not page.text_of(chosen):
        scores = page.scores()
        chosen = [max(scores, key=lambda n: (scores[n], n.path))] if scores else [page.root]
    return page.text_of(chosen)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path with most votes on each host; ties go to the path that sorts first."""
    prepare(pages.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, score in votes_of(source or ""):
                    hosts.append(host)
                    paths.append(path)
                    scores.append(round(score * 1000))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], names=["host", "path", "score"])

    rows = pages.select(host_of(url).alias("host"), F.col(html).cast("string").alias("html")).where("html IS NOT NULL")
    counts = rows.mapInArrow(vote, "host string, path string, score long").groupBy("host", "path").agg(F.sum("score").alias("votes"))
    ranked = counts.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("minus"), "path")).alias("best"))
    return ranked.select("host", F.col("best.path").alias("path"))


def article_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``, from its whole html.

    Null and empty html give an empty text; a row without a url or an id is handled like any other, all pages without a host share one.
    Repeated rows give repeated results. Other columns are ignored whatever their names. An empty table gives no rows.
    """
    prepare(pages.sparkSession)
    paths = written(host_paths(pages, url, html), "paths")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    joined = rows.withColumn("host", host_of("url")).join(paths, "host", "left").select("page_id", "url", "html", "path")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
