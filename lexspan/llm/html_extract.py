"""Main text of web pages by consensus of each host's pages on where it stands.

Every page votes for the smallest container around all of its text that isn't boilerplate, by the container's generalised
path: tags with their classes from the root, numbers in classes blanked. It also hands in a hash of what stands at each of its
paths. Spark counts the votes of each host and path, and finds the paths where most pages of the host say the same. Each page is
then read again: the smallest container around its own text and its host's winning path, or the best-placed one it has.

What counts as boilerplate is told by tag (menus, footers, asides, scripts, ...; a header of the page's body) and role, or by class or id. A
class or id names boilerplate if all its words do, or place and shape it ("site-footer", "comment-list"; not "has-sidebar" or
"comments-open"); words that name menus need links, half of the element's text or more. Forms and elements that are boilerplate by
class or id alone are nevertheless read where they are wrapped around the page's article, main part or first heading, no such stands
outside of them, and they hold more text than what does.

Some blocks have no say in which container is chosen, but are read where they stand in it: headers inside the page's body, lists of
links (a block that is mostly a link, if it isn't a paragraph or heading, or one of LIST or more in a row), and blocks at a
path where most of the host's pages say one and the same, which is a small part of each. So a host confirms: of blocks in the
container, only headers and lists of links that are the same on its pages are left out. Nothing else is.

Pages are read in time that grows with their length: tags are found from left to right, and paths are numbers, a hash of the path above
and the element's own name.

Defined results. A null or empty page has empty text. A page without a url, or with one that isn't a URL, votes with the
others of that kind. Ties between paths go to the higher score, then to the smaller path. Repeated pages are each read, and
each votes; they count once where texts of a path are compared. White space is what str.split() takes for it; a line break
element is white space inside its block. Only id, url and html are read.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.llm.common import batch, materialize, table, tidy

#: Winning paths kept for a host; bytes of hosts and their paths that go to every executor; tasks for a host's pages beyond.
PLACES, SENT, SALTS = 3, 16 << 20, 16
#: A host's path says the same where more than half of its pages, and so many, have the same text, such a share of theirs at most.
ALIKE, SMALL = 3, 0.1
#: Blocks of links in a row that are a list of links, whatever elements they are.
LIST = 3

# Names of HTML elements, and words that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas object select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td".split())
#: Elements whose texts hosts are compared on, too, but which hold no article.
COMPARED = frozenset("header ol ul".split())
WHOLE = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption".split())
#: Words that name menus.
MENUS = frozenset("breadcrumb breadcrumbs menu nav navbar navigation pagination toolbar".split())
DROPPED = frozenset("nav footer aside button dialog menu head".split())
INLINE = frozenset(
    "a abbr acronym applet audio b bdi bdo big blink cite code data datalist del dfn em fieldset font frame frameset i ins kbd label legend map mark marquee math meter nobr optgroup option output picture progress q rb rp rt ruby s samp slot small span strike strong sub sup time tt u var video".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog menu navigation search".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
PLACED = frozenset(
    "area article articles author bar block body bottom box button buttons column container desktop entry fixed form global group head header holder icons inline inner item items js left link links list main media meta mobile news outer page panel post posts primary right row secondary section side site slot small stories story sticky tab text title top unit view widgets wrap wrapper".split()
)
ENDS_P = BLOCK - {"html", "body"}
SCOPE = {"li": "ul ol menu", "dd": "dl", "dt": "dl", "td": "tr table", "th": "tr table", "tr": "table"}
P_SCOPE = frozenset({"table", "td", "th", "article", "section", "div", "li", "button", "blockquote"})
KNOWN = BLOCK | VOID | RAW | DROPPED | INLINE

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_STOP = re.compile(r"""[><]|=\s*["']""")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


@dataclass
class Container:
    path: int
    first: int
    soft: int
    last: int = -1
    dropped: bool = False
    compared: bool = False


@dataclass
class Page:
    blocks: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    #: Whether each is a paragraph or heading; whether it stands in a header inside the page's body.
    prose: list[bool] = field(default_factory=list)
    heads: list[bool] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)

    def chars(self, c: Container) -> int:
        return sum(len(b) for b in self.blocks[c.first : c.last]) - sum(self.links[c.first : c.last])

    def link_lists(self) -> list[bool]:
        """Whether each block is part of a list of links."""
        linked = [2 * n > len(b) for b, n in zip(self.blocks, self.links, strict=True)]
        found, k = [], 0
        while k < len(linked):
            j = k
            while j < len(linked) and linked[j] == linked[k]:
                j += 1
            found += [linked[k] and (j - k >= LIST or not prose) for prose in self.prose[k:j]]
            k = j
        return found

    def around(self, paths: Sequence[int] = (), same: Collection[int] = ()) -> tuple[Container | None, list[int]]:
        """The smallest container around the page's text and the first of the paths that it has text in, and its blocks.

        Blocks at the paths of `same` aren't text here, unless nothing else is there. No container: all of the page.
        """
        inside = [0] * (len(self.blocks) + 1)
        for c in self.containers if same else ():
            if c.path in same:
                inside[c.first] += 1
                inside[c.last] -= 1
        alike = [n > 0 for n in accumulate(inside[:-1])]
        if all(alike):
            alike = [False] * len(alike)
        lists = self.link_lists()
        gone = [x and (y or z) for x, y, z in zip(alike, lists, self.heads, strict=True)]
        kept = [k for k, x in enumerate(gone) if not x]
        need = [k for k in kept if not (alike[k] or lists[k] or self.heads[k])]
        own = {c.path for c in self.containers if not c.dropped and c.first < c.last} if paths else set()
        for path in paths:
            if path in own:
                mine = [k for c in self.containers if c.path == path and not c.dropped for k in kept[bisect_left(kept, c.first) : bisect_left(kept, c.last)] if not alike[k]]
                if mine:
                    need += mine
                    break
        if not need:
            return None, kept
        first, last = min(need), max(need)
        at = None
        for c in self.containers:
            if not (c.dropped or c.compared) and c.first <= first and last < c.last and (at is None or c.last - c.first <= at.last - at.first):
                at = c
        return at, [k for k in kept if at.first <= k < at.last] if at else kept

    def text(self, paths: Sequence[int] = (), same: Collection[int] = ()) -> str:
        return "\n".join(self.blocks[k] for k in self.around(paths, same)[1])

    def said(self) -> tuple[int, dict[int, tuple[int, float]]]:
        """A hash of the page's blocks; and for each path a hash of those in all its containers, and their share of the text.
        A container's hash is a difference of two running ones."""
        upto, power, chars = [0], [1], [0]
        for b in self.blocks:
            upto.append((upto[-1] * _BASE + _hash(b.encode("utf-8", "surrogatepass"))) % _PRIME)
            power.append(power[-1] * _BASE % _PRIME)
            chars.append(chars[-1] + len(b))
        found: dict[int, tuple[int, int]] = {}
        for c in self.containers:
            if not c.dropped and c.first < c.last:
                n, (h, m) = c.last - c.first, found.get(c.path, (0, 0))
                found[c.path] = ((h * power[n] + upto[c.last] - upto[c.first] * power[n]) % _PRIME, m + chars[c.last] - chars[c.first])
        return upto[-1], {path: (h, m / chars[-1]) for path, (h, m) in found.items()}


def _hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") >> 4


@lru_cache(1 << 16)
def below(path: int, name: str) -> int:
    """The number of the path that goes on from a path to an element of this name."""
    return _hash(path.to_bytes(8, "little") + name.encode("utf-8", "surrogatepass"))


@lru_cache(1 << 16)
def names_boilerplate(token: str) -> bool:
    """Whether a class or an id has words that name boilerplate, and no others than such that place or shape it. "content" is one of
    those behind the name only."""
    words = _WORD.findall(_CAMEL.sub(r"\1 \2", token).lower())
    named = [k for k, w in enumerate(words) if w in WORDS]
    return bool(named) and all(w in WORDS or w in PLACED or (w == "content" and k > named[0]) for k, w in enumerate(words))


@lru_cache(1 << 16)
def names_menu(token: str) -> bool:
    """Of a class or id that names boilerplate: whether by words for menus alone."""
    return all(w in MENUS for w in _WORD.findall(_CAMEL.sub(r"\1 \2", token).lower()) if w in WORDS)


def _attributes(raw: str) -> tuple[str, bool, int]:
    """Generalised classes; whether the element is boilerplate by role; whether it is by class or id (2), or if it has links (1)."""
    if not raw or raw.isspace():
        return "", False, 0
    classes, hard, soft = "", False, 0
    for name, value in _ATTR.findall(raw):
        name, value = name.lower(), html.unescape(value.strip("\"'")) if value else ""
        if name == "role":
            hard = hard or value.strip().lower() in ROLES
        elif name in ("class", "id"):
            own = value.split()
            soft = max([soft, *(1 if names_menu(x) else 2 for x in own if names_boilerplate(x))])
            if name == "class":
                classes = "".join("." + re.sub(r"\d+", "0", c) for c in sorted(set(own)))
    return classes, hard, soft


def _tag_end(source: str, at: int) -> tuple[int, bool]:
    """Where a tag ends that goes on at `at`, and whether by ">", not by the next "<" or the page's end."""
    while m := _STOP.search(source, at):
        if m[0] == ">":
            return m.start(), True
        if m[0] == "<":
            return m.start(), False
        close = source.find(m[0][-1], m.end())
        at = close + 1 if close >= 0 else m.end()  # a quote that nothing closes is a letter
    return len(source), False


def parse(source: str) -> Page:
    """Blocks and containers of a page, boilerplate left out. Elements that end implicitly are ended; a cut page ends all. What looks like
    a tag, has no name of HTML and no end is text."""
    page, buffer, linked = Page(), [], 0
    owners: list[int] = []  # of each block: the element around it that may be boilerplate, or -1
    softs: list[tuple[int, bool]] = []  # of each such element: the one around it, whether only links make it that
    anchors: list[int] = []  # of each article, main part and first heading: such an element around it, or -1
    # tag, path, dropped, container, such an element, in a header inside the body, nearest block
    stack: list[tuple[str, int, bool, int, int, bool, str]] = [("", 0, False, -1, -1, False, "")]
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if buffer:
            if text := " ".join(html.unescape("".join(buffer)).split()):
                page.blocks.append(text)
                page.links.append(min(linked, len(text)))
                owners.append(stack[-1][4])
                page.heads.append(stack[-1][5])
                page.prose.append(stack[-1][6] in PROSE)
            buffer.clear()
        linked = 0

    def close() -> None:
        tag, own = stack[-1][0], stack[-1][3]
        if tag in BLOCK:
            flush()
        stack.pop()
        opened[tag] -= 1
        if own >= 0 and stack[-1][3] != own:
            page.containers[own].last = len(page.blocks)

    def end(tag: str, within: Collection[str] = ()) -> None:
        if opened[tag] < 1:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                while len(stack) > k:
                    close()
                return
            if stack[k][0] in within:
                return

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][2]:
            buffer.append(text)
            if any(e[0] == "a" for e in stack[-4:]):
                linked += len(text.strip())

    at, n = 0, len(source)
    while at < n:
        start = source.find("<", at)
        if start < 0:
            say(source[at:])
            break
        say(source[at:start])
        if source.startswith("<!--", start):
            stop = source.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else n
            continue
        if source[start + 1 : start + 2] in ("!", "?"):
            stop = source.find(">", start)
            at = stop + 1 if stop >= 0 else n
            continue
        m = _NAME.match(source, start)
        if not m:
            say("<")
            at = start + 1
            continue
        tag, (at, whole) = m[2].lower(), _tag_end(source, m.end())
        if not whole and not m[1] and tag not in KNOWN:
            say(source[start:at])
            continue
        attributes, at = source[m.end() : at], at + whole
        if not whole and at == n:
            break  # a tag that the page's end cuts off
        if m[1]:
            if tag in BLOCK:
                flush()
            if tag not in VOID:
                end(tag, {"table", "article", "body"} - {tag} if tag in ("p", "b", "i", "a", "span", "em", "strong", "li", "td", "tr") else ())
            elif tag == "br":
                say(" ")
            continue
        if tag in RAW:
            stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
            if not stop:
                unclosed.add(tag)
            at = stop.end() if stop else n if tag in ("script", "style") else at
            continue
        if tag == "br":
            say(" ")
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in ENDS_P:
            end("p", P_SCOPE)
        if tag in SCOPE:
            end(tag, SCOPE[tag].split())
        _, path, dropped, own, soft, head, nearest = stack[-1]
        classes, hard, named = _attributes(attributes)
        path = below(path, tag + classes) if tag in BLOCK else path
        if tag == "header" and not opened["article"] and not opened["main"]:
            head = True
            dropped = dropped or not any(opened[x] > 0 for x in ("div", "section", "td"))
        dropped = dropped or hard or tag in DROPPED
        if (named or tag == "form") and tag not in ("html", "body") and not dropped:
            softs.append((soft, named == 1 and tag != "form"))
            soft = len(softs) - 1
        if not dropped and (tag in WHOLE or tag == "h1" or "role" in attributes and re.search(r"""role\s*=\s*["']?main\b""", attributes)):
            anchors.append(soft)
        if tag in CONTAINER or tag in COMPARED:
            page.containers.append(Container(path, len(page.blocks), soft, dropped=dropped, compared=tag in COMPARED))
            own = len(page.containers) - 1
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, path, dropped, own, soft, head, tag if tag in BLOCK else nearest))
        opened[tag] += 1
    while len(stack) > 1:
        close()
    flush()
    for c in page.containers:
        if c.last < 0:
            c.last = len(page.blocks)
    return _without(page, owners, softs, anchors) if softs else page


def _without(page: Page, owners: list[int], softs: list[tuple[int, bool]], anchors: list[int]) -> Page:
    """The page without the blocks of elements that are boilerplate by class or id."""
    held, linked = [0] * len(softs), [0] * len(softs)  # characters in each, with those within it; those of links
    outside = 0
    for text, n, own in zip(page.blocks, page.links, owners, strict=True):
        if own < 0:
            outside += len(text)
        else:
            held[own] += len(text)
            linked[own] += n
    for k in range(len(softs) - 1, -1, -1):
        if softs[k][0] >= 0:
            held[softs[k][0]] += held[k]
            linked[softs[k][0]] += linked[k]
    cleared: set[int] = set()
    if anchors and min(anchors) >= 0:
        for k in anchors:
            chain = []
            while k >= 0 and k not in cleared:
                chain.append(k)
                k = softs[k][0]
            if chain and (k >= 0 or held[chain[-1]] > outside):
                cleared.update(chain)
                break  # the first such is the article's; others may be comments
    # an element within one that is dropped is dropped, too
    gone = []
    for k, (around, by_links) in enumerate(softs):
        text_alone = by_links and 2 * linked[k] < held[k]
        gone.append(k not in cleared and not text_alone or (around >= 0 and gone[around]))
    keep = [own < 0 or not gone[own] for own in owners]
    place = [0, *accumulate(keep)]
    made = Page(*([v for v, x in zip(values, keep, strict=True) if x] for values in (page.blocks, page.links, page.prose, page.heads)))
    for c in page.containers:
        made.containers.append(Container(c.path, place[c.first], c.soft, place[c.last], c.dropped or (c.soft >= 0 and gone[c.soft]), c.compared))
    return made


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


CAST = pa.schema([("host", pa.string()), ("path", pa.int64()), ("n", pa.int64()), ("score", pa.int64()), ("said", pa.int64()), ("page", pa.int64()), ("share", pa.float64())])


def votes(pages: DataFrame) -> DataFrame:
    """A row for each path of each page (host, html) that has text: n is 1 for the one that the page votes for, else 0;
    hashes of what the page says there and in all, and the former's share."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, source in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
                page = parse(source or "")
                c, (whole, found) = page.around()[0], page.said()
                for path, (said, share) in found.items():
                    own = c is not None and path == c.path
                    rows.append((host, path, int(own), page.chars(c) if own else 0, said, whole, share))
            yield batch(list(zip(*rows, strict=True)) or [()] * len(CAST), CAST)

    return pages.select("host", "html").mapInArrow(run, "host string, path long, n long, score long, said long, page long, share double")


def consensus(cast: DataFrame, places: int = PLACES) -> DataFrame:
    """host, paths, same: the best-placed paths of each host, and those where its pages say the same."""
    counted = cast.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("score").alias("score")).where("n > 0")
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    placed = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= places)
    best = placed.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))
    texts = cast.groupBy("host", "path", "said", "page").agg(F.max("share").alias("share"))
    texts = texts.groupBy("host", "path", "said").agg(F.count("*").alias("pages"), F.max("share").alias("share"))
    paths = texts.groupBy("host", "path").agg(F.sum("pages").alias("all"), F.max(F.struct("pages", "share")).alias("most"))
    alike = paths.where((F.col("most.pages") >= ALIKE) & (2 * F.col("most.pages") > F.col("all")) & (F.col("most.share") <= SMALL))
    return best.join(alike.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("same")), "host", "left")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    winners = materialize(consensus(materialize(votes(pages), "html-votes")), "html-winners")
    size = winners.agg(F.sum(F.octet_length("host") + 8 * (F.size("paths") + F.coalesce(F.array_size("same"), F.lit(0))))).first()[0] or 0
    if size <= SENT:
        joined = pages.join(F.broadcast(winners), "host", "left")
    else:  # a host's pages are dealt out, and its winners go to each part
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = zip(b["html"].to_pylist(), b["paths"].to_pylist(), b["same"].to_pylist(), strict=True)
            text = [parse(s or "").text(p or (), frozenset(q or ())) for s, p, q in read]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "paths", "same").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
