"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text that stands in them; scores become votes for generalised tag-class paths, summed by
host in Spark. A second pass re-extracts every page from the elements on its host's winning path, and only pages without such an
element fall back on their own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .url_rules import url_host

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_OPAQUE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>", re.S)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_TOKEN = re.compile(r"[a-z]+|\d+", re.I)
_DIGITS = re.compile(r"\d+")

#: Winning paths of so many hosts go to every task; more are joined by host and salt.
BROADCAST_HOSTS, SALTS = 50_000, 64

# Element names by their part in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math nav footer aside form button select option datalist dialog menu iframe object canvas audio video textarea title head".split())
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "html head header footer nav aside form fieldset address blockquote dd dl dt figure figcaption h1 h2 h3 h4 h5 h6 hgroup li ol p pre table tbody thead tfoot tr th caption ul details summary legend search".split()
)
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall "
    "sidebar widget related recommended share sharing social nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar comment comments respond disqus".split()
)
#: An element that holds this share of a page's text isn't noise by its class or id.
LAYOUT_SHARE = 0.9
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


def path_key(above: int, step: str) -> int:
    """A path is known by the hash of its last step and of the path above, so that deep nesting costs no longer names."""
    return xxhash.xxh64_intdigest(step, above & (1 << 64) - 1) - (1 << 63)


class Tags:
    """Markup of a page, one piece at a time, in time linear in the page whatever its quotes and brackets."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = source.rfind(">")
        self.dead: set[int] = set()  # quotes from which no end of a tag is reached

    def _end(self, at: int) -> int:
        """Of the ``>`` that ends a tag: the next one outside quotes, or the next one if there's none; -1 without any."""
        if at > self.last:
            return -1
        seen, i = [], at
        while (m := _STOP.search(self.source, i)) is not None:
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            i = self.source.find(m[0], m.end()) + 1
            if not i:
                break
        self.dead.update(seen)
        return self.source.find(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """``(start, end, name, closing, attributes)``; no name for comments and the like. ``send`` of a place goes on from there."""
        source, at = self.source, 0
        while (start := source.find("<", at)) >= 0:
            tag = _TAG.match(source, start)
            if tag:
                end = self._end(tag.end())
                if end < 0:
                    return
                jump = yield start, end + 1, tag[2].lower(), bool(tag[1]), source[tag.end() : end]
                at = jump if jump is not None else end + 1
            elif (start <= self.last or source.startswith(("<!--", "<![CDATA["), start)) and (m := _OPAQUE.match(source, start)):
                yield start, m.end(), "", False, ""
                at = m.end()
            else:
                at = start + 1


class Page:
    """Blocks of a page in order. A block knows its text, the length of its links, its innermost container and if it's noise."""

    def __init__(self, source: str) -> None:
        self.keys: list[int] = []  # of containers' paths
        self.wide: list[int] = []  # container in which a path that leads through an article (or else a main) element ends
        self.parents: list[int] = []
        self.blocks: list[tuple[str, int, int, bool]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, int, int]] = []  # open block elements: name, container, noise, and as below
        text: list[str] = []
        linked = links = 0
        container, noise, named, body = -1, False, -1, -1
        names: list[int] = []  # elements with a noisy class or id: the one around each
        bodies: list[tuple[str, int, int]] = []  # articles and mains: name, the article or main around, the noisy name around
        found: list[tuple[str, int, int, bool, int, int]] = []
        open_: Counter = Counter()  # names on the stack
        articles: list[tuple[int, int]] = []  # of each container: the outermost article and main around it

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    found.append((joined, linked, container, noise, named, body))
                text.clear()
            linked = 0

        def back(to: int) -> None:
            nonlocal container, noise, named, body
            flush()
            open_.subtract(x[0] for x in stack[to:])
            del stack[to:]
            container, noise, named, body = stack[-1][1:] if stack else (-1, False, -1, -1)

        at, tags = 0, iter(Tags(source))
        jump = None
        while True:
            try:
                start, end, name, closing, inner = tags.send(jump)
            except StopIteration:
                break
            jump = None
            if start > at:
                part = entities.unescape(source[at:start])
                text.append(part)
                if links:
                    linked += len(part.strip())
            at = end
            if not name:
                continue
            if name in RAW and not closing:  # its content is no markup
                over = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = jump = over.end() if over else len(source)
                continue
            if name in ("br", "hr"):
                text.append(" ")
                continue
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
                continue
            if name in VOID or name not in BLOCKS and name not in DROPPED:
                continue
            if closing:
                if open_[name] > 0:
                    back(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                else:
                    flush()
                links = 0
                continue
            flush()
            links = 0
            ends = CLOSES_ITSELF.get(name, ())
            closers = {"p", *ends}
            i = len(stack) - 1
            while i >= 0 and any(open_[x] > 0 for x in closers):
                if stack[i][0] in SCOPES or stack[i][0] in CONTAINERS and name not in ("td", "th", "tr"):
                    break
                if stack[i][0] in closers:
                    back(i)
                i -= 1
            attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(inner)}
            loud = noise or name in DROPPED or attributes.get("role", "").lower() in NOISE_ROLES
            if not loud and name == "header":
                loud = open_["article"] <= 0 and open_["main"] <= 0
            if not loud and attributes and name not in ("html", "body", "article", "main"):
                if any(t in NOISE for a in ("class", "id") for t in map(str.lower, _TOKEN.findall(attributes.get(a, "")))):
                    names.append(named)
                    named = len(names) - 1
            if not loud and name in ("article", "main"):
                bodies.append((name, body, named))
                body = len(bodies) - 1
            if name in CONTAINERS:
                mark = " ".join(sorted(set(_DIGITS.sub("#", attributes.get("class", "")).split()))) or _DIGITS.sub("#", attributes.get("id", ""))
                around = articles[container] if container >= 0 else (-1, -1)
                own = len(self.keys)
                articles.append((own if around[0] < 0 and name == "article" else around[0], own if around[1] < 0 and name == "main" else around[1]))
                self.keys.append(path_key(self.keys[container] if container >= 0 else 0, name + ("." + mark if mark else "")))
                self.wide.append(next((i for i in articles[own] if i >= 0), own))
                self.parents.append(container)
                container = own
            noise = loud
            open_[name] += 1
            stack.append((name, container, noise, named, body))
        if at < len(source):
            text.append(entities.unescape(source[at:]))
        flush()
        silent = self._silent(found, names, bodies)
        self.blocks = [(t, n, c, loud or i >= 0 and silent[i]) for t, n, c, loud, i, _ in found]

    @staticmethod
    def _silent(blocks: list[tuple[str, int, int, bool, int, int]], names: list[int], bodies: list[tuple[str, int, int]]) -> list[bool]:
        """Which elements with a noisy class or id are noise or inside it. Those around the longest main (or else article) aren't, nor, on a
        page without either, those that hold nearly all text: such names describe the layout."""
        inside, around = [0] * len(bodies), [0] * len(names)
        whole = 0
        for text, linked, _, loud, i, b in blocks:
            own = 0 if loud else max(0, len(text) - 2 * linked)
            whole += own
            if b >= 0:
                inside[b] += own
            if i >= 0:
                around[i] += own
        for b in range(len(bodies) - 1, -1, -1):  # what is around comes before what is inside
            if bodies[b][1] >= 0:
                inside[bodies[b][1]] += inside[b]
        for i in range(len(names) - 1, -1, -1):
            if names[i] >= 0:
                around[names[i]] += around[i]
        layout = set()
        filled = [b for b in range(len(bodies)) if inside[b]]
        if filled:
            i = bodies[max(filled, key=lambda b: (bodies[b][0] == "main", inside[b], -b))][2]
            while i >= 0:
                layout.add(i)
                i = names[i]
        else:
            layout.update(i for i, n in enumerate(around) if n and n >= LAYOUT_SHARE * whole)
        silent: list[bool] = []
        for i, outer in enumerate(names):
            silent.append(i not in layout or outer >= 0 and silent[outer])
        return silent

    def scores(self) -> dict[tuple[int, int], float]:
        """Containers' paths, and where these end if widened, by their text without links; half of it counts for the parent, a quarter
        for its parent, and so on thrice.

        A widened path ends at the article (or else main) element that it leads through: headings beside inner sections belong to it.
        """
        found: Counter = Counter()
        for text, linked, container, noise in self.blocks:
            own, share = max(0, len(text) - 2 * linked), 1.0
            while not noise and own and container >= 0 and share >= 0.125:
                found[self.keys[container], self.keys[self.wide[container]]] += own * share
                container, share = self.parents[container], share / 2
        return found

    def text(self, path: int | None) -> str | None:
        """Blocks inside elements on ``path``; None if the page has no such element. Without a path: all blocks but noise."""
        if path is None:
            return " ".join(t for t, _, _, noise in self.blocks if not noise)
        inside = [False] * len(self.keys)
        for i, own in enumerate(self.keys):
            inside[i] = own == path or self.parents[i] >= 0 and inside[self.parents[i]]
        if True not in inside:
            return None
        return " ".join(t for t, _, c, noise in self.blocks if not noise and c >= 0 and inside[c])


def best_path(scores: dict[tuple[int, int], float]) -> int | None:
    return max(scores, key=lambda p: (scores[p], p))[1] if scores else None


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path)``: each page deals a thousand votes to its containers; the widened path with most votes wins, then the larger key."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            votes: Counter = Counter()
            for host, source in zip(b["host"], b["html"], strict=True):
                scores = Page(source).scores()
                whole = sum(scores.values())
                for (_, path), s in scores.items():
                    votes[host, path] += round(1000 * s / whole)
            yield pd.DataFrame([(h, p, n) for (h, p), n in votes.items()], columns=["host", "path", "votes"])

    votes = pages.mapInPandas(vote, "host string, path long, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Blocks are joined by one space; inside a block, references are decoded and white space becomes one space. A null page, or one
    without text, gives the empty text. Pages without a host vote together. A page that lacks its host's path uses its own best
    container, and one without any container all its text outside menus, forms and the like. Repeated rows are extracted alike;
    other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), url_host(F.col("url")).alias("host"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for source, path in zip(b["html"], b["path"], strict=True):
                page = Page(source)
                text = page.text(int(path)) if isinstance(path, str) else None
                if not text:
                    text = page.text(best_path(page.scores()))
                texts.append(text or "")
            yield b[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    paths = durable(host_paths(rows).withColumn("path", F.col("path").cast("string")))  # in pandas, numbers with nulls lose digits
    if paths.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:  # pages of one host may be many: each host's path is copied to every salt, and its pages are dealt among them
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    # page ids too pass through pandas as strings
    out = joined.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(extract, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
