"""HTML extraction by equivalence-class template deduction.

A page is a list of tokens: its tags, each with the path of blocks that it stands in, and
its text blocks. Tokens that occur equally often on every page of a host form an equivalence
class, by their occurrence vectors. A tag that comes once on a page now and then by chance
has a vector of its own; so a class needs two members, or a tag that repeats on a page. As a
token is a tag with its whole path, members nest in the same way on all pages; a class hangs
below the class of the tag around it. Text between the tags of the classes lies in slots.

The classes decide which slots go. Static: a text that has the vector of the tag right around
it is part of the template, even in an article; one that comes with only some of its tag's
occurrences is not. Records: a class of three tags or more that repeats together, below a tag
of another class, is a list of comments, teasers or the like. Then slots that are mostly
links, those outside the deepest tag that holds most of the host's free text, and those that a
class, id or role word marks as boilerplate on several pages of the host. Such words alone
decide on hosts with too few pages only. Elements that are boilerplate by name (nav, form,
...) always go; a page's article or main element, if it has one, is its main slot.

Counts by (host, token) are summed before the shuffle, with a hash of each (page, count)
that adds up to a fingerprint of the occurrence vector: no task holds all pages of a host.
Copies of a page count as one.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantstate.llm.common import at, blank_if_null, numbered, stage
from plantstate.llm.urls import host_of

#: Elements by what becomes of them.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "title", "xmp")
DROPPED = frozenset(
    "head nav header footer aside form menu dialog button label input fieldset datalist select option optgroup canvas audio video map object svg annotation annotation-xml".split()
)
#: Kinds of tags: 1 for those that hold a text as such, 2 for the forms that a text takes, 0 for all others.
KINDS = {n: 1 for n in "html body main article p".split()} | {n: 2 for n in "h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table thead tbody tfoot tr th td caption figure figcaption blockquote pre details summary".split()}
#: Elements in which tags can close themselves; a block that starts in one ends it.
FOREIGN = ("svg", "math")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Whole words of class, id or role that mark boilerplate, on other elements than these.
UNMARKED = frozenset(("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "p"))
MARKED = re.compile(
    r"ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|"
    r"notices?|popup|promo|promotion|related|replies|reply|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget|contentinfo|complementary|search|"
    r"(?:site|page|main|global|primary|secondary|top|bottom)[_-](?:header|footer|nav|navbar|navigation|menu)|(?:left|right)[_-]sidebar|cookies?[_-](?:banner|bar|consent|notice)|"
    r"ad[_-](?:banner|box|container|slot|unit)|comments?[_-](?:area|form|list|section)|(?:share|sharing|social)[_-](?:bar|buttons|icons|links|media)|"
    r"related[_-](?:articles|links|posts)|newsletter[_-](?:form|signup)|search[_-](?:box|form)",
    re.I,
)
#: A comment, CDATA, a declaration or a tag. As in browsers a tag ends at the first > that is in no quoted value, or with the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*+(?:>|$)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|$)",
    re.S,
)
ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
END = {name: re.compile(rf"</{name}\s*(?:>|$)", re.I) for name in RAW}
SPACE = re.compile(r"[ \t\n\r\f\v ]+")
#: Elements whose start ends an open element of the same kind.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def node_of(name: str, attrs: str) -> str:
    """A tag as a step of a path: its name, and class and role if it has them."""
    marks = [f"{m[1].lower()}={SPACE.sub(' ', m[2] or m[3] or m[4] or '').strip()}" for m in ATTR.finditer(attrs)] if attrs else []
    return name + "".join(f"[{x}]" for x in sorted(marks) if not x.startswith("id=") or has_mark(x[3:]))


def has_mark(value: str) -> bool:
    """Whether a whole word of an attribute marks boilerplate: no-sidebar and search-algorithms don't."""
    return any(map(MARKED.fullmatch, value.split()))


@lru_cache(maxsize=50_000)
def is_marked(node: str) -> bool:
    name, _, marks = node.partition("[")
    return bool(marks) and name not in UNMARKED and any(has_mark(x.partition("=")[2].rstrip("]")) for x in marks.split("["))


def is_dropped(node: str) -> bool:
    return node.partition("[")[0] in DROPPED or is_marked(node)


@lru_cache(maxsize=200_000)
def key_of(up: int, node: str) -> int:
    """The 64-bit token of a tag: its node and the token of the block around it."""
    return xxhash.xxh64_intdigest(f"{up}>{node}".encode("utf-8", "surrogatepass")) - (1 << 63)


def text_key(up: int, block: str) -> int:
    return xxhash.xxh64_intdigest(f"{up}\n{block}".encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass(frozen=True)
class Template:
    """tags and texts of a host's classes, its static texts, tags of records and of link slots, the tag of the main slot
    (or None) and whether there were pages enough."""

    tokens: frozenset[int] = frozenset()
    static: frozenset[int] = frozenset()
    records: frozenset[int] = frozenset()
    links: frozenset[int] = frozenset()
    main: int | None = None
    known: bool = False


NO_TEMPLATE = Template()


class Frame:
    """An open element: what its blocks need to know of the elements around it, each looked up once."""

    __slots__ = ("name", "block", "key", "depth", "marked", "nested", "article", "hard", "soft", "gone", "link", "inside", "linked", "record", "chars", "link_chars")

    def __init__(self, up: Frame | None, name: str, node: str, template: Template):
        self.marked = is_marked(node)
        # Inline elements don't tell slots apart, unless they have a mark.
        block = up is None or name in BLOCKS or self.marked
        self.name, self.chars, self.link_chars = name, 0, 0
        self.block = self if up is None or name in BLOCKS else up.block
        self.key = key_of(up.key if up else 0, node) if block else up.key
        self.depth = up.depth + block if up else 0
        self.nested = up is None or (up.nested and self.key in template.tokens)
        # A marked element is boilerplate if pages of its host share it, or if there are too few of them to tell.
        marked = self.marked and (not template.known or self.key in template.tokens)
        named = name in DROPPED
        if up is None:
            self.article, self.hard, self.soft, self.gone, self.link, self.linked, self.record = 0, False, False, False, False, False, False
            self.inside = template.main is None
            return
        # 0 outside, 1 in a main element, 2 in an article. What one stands in counts by hard and soft; gone starts anew in it.
        self.article = max(up.article, {"main": 1, "article": 2}.get(name, 0))
        self.hard = up.hard or (named and name != "form" and up.article < 2)
        self.soft = up.soft or (marked and up.article < 2)
        self.gone = up.article == self.article and (up.gone or named or marked)
        self.link = up.link or name == "a"
        self.inside = up.inside or self.key == template.main
        self.linked = up.linked or self.key in template.links
        self.record = up.record or self.key in template.records

    @property
    def place(self) -> str:
        """Where its blocks lie: "main", "wrapped" (an article with marked elements around it), "other" or "dropped"."""
        if self.article:
            return "dropped" if self.hard or self.gone else "wrapped" if self.soft else "main"
        return "dropped" if self.gone else "other"


#: Elements over which an open element isn't closed by one of its kind.
WALLS = frozenset(("ul", "ol", "table", "article", "div", "section", "dl", "nav", "td"))


class Walk:
    """One pass over a page: (frame, text) of each block in page order by blocks(); every closed frame goes to closed(), with the one around it."""

    def __init__(self, text: str, template: Template = NO_TEMPLATE, closed: Callable[[Frame, Frame], None] | None = None):
        self.text, self.template, self.closed = text, template, closed
        self.stack = [Frame(None, "", "", template)]
        # Places in the stack by name, and of blocks and walls, so that deep pages need no search.
        self.at: dict[str, list[int]] = {}
        self.block_at, self.wall_at = [0], [0]
        self.foreign, self.has_main = 0, False

    def push(self, name: str, node: str) -> None:
        k = len(self.stack)
        self.stack.append(Frame(self.stack[-1], name, node, self.template))
        self.at.setdefault(name, []).append(k)
        self.has_main = self.has_main or (self.stack[-1].article > 0 and self.stack[-1].place == "main")
        if name in BLOCKS:
            self.block_at.append(k)
        if name in WALLS:
            self.wall_at.append(k)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            f = self.stack.pop()
            self.at[f.name].pop()
            for places in (self.block_at, self.wall_at):
                if places[-1] == len(self.stack):
                    places.pop()
            self.stack[-1].chars += f.chars
            self.stack[-1].link_chars += f.link_chars
            if self.closed:
                self.closed(f, self.stack[-1])
        if k <= self.foreign:
            self.foreign = 0

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name, or 0."""
        found = self.at.get(name)
        return found[-1] if found else 0

    def blocks(self) -> Iterator[tuple[Frame, str]]:
        text, stack, i, size = self.text, self.stack, 0, len(self.text)
        held: list[str] = []
        held_at = stack[0]

        def flush() -> tuple[Frame, str] | None:
            nonlocal held
            block = " ".join(references.unescape("".join(held)).split())
            held = []
            return (held_at, block) if block else None

        while i < size:
            m = TOKEN.search(text, i)
            stop = m.start() if m else size
            if stop > i:
                if not held:
                    held_at = stack[-1]
                held.append(text[i:stop])
            if not m:
                break
            i = m.end()
            if m["cdata"] is not None:
                if not held:
                    held_at = stack[-1]
                held.append(m["cdata"])
                continue
            name = (m["name"] or "").lower()
            if not name:
                continue
            node = node_of(name, m["attrs"])
            if name in BLOCKS or name in RAW or is_dropped(node):
                if done := flush():
                    yield done
            elif name in VOID and name != "wbr" and held:
                held.append(" ")
            if m["close"]:
                k = self.last(name)
                # An inline end tag doesn't close blocks around it.
                if k and (name in BLOCKS or self.block_at[-1] <= k):
                    # Text behind a dropped inline element is not part of it.
                    if (name in DROPPED or stack[k].marked) and (done := flush()):
                        yield done
                    self.pop_to(k)
                continue
            if self.foreign:
                if name in BLOCKS and self.last("foreignobject") <= self.foreign:
                    self.pop_to(self.foreign)
                elif m[0].endswith("/>"):
                    continue
            if name in RAW:
                end = END[name].search(text, i)
                i = end.end() if end else size
                continue
            for other in CLOSES.get(name, ()):
                k = self.last(other)
                if k and self.wall_at[-1] <= k:
                    self.pop_to(k)
            if name not in VOID:
                if name in FOREIGN:
                    if m[0].endswith("/>"):
                        continue
                    self.foreign = self.foreign or len(stack)
                self.push(name, node)
        if done := flush():
            yield done
        self.pop_to(1)


def page_tokens(text: str) -> dict[int, list[int]]:
    """token: times, free characters, link characters, depth (-1 for text), mark, token around it and kind of a page's tags and text blocks."""
    out: dict[int, list[int]] = {}

    def closed(f: Frame, up: Frame) -> None:
        if f.name in BLOCKS or f.marked:
            x = out.setdefault(f.key, [0, 0, 0, f.depth, 0, up.key, KINDS.get(f.name, 0)])
            x[0] += 1
            x[1] += f.chars
            x[2] += f.link_chars
            x[4] |= f.marked

    for frame, block in Walk(text, closed=closed).blocks():
        if frame.name in DROPPED or frame.hard:
            continue
        # An inline element may be closed by now, the block around it isn't.
        if frame.link:
            frame.block.link_chars += len(block)
        else:
            frame.block.chars += len(block)
        x = out.setdefault(text_key(frame.key, block), [0, 0, 0, -1, 0, frame.key, 0])
        x[0] += 1
    return out


def tokens(pages: DataFrame) -> DataFrame:
    """host, page, token, n, chars, links, depth, marked, up, kind: how often each token occurs on each page, and for tags
    the characters of free and of link text in them. Only 64-bit hashes leave the task; copies of a page count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                out = []
                for host, page, text in zip(*(batch[c].iloc[i : i + 200] for c in ("host", "page", "html"))):
                    out += [(host, page, t, *x) for t, x in page_tokens(text).items()]
                yield pd.DataFrame(out, columns=["host", "page", "token", "n", "chars", "links", "depth", "marked", "up", "kind"])

    found = pages.select("host", "page", "html").mapInPandas(run, "host string, page long, token long, n long, chars long, links long, depth long, marked long, up long, kind long")
    return found.groupBy("host", "page", "token").agg(*[F.max(c).alias(c) for c in ("n", "chars", "links", "depth", "marked", "up", "kind")])


def classes(pages: DataFrame, least_pages: int = 2, least_share: float = 0.5) -> DataFrame:
    """host, token, support, vector, depth, chars, links, up, kind, times, size, tags, form: the members of the classes of each
    host with at least least_pages different pages.

    A class is the set of tokens with one occurrence vector, whose fingerprint is a sum of
    hashes of (page, count), on at least least_pages pages and least_share of the host's; it has
    two members, or one tag that repeats on a page. Tags with a mark need neither. size, tags:
    its members, and those that are tags; times: the most often that it comes on a page; form:
    whether one of its tags is a form that text takes (a heading, list, table or figure)."""
    vector = F.sum(F.pmod(F.xxhash64("page", "n"), F.lit(1 << 40)))
    seen = tokens(pages.where("host <> ''")).groupBy("host", "token").agg(F.count("*").alias("support"), vector.alias("vector"), F.max("n").alias("times"), *[F.sum(c).alias(c) for c in ("chars", "links")], *[F.max(c).alias(c) for c in ("depth", "marked", "up", "kind")])
    size = pages.where("host <> ''").select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    # Tokens of one page go before the join; what it keeps is written, so that a hot host's part of the join can be split.
    often = seen.where(F.col("support") >= least_pages).join(stage(size, "sizes"), "host").where((F.col("support") >= least_share * F.col("pages")) | (F.col("marked") > 0))
    often = stage(often.drop("pages"), "often")
    by = ["host", "support", "vector"]
    alike = often.groupBy(*by).agg(F.count("*").alias("size"), F.count(F.when(F.col("depth") >= 0, 1)).alias("tags"), F.max(F.col("kind") == 2).alias("form"))
    whole = (F.col("size") > 1) | ((F.col("depth") >= 0) & (F.col("times") > 1)) | (F.col("marked") > 0)
    return often.join(alike, by).where(whole)


def templates(pages: DataFrame, least_pages: int = 2, least_share: float = 0.5, main_share: float = 0.6) -> DataFrame:
    """host, tokens, static, records, links, main: the template of each host, from its classes().

    static: texts of the class of the tag right around them, if that is not a form that text
    takes. records: the outermost tags of classes of three tags or more that repeat on a page and
    hold no headings, lists, tables or figures, below a tag of another class. links: tags most of
    whose text is links. main: the deepest tag that holds main_share of the host's free text. A
    host has at most 1 / least_share times as many tokens as its pages have on average (and
    marked tags), whatever the number of its pages."""
    member = stage(classes(pages, least_pages, least_share), "classes")
    around = member.where("depth >= 0").select("host", F.col("token").alias("up"), F.struct("support", "vector").alias("around"), F.col("kind").alias("up_kind"))
    m = member.join(around, ["host", "up"], "left")
    same = F.coalesce(F.col("around") == F.struct("support", "vector"), F.lit(False))
    static = (F.col("depth") < 0) & same & (F.col("up_kind") == 0)
    record = (F.col("depth") >= 0) & (F.col("times") > 1) & (F.col("tags") >= 3) & ~F.col("form") & ~same & (F.col("up_kind") == 0)
    body = F.struct("chars", "links", "depth", "token")
    of = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("token"))))
    host = m.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("tokens"), of(static).alias("static"), of(record).alias("records"), F.collect_list(F.when(F.col("depth") >= 0, body)).alias("bodies"))
    links = F.transform(F.filter("bodies", lambda x: x["links"] > x["chars"]), lambda x: x["token"])
    whole = F.array_max(F.transform("bodies", lambda x: x["chars"]))
    main = F.array_max(F.transform(F.filter("bodies", lambda x: (x["chars"] > 0) & (x["chars"] >= main_share * whole)), lambda x: F.struct(x["depth"].alias("depth"), x["chars"].alias("chars"), x["token"].alias("token"))))
    return host.select("host", "tokens", "static", "records", links.alias("links"), main["token"].alias("main"))


def main_text(text: str, template: Template = NO_TEMPLATE) -> str:
    """The blocks of a page's slots, joined by newlines.

    Slots in an article or main element are the text; marks of the elements around it don't
    count, unless another article or main has no marks around it. A page without one has the
    slots of the template's main tag, less link slots and text that is part of the template.
    Static texts and records of the template go, unless nothing else is left."""
    in_main: list[tuple[str, bool]] = []
    wrapped: list[tuple[str, bool]] = []
    others: list[tuple[str, bool]] = []
    outside: list[tuple[str, bool]] = []
    walk = Walk(text, template)
    for frame, block in walk.blocks():
        place = frame.place
        if place == "dropped":
            continue
        key = text_key(frame.key, block) if template.known else 0
        found = block, not (frame.record or key in template.static)
        if place == "main":
            in_main.append(found)
        elif place == "wrapped":
            wrapped.append(found)
        elif not (frame.linked and frame.nested) and not (frame.nested and key in template.tokens):
            (others if frame.inside else outside).append(found)
    own = lambda blocks: [b for b, kept in blocks if kept] or [b for b, _ in blocks]
    has_main = walk.has_main
    if in_main or (has_main and not wrapped):
        return "\n".join(own(in_main))
    rest = own(others or outside)
    return "\n".join(own(wrapped) if has_main or sum(len(b) for b, _ in wrapped) >= sum(map(len, rest)) else rest)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 2, least_share: float = 0.5) -> DataFrame:
    """key, url, text (empty if none) and n_chars (code points) of each page.

    Null html is empty. Pages whose url has no host, and hosts with too few pages for a
    template, go by tags and marks alone. Repeated rows give repeated rows and count once.
    Nested articles are part of their article; comments inside one go by their marks. Pages of
    any length are read whole, one at a time. An empty table gives no rows."""
    d = numbered(pages)
    p = d.select(d[at(pages, id_col)].alias("key"), d[at(pages, url_col)].alias("url"), host_of(blank_if_null(d[at(pages, url_col)])).alias("host"), blank_if_null(d[at(pages, html_col)]).alias("html"))
    named = p.select("host", "html", F.xxhash64("html").alias("page"))
    # Written, so that Spark knows their size: pages stay where they are if the templates are few, else a hot host's partition can be split.
    known = stage(templates(named, least_pages, least_share).withColumnRenamed("host", "t_host"), "templates")
    joined = p.join(known, p["host"] == known["t_host"], "left").select("key", "url", "html", "tokens", "static", "records", "links", "main")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: dict[bytes, Template] = {}
            for i in range(0, len(batch), 200):
                part = batch.iloc[i : i + 200]
                out = []
                for text, found, static, records, links, main in zip(*(part[c] for c in ("html", "tokens", "static", "records", "links", "main"))):
                    if found is None:
                        out.append(main_text(text))
                        continue
                    mark = found.tobytes()
                    if mark not in made:
                        made[mark] = Template(*(frozenset(x.tolist()) for x in (found, static, records, links)), None if pd.isna(main) else int(main), True)
                    out.append(main_text(text, made[mark]))
                yield pd.DataFrame({"key": part["key"].to_numpy(), "url": part["url"].to_numpy(), "text": out, "n_chars": list(map(len, out))})

    return joined.mapInPandas(run, f"key {p.schema['key'].dataType.simpleString()}, url string, text string, n_chars long")
