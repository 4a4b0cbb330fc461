"""Main text of HTML pages by equivalence-class template deduction.

1. Every page is cut into tokens. A markup token is told apart by its role: the path of elements that it stands in,
   with those class names and ids that most pages of the host have. A text token is its words and its role.
2. Tokens of one host whose occurrence vectors (how often they occur in each of the host's pages) are equal form an
   equivalence class. Vectors are compared by their support and a commutative digest, so a host of any size is
   aggregated before the shuffle and never collected.
3. A class is valid if it is large and frequent enough and its tokens come in one order in all its pages. The largest
   valid class is the outer one; another nests in it if in every page all its tokens stand between the same two tokens
   of the outer one, and is left out otherwise. Together, in page order, they are the host's template.
4. A page is aligned to its host's template: of its tokens, those of the longest run in the template's order. Texts that
   aren't aligned stand in slots, whose content varies over the pages. Elements that are menus, forms and the like are
   left out; so are containers whose class names or ids say so: names made of such words alone anywhere, names that only
   hold such a word outside of the article, and inside of it where the template has the container as well.
5. If an article place, by fixed names and aligned, holds a slot, it is the text, but for aligned blocks that nearly all
   pages of a large host repeat, if they are the smaller part of it; else all slots that aren't mostly links are; and
   where nothing varies, all that isn't left out.

Pages of hosts without a valid class (too few pages) are read with their own markup as the template.

Defined cases: null or empty html gives an empty text; a null or hostless url belongs to the host ""; repeated rows
are pages of their own; malformed markup is read leniently, and unclosed elements end with their parents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.storage import materialise, short_batches

#: A class is valid with so many tokens in so large a share of the host's pages, and in this many pages at least.
CLASS_TOKENS, CLASS_SHARE, CLASS_PAGES = 3, 0.5, 3
#: A text is repeated by a whole host if so large a share of its pages has it, and the host has so many pages. A smaller
#: share may be copies of one article.
STEADY_SHARE, STEADY_PAGES = 0.9, 8
#: Names or templates of at most so many bytes are sent to all executors; with more, pages are joined to them by host.
BROADCAST_BYTES = 16 << 20

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg".split())
ARTICLE = frozenset("article main".split())
SKIPPED = frozenset("nav aside footer form script style noscript template iframe svg button select option menu dialog textarea input label fieldset legend datalist head title".split())
# Words of class names and ids of places that aren't the article.
SKIPPED_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promotion related "
    "reply replies share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
ARTICLE_NAMES = frozenset("article articlebody content entry post story main maincontent".split())
# Words that say nothing of their own in such names ("post-comments", "share-box-2").
FILLING_NAMES = frozenset("area article bar block body bottom box buttons container content footer form global header inner item items left link links list main outer page post right section site slot top unit wrap wrapper".split())
#: Elements whose names count, and those whose names count if all of them are skipped ones.
CONTAINERS = frozenset("div section ul ol dl table tbody tr td center details figure article".split())
SMALL = frozenset("p span a li dd dt".split())
#: Words that begin names of what a page has or lacks elsewhere ("has-sidebar").
AROUND_NAMES = frozenset("has with no without".split())
ENDED_BY_BLOCK = frozenset(["p"])

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z0-9]+")
#: What the names of an element say: nothing, a skipped word within a name, a skipped name among others, skipped names only.
PLAIN, HOLDS, HAS, ONLY = range(4)


def _named(attributes: str) -> tuple[frozenset[str], int]:
    """The words of an element's class names, ids and roles, and what the names say."""
    names = [n.lower() for g in _NAMES.findall(attributes) for n in " ".join(g).split()]
    own, held, skipped = set(), False, 0
    for name in names:
        said = [w for w in _SPLIT.split(name) if w]
        own.update(said)
        if said and said[0] in AROUND_NAMES:
            continue
        held |= any(w in SKIPPED_NAMES for w in said)
        skipped += any(w in SKIPPED_NAMES for w in said) and all(w in SKIPPED_NAMES or w in FILLING_NAMES or w[0].isdigit() for w in said)
    says = ONLY if names and skipped == len(names) else HAS if skipped else HOLDS if held else PLAIN
    return frozenset(own), says


NAMELESS = frozenset(), PLAIN


def events(html: str) -> Iterator[tuple[str, str, str, tuple[frozenset[str], int]]]:
    """(kind, element, text, names): kind is open, close or text; raw elements keep their content out."""
    at = 0
    while m := _MARKUP.search(html, at):
        if m.start() > at:
            yield "text", "", html[at : m.start()], NAMELESS
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, "", NAMELESS
                continue
            own = _named(m[3]) if m[3] else NAMELESS
            yield "open", name, "", own
            if name in VOID or m[3].endswith("/") and name not in BLOCKS:
                yield "close", name, "", NAMELESS
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                yield "close", name, "", NAMELESS
    if at < len(html):
        yield "text", "", html[at:], NAMELESS


def walk(html: str) -> Iterator[tuple[str, str, str, tuple]]:
    """(kind, element, text, path): path is the stack of (element, names, what they say) that the event stands in."""
    stack: list[tuple[str, frozenset[str], int]] = []
    for kind, name, text, names in events(html):
        if kind == "open":
            if name in BLOCKS and stack and stack[-1][0] in ENDED_BY_BLOCK | ({name} if name in ("li", "dt", "dd", "tr", "td", "th", "option") else set()):
                yield "close", stack[-1][0], "", tuple(stack)
                stack.pop()
            elif name in BLOCKS and any(e[0] in ENDED_BY_BLOCK for e in stack[-4:]):  # a block ends an open paragraph and what it holds
                while stack[-1][0] not in ENDED_BY_BLOCK:
                    stack.pop()
                yield "close", stack[-1][0], "", tuple(stack)
                stack.pop()
            stack.append((name, *names))
            yield kind, name, "", tuple(stack)
        elif kind == "close":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                yield kind, name, "", tuple(stack[: depth + 1])
                del stack[depth:]
        else:
            yield kind, "", text, tuple(stack)


class Roles:
    """Tokens as hashes, for pages of one host; names: the class names and ids that count there."""

    def __init__(self, names: list[str] | None):
        self.names, self.known = frozenset(names or ()), {}

    def __call__(self, kind: str, path: tuple, text: str = "") -> int | None:
        """A token with its role; a blank text is none."""
        if len(self.known) > 20_000:
            self.known.clear()
        key = self.known.get((kind, path))
        if key is None:
            key = self.known[kind, path] = xxhash.xxh3_64_intdigest(kind + "/".join(f"{e}.{'.'.join(sorted(n & self.names))}" for e, n, _ in path)) - (1 << 63)
        if kind == "text":
            own = " ".join(text.split())
            return xxhash.xxh3_64_intdigest(own, key & (1 << 64) - 1) - (1 << 63) if own else None
        return key


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def common_names(pages: DataFrame) -> DataFrame:
    """host, names: class names and ids on CLASS_SHARE of the host's pages; names that differ by page aren't among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches, "html"):
            hosts, found = [], []
            for name, html in zip(rows.column("host").to_pylist(), texts, strict=True):
                own = {w.lower() for g in set(_NAMES.findall(html.decode())) for w in _SPLIT.split(" ".join(g)) if w}
                hosts += [name] * (len(own) + 1)
                found += [None, *own]  # the page itself, and its names
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.string())], names=["host", "name"])

    counts = pages.select("host", "html").mapInArrow(run, "host string, name string").groupBy("host", "name").agg(F.count(F.lit(1)).alias("pages"))
    counts = materialise(counts, "page-names")
    sizes = counts.where("name is null").select("host", F.col("pages").alias("all"))
    often = counts.where("name is not null").join(sizes, "host").where((F.col("pages") >= CLASS_SHARE * F.col("all")) & (F.col("all") >= CLASS_PAGES))
    return materialise(often.groupBy("host").agg(F.collect_list("name").alias("names")), "common-names")  # at most twice a page's names


def with_names(pages: DataFrame, names: DataFrame) -> DataFrame:
    held = names.agg(F.sum(F.size("names") * 16 + F.length(F.array_join("names", "")) + F.length("host") + 64)).first()[0] or 0
    return pages.join(F.broadcast(names) if held <= BROADCAST_BYTES else names, "host", "left")


def page_tokens(pages: DataFrame) -> DataFrame:
    """page, host, token, count, first (its first place) of pages with their host's names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles: dict[str, Roles] = {}
        for rows, texts in words.parcels(batches, "html"):
            out = []
            for page, name, names, html in zip(rows.column("page").to_pylist(), rows.column("host").to_pylist(), rows.column("names"), texts, strict=True):
                if name not in roles:
                    if len(roles) >= 16:
                        roles.clear()
                    roles[name] = Roles(names.as_py())
                role = roles[name]
                seen: dict[int, list[int]] = {}
                for place, (kind, _, text, path) in enumerate(walk(html.decode())):
                    if (token := role(kind, path, text)) is not None:
                        seen.setdefault(token, [0, place])[0] += 1
                out += [(page, name, token, count, first) for token, (count, first) in seen.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                names=["page", "host", "token", "count", "first"],
            )

    return pages.mapInArrow(run, "page long, host string, token long, count int, first int")


def templates(pages: DataFrame) -> DataFrame:
    """host, names, template, steady: the names that count there, the tokens of the host's valid classes in page order, and
    those of them that nearly all of its pages have."""
    names = common_names(pages)
    tokens = materialise(page_tokens(with_names(pages, names).select("page", "host", "names", "html")), "page-tokens")
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    vectors = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("support"), F.expr("bit_xor(xxhash64(page, count))").alias("vector"), F.sum("count").alias("occurrences"), F.avg("first").alias("place")
    )
    in_class = Window.partitionBy("host", "support", "vector", "occurrences")
    classes = (
        vectors.join(sizes, "host")
        .where((F.col("support") >= CLASS_PAGES) & (F.col("support") >= CLASS_SHARE * F.col("pages")))
        .withColumn("tokens", F.count(F.lit(1)).over(in_class))
        .where(F.col("tokens") >= CLASS_TOKENS)
    )
    classes = materialise(classes.withColumn("class", F.xxhash64("support", "vector", "occurrences")).select("host", "token", "place", "class", "support", "pages", "tokens"), "classes")
    # one order in all pages: the order of a class's tokens in a page is digested, and the digests have to agree
    member = tokens.join(classes.select("host", "token", "class"), ["host", "token"]).select("host", "page", "class", "token", "first")
    order = F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("first", "token"))), lambda x: x["token"]))  # as long as a class
    spans = materialise(member.groupBy("host", "class", "page").agg(order.alias("order"), F.min("first").alias("low"), F.max("first").alias("high")), "class-spans")
    ordered = spans.groupBy("host", "class").agg((F.min("order") == F.max("order")).alias("ordered")).where("ordered").select("host", "class")
    # the largest ordered class of a host is the outer one; another nests in it if it lies in one and the same slot everywhere
    sized = classes.select("host", "class", "support", "tokens").distinct().join(ordered, ["host", "class"])
    outer = sized.groupBy("host").agg(F.max_by("class", F.struct("support", "tokens", "class")).alias("outer"))
    frame = member.join(outer, "host").where(F.col("class") == F.col("outer")).select("host", "page", F.col("first").alias("at"))
    inner = spans.join(ordered, ["host", "class"]).join(outer, "host").where(F.col("class") != F.col("outer"))
    slots = inner.join(frame, ["host", "page"]).groupBy("host", "class", "page").agg(F.count_if(F.col("at") < F.col("low")).alias("from"), F.count_if(F.col("at") < F.col("high")).alias("to"))
    nested = slots.groupBy("host", "class").agg((F.min("from") == F.max("to")).alias("nests"), F.min("from").alias("slot")).where("nests").select("host", "class", "slot")
    valid = outer.select("host", F.col("outer").alias("class"), F.lit(None).cast("long").alias("slot")).unionByName(nested)
    # an inner class comes after the outer tokens before its slot, wherever it stands on pages of other lengths
    rank = F.row_number().over(Window.partitionBy("host", "class").orderBy("place", "token"))
    order = F.coalesce(F.col("slot") + 0.5, rank.cast("double"))
    return (
        classes.join(valid, ["host", "class"])
        .withColumn("order", order)
        .groupBy("host")
        .agg(
            F.array_sort(F.collect_list(F.struct("order", "place", "token"))).alias("ordered"),
            F.collect_list(F.when((F.col("support") >= STEADY_SHARE * F.col("pages")) & (F.col("pages") >= STEADY_PAGES), F.col("token"))).alias("steady"),
        )  # the size of a template, not of a host
        .join(names, "host", "left")
        .select("host", "names", F.col("ordered.token").alias("template"), "steady")
    )


def _skips(step: tuple[str, frozenset[str], int], outside: bool, fixed: bool) -> bool:
    """Whether an element, outside of articles or not, fixed by the template or not, is left out with all that it holds."""
    name, _, says = step
    if name in SKIPPED:
        return True
    if name in CONTAINERS:
        return says >= HAS or says == HOLDS and (outside or fixed)
    return name in SMALL and says == ONLY


def _is_article(step: tuple[str, frozenset[str], int]) -> bool:
    return step[0] in ARTICLE or step[0] in ("div", "section") and bool(step[1] & ARTICLE_NAMES) and step[2] == PLAIN


def aligned(tokens: list[int | None], template: dict[int, int]) -> set[int]:
    """The tokens of a page that align to its template (token: place): a longest run, by first places, in its order."""
    ends: list[int] = []  # the least last place of a run of each length
    last: list[int] = []  # its token
    before: dict[int, int | None] = {}
    for token in dict.fromkeys(x for x in tokens if x in template):
        at = bisect_left(ends, template[token])
        before[token] = last[at - 1] if at else None
        ends[at : at + 1], last[at : at + 1] = [template[token]], [token]
    out, token = set(), last[-1] if last else None
    while token is not None:
        out.add(token)
        token = before[token]
    return out


def main_text(html: str, template: dict[int, int] | None, role: Roles | None = None, steady: frozenset[int] = frozenset()) -> str:
    """The blocks of the article's slots, one per line. A slot is what stands between two aligned tokens of the template
    (token: place), as told apart by role; steady: tokens that nearly all pages have."""
    page = list(walk(html))
    tokens = [None if template is None else role(kind, path, text) for kind, _, text, path in page]
    fixed = aligned(tokens, template) if template is not None else set()
    article: list[tuple[str, bool]] = []  # blocks of articles, and whether nearly all pages repeat them
    slots: list[tuple[str, bool]] = []  # blocks outside of articles with a text that varies, and whether they are mostly links
    other: list[str] = []
    parts: list[str] = []
    inside, kept, article_varies = False, True, template is None
    varies, repeats, linked = False, True, 0

    def close() -> None:
        nonlocal varies, repeats, linked, article_varies
        text = " ".join(unescape("".join(parts)).split())
        if text:
            if inside:
                article.append((text, repeats))
                article_varies |= varies
            else:
                other.append(text)
                if varies:
                    slots.append((text, 2 * linked > len(text)))
        parts.clear()
        varies, repeats, linked = False, True, 0

    zone: list[bool] = []  # for each open element: whether it begins an article slot of the template
    out: list[bool] = []  # and whether it is left out
    for (kind, name, text, path), token in zip(page, tokens, strict=True):
        if kind == "text":
            if kept:
                parts.append(text)
                if token is not None:
                    varies |= token not in fixed
                    repeats &= token in fixed and token in steady
                if any(step[0] == "a" for step in path):
                    linked += len(text)
            continue
        if name in BLOCKS or name in RAW:
            close()
        elif name == "br" and kept:
            parts.append(" ")
        depth = len(path) - 1
        del zone[depth:], out[depth:]
        if kind == "open":
            step = path[-1]
            # names don't count above main, which holds the page's article by definition, nor on html and body, where they
            # say what the page holds
            above = any(p[0] in SKIPPED for p in path[:-1]) if step[0] == "main" else any(out)
            within = any(zone)
            zone.append(_is_article(step) and not above and (template is None or token in fixed))
            out.append(not (zone[-1] and not within) and _skips(step, not within, token in fixed))
        inside = any(zone)
        start = zone.index(True) if inside else 0
        kept = not any(out[start:]) and (inside or not any(p[0] == "header" for p in path[: len(out)]))
    close()
    repeated = sum(len(text) for text, again in article if again)
    whole = template is None or 2 * repeated >= sum(len(text) for text, _ in article)
    found = [text for text, again in article if whole or not again] if article_varies or not slots else []
    return "\n".join(found or [text for text, links in slots if not links] or [text for text, _ in slots] or other)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    source = short_batches(pages).select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    found = materialise(templates(source.select("page", "host", "html")), "templates")
    held = found.agg(F.sum((F.size("template") + F.size("steady")) * 8 + F.coalesce(F.length(F.array_join("names", "")) + F.size("names") * 16, F.lit(0)) + F.length("host") + 64)).first()[0]
    few = (held or 0) <= BROADCAST_BYTES
    joined = source.join(F.broadcast(found) if few else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in words.parcels(batches, "html"):
            known: dict[str, tuple[dict[int, int] | None, Roles, frozenset[int]]] = {}
            out = []
            for name, names, own, steady, html in zip(rows.column("host").to_pylist(), rows.column("names"), rows.column("template"), rows.column("steady"), texts, strict=True):
                if name not in known:
                    known[name] = ({token: i for i, token in enumerate(own.as_py())} if own.is_valid else None, Roles(names.as_py()), frozenset(steady.as_py() or ()))
                out.append(main_text(html.decode(), *known[name]))
            yield pa.RecordBatch.from_arrays([rows.column("page"), rows.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page", "url", "host", "names", "template", "steady", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
