"""Main text of web pages by site template removal.

Every element of a page is hashed with its subtree: its tag, its text, and its children in order. Spark counts, host by host,
on how many different pages (by their text, so that copies of a page count once) a subtree occurs; a subtree that
recurs on many of a host's pages is part of the site's template and is deleted. Menus, adverts and the like whose
text changes from page to page can't recur as a whole; they go by their element, role or class. A class word tells
what its own element is, not what stands in it: where no article would have text left, the longest one stays, whatever
the classes around it say. Inside an article, running text (paragraphs, headings, lists, tables) is never taken for a
template, however often a passage recurs.
"""
from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, written

#: A template's subtree is on at least this share of the host's different pages, and on so many of them; a host with few
#: pages needs this larger share instead, and always so few as evidence.
MIN_SHARE, MIN_PAGES, FEW_SHARE, FEW_PAGES = 0.2, 8, 0.6, 4
#: Elements nested deeper are read as text of the last one that is not (browsers stop at this depth, too).
MAX_DEPTH = 512

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Opening the first closes an open second, looked for up to the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "thead": (("tr", "td", "th"), ("table",)), "tbody": (("thead", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "tr", "td", "th"), ("table",)),
}
#: Elements that are no running text wherever they stand.
DROPPED = RAW | frozenset("head nav aside footer form button select option svg math canvas object audio video dialog menu input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or an id that name what isn't the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promoted related recommended share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Those of them that name small articles of their own (a reader's comment, a card of another article).
CARDS = frozenset("ad ads advert adverts advertisement advertising adsense comment comments disqus promo promoted related recommended sponsor sponsored".split())
#: Before such a word in the same class: the element is laid out for the thing and isn't the thing.
QUALIFIERS = frozenset("has have no not with without hide show after before".split())
#: Running text: never a template inside an article.
RUNNING = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
#: What is left of the syntax behind the last ">" of a page.
UNENDED = re.compile(r"<!--.*\Z|<[!?][^>]*+\Z|</([a-zA-Z][^\s/>]*+)[^>]*+\Z()()()()", re.DOTALL)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


class Element:
    """An element; ``drop``: it isn't running text, ``named``: only a class or an id says so, ``header``: only its headings count."""

    __slots__ = ("tag", "parts", "drop", "named", "header", "article", "hash")

    def __init__(self, tag: str, drop: bool = False, article: bool = False) -> None:
        self.tag, self.drop, self.article = tag, drop, article
        self.named, self.header = False, tag == "header"
        self.parts: list[str | Element] = []  # text and elements in page order
        self.hash = 0


def _boilerplate_words(attributes: str) -> tuple[bool, set[str]]:
    """Whether the role says that this isn't the article, and the words of classes and ids that do."""
    role, found = False, set()
    for m in ATTRIBUTE.finditer(attributes):
        names = references.unescape(m[2] or m[3] or m[4] or "").lower().split()
        if m[1].lower() == "role":
            role |= not DROPPED_ROLES.isdisjoint(names)
            continue
        for name in names:
            words = re.split("[_-]+", name)
            for k, word in enumerate(words):
                if word in DROPPED_WORDS and QUALIFIERS.isdisjoint(words[:k]):
                    found.add(word)
    return role, found


def parse(page: str | None) -> Element:
    """The page as a tree; unclosed and misplaced tags are put right as browsers do in the common cases."""
    page = page or ""
    root = Element("")
    stack, at, last = [root], 0, page.rfind(">")
    opened, deeper = Counter(), Counter()  # open elements by tag, and those nested too deep to be on the stack
    articles: list[tuple[Element, list[Element]]] = []  # with the elements around them, themselves included, that classes drop

    def close(depth: int) -> None:
        while len(stack) > depth:
            done = stack.pop()
            opened[done.tag] -= 1
            deeper.clear()
            code = xxhash.xxh64(done.tag.encode())
            some = False
            for part in done.parts:
                if isinstance(part, str):
                    if words := part.split():
                        code.update(b"\0" + " ".join(words).encode())
                        some = True
                elif part.hash:
                    code.update(b"\1" + part.hash.to_bytes(8, "little"))
                    some = True
            done.hash = code.intdigest() if some else 0  # 0: no text in it

    def find(tags: tuple[str, ...], until: tuple[str, ...]) -> int:
        """Depth of the outermost of these open elements, below the nearest of ``until``; 0: none."""
        depth, found = len(stack) - 1, 0
        if not any(opened[tag] for tag in tags):
            return 0
        while depth and stack[depth].tag not in until:
            if stack[depth].tag in tags:
                found = depth
            depth -= 1
        return found

    def open_p() -> int:
        depth = len(stack) - 1 if opened["p"] else 0
        while depth and (stack[depth].tag in INLINE or stack[depth].tag == "p"):
            if stack[depth].tag == "p":
                return depth
            depth -= 1
        return 0

    # Behind the last ">" no tag ends, so nothing is looked for there; an open comment or declaration hides what follows it.
    for token in iter(lambda: (TOKEN if at <= last else UNENDED).search(page, at), None):
        if token.start() > at:
            stack[-1].parts.append(references.unescape(page[at : token.start()]))
        at = token.end()
        if token[1]:
            tag = token[1].lower()
            if deeper[tag]:
                deeper[tag] -= 1
                stack[-1].parts.append(Element(tag))
            elif opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            elif tag in ("p", "br"):
                stack[-1].parts.append(Element(tag))
            continue
        tag, attributes = (token[2] or token[4] or "").lower(), token[3] or token[5] or ""
        if not tag:
            continue
        if tag in CLOSES_P and (depth := open_p()):
            close(depth)
        if tag in CLOSES and (depth := find(*CLOSES[tag])):
            close(depth)
        inside = stack[-1].article or stack[-1].tag in ARTICLES
        element = Element(tag, tag in DROPPED or (tag == "header" and not inside), inside)
        if attributes and tag not in ("html", "body"):
            role, words = _boilerplate_words(attributes)
            if inside and "header" in words:
                words.discard("header")
                element.header = True
            element.named = bool(words) and not (role or element.drop)
            element.drop |= role or element.named
            if element.named and words & CARDS:
                element.named = False
        stack[-1].parts.append(element)
        if tag in ARTICLES:
            around = [e for e in (*stack, element) if e.drop]
            if all(e.named for e in around):
                articles.append((element, around))
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?![a-z0-9])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            if len(stack) > MAX_DEPTH:
                deeper[tag] += 1
            else:
                stack.append(element)
                opened[tag] += 1
    if at < len(page):
        stack[-1].parts.append(references.unescape(page[at:]))
    close(0)
    if any(around for _, around in articles):
        sizes = [(sum(len(part.strip()) for part in walk(article) if isinstance(part, str)), around) for article, around in articles]
        if not any(size and not around for size, around in sizes):
            for element in max(sizes, key=lambda s: s[0])[1]:
                element.drop = False
    return root


def _is_template(element: Element, templates: frozenset[int] | set[int]) -> bool:
    return element.hash in templates and element.tag not in ARTICLES and element.tag not in ("", "html", "body") and not (element.article and element.tag in RUNNING)


def walk(root: Element, templates: frozenset[int] | set[int] = frozenset()) -> Iterator[str | Element | None]:
    """Kept text and elements in page order, None after an element; what is dropped is left out with its subtree."""
    todo: list = [iter(root.parts)]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            if todo:
                yield None
        elif isinstance(part, str):
            yield part
        elif not part.drop and not _is_template(part, templates):
            yield part
            todo.append(iter(part.parts))


def main_text(root: Element, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of the articles, or of the whole body where no article has text."""
    inside: list[str] = []
    whole: list[str] = []
    run: list[str] = []
    tags: list[tuple[str, bool]] = []
    articles = headers = headings = 0

    def end_block() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            whole.append(text)
            if articles:
                inside.append(text)

    for part in walk(root, templates):
        if isinstance(part, str):
            if not headers or headings:
                run.append(part)
            continue
        tag, header = tags.pop() if part is None else (part.tag, part.header)
        if tag not in INLINE:
            end_block()
        step = -1 if part is None else 1
        articles += step * (tag in ARTICLES)
        headers += step * header
        headings += step * (tag in HEADINGS)
        if part is not None:
            tags.append((tag, header))
    end_block()
    return " ".join(inside or whole)


def subtrees(root: Element) -> set[int]:
    """Hashes of the subtrees that may be part of a template, dropped ones included."""
    found, todo = set(), [root]
    while todo:
        element = todo.pop()
        if element.hash and _is_template(element, {element.hash}):
            found.add(element.hash)
        todo += [part for part in element.parts if isinstance(part, Element) and part.hash]
    return found


def host_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, templates): the hashes of the subtrees that recur on many different pages of the host.

    A subtree needs a fixed share of the host's pages, so a host has at most elements per page / MIN_SHARE of them. They
    are written, because a join is dealt anew for a hot host only where both its sides come from a shuffle as they are.
    """

    @F.pandas_udf("struct<content:long,subtrees:array<long>>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees = [parse(page) for page in batch]
            content = [xxhash.xxh64_intdigest(main_text(tree)) for tree in trees]
            found = [np.array(sorted(subtrees(tree)), np.uint64).astype(np.int64) for tree in trees]
            yield pd.DataFrame({"content": np.array(content, np.uint64).astype(np.int64), "subtrees": found})

    seen = pages.select(host(url).alias("host"), hashes.asNondeterministic()(F.col(f"`{html}`").cast("string")).alias("h")).filter("host is not null")
    rows = seen.select("host", "h.content", F.explode(F.array_append("h.subtrees", F.lit(0).cast("long"))).alias("subtree"))
    counts = rows.groupBy("host", "subtree", "content").agg(F.lit(1).alias("one")).groupBy("host", "subtree").agg(F.count("*").alias("n"))
    # Written once, so that the pages are not parsed again for the totals; what is on fewer pages can't be a template.
    counts = written(counts.filter((F.col("n") >= FEW_PAGES) | (F.col("subtree") == 0)), "html-counts")
    totals = counts.filter("subtree = 0").select("host", F.col("n").alias("pages"))  # each page has subtree 0
    few = F.least(F.lit(float(MIN_PAGES)), F.greatest(F.lit(float(FEW_PAGES)), FEW_SHARE * F.col("pages")))
    many = counts.filter(F.col("subtree") != 0).join(totals, "host").filter(F.col("n") >= F.greatest(few, MIN_SHARE * F.col("pages")))
    found = written(many.filter(F.col("n") >= FEW_PAGES).groupBy("host").agg(F.collect_list("subtree").alias("templates")), "html-templates")
    forget(counts)
    return found


def host(url: str):
    """The host of a URL in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def with_main_text(pages: DataFrame, url: str = "url", html: str = "html", into: str = "text") -> tuple[DataFrame, str]:
    """Add the main text of each page; empty for null and empty pages and where nothing is left.

    Every row stays, repeated rows too; pages whose URL is null or has no host have no template. The page is parsed
    twice, once to count and once to extract.
    """
    name, at = free_name(pages, into), free_name(pages, "host")
    found = host_templates(pages, url, html).withColumnRenamed("host", at)
    templates = free_name(pages, "templates")
    joined = pages.withColumn(at, host(url)).join(found.withColumnRenamed("templates", templates), at, "left")

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, known in batches:
            out = []
            for page, hashes in zip(texts, known):
                own = set() if hashes is None else set(np.asarray(hashes, np.int64).astype(np.uint64).tolist())
                out.append(main_text(parse(page), own))
            yield pd.Series(out, dtype=object)

    return joined.withColumn(name, extract(F.col(f"`{html}`").cast("string"), F.col(templates))).select(*pages.columns, name), name
