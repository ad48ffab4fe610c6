"""Main text of web pages by equivalence-class template deduction.

Tokens are elements by their path and text strings by path and content. The occurrence vector of a token counts it on
each page of its host; vectors are compared by a fingerprint that adds up over the pages, so a host with a third of
all pages is combined before the shuffle like any other. Tokens with one vector form an equivalence class. A class is
valid if enough pages of the host have it, or if it holds an element: then its pages are a layout of their own, and its
strings belong to that layout whatever share of the host it makes up. Strings of valid classes go. Classes are not
nested by order and no slots are formed; what stands outside of the article by its element or its name goes by a
fixed list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import pack, saved, unpacked
from corpusloom.session import fits_broadcast

SUPPORT = 0.5  # share of a host's pages that a valid class without an element needs
MIN_PAGES = 4  # pages of a host from which on strings can be told from articles
ID_ROWS = 500_000  # pages left out as copies that are broadcast at most
TEMPLATE_ROWS = 200_000  # template tokens that are broadcast at most (a hash each)

# HTML element kinds and the names that sites give to what isn't the article.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noframes"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|"
    r"notice|popup|modal|overlay|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|sidebar|side|footer|foot|masthead|comment|"
    r"comments|disqus|respond|replies|share|sharing|social|related|newsletter|subscribe|signup|login|widget|toolbar|pager|pagination)"
    r"(?:$|[\s_\d-])")
_STATE = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without|hide)[-_]\S*")  # names that tell what an element has or lacks
# Words beside these in a name that say nothing of the content.
_NEUTRAL = set("area bar block body bottom box btn button buttons column container content group holder icons inner item items left "
               "list link links main module outer panel right row section slot space text top unit wrap wrapper zone".split())


def _outside_by_name(names: str, inside: bool) -> bool:
    """A listed word in a name; inside of the article all words of that name must be listed or neutral."""
    if not inside:
        return bool(names) and _NAMED.search(_STATE.sub("", names)) is not None
    for name in _STATE.sub("", names).split():
        words = [w for w in re.split(r"[_\-\d]+", name) if w]
        listed = [_NAMED.fullmatch(w) is not None for w in words]
        if any(listed) and all(found or w in _NEUTRAL for w, found in zip(words, listed)):
            return True
    return False


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)", re.S)  # quotes count after = only
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NAMES = {"class", "id", "role"}
_ENDS = {tag: re.compile(rf"</{tag}\s*[^>]*>", re.I) for tag in RAW}
_CLOSES_P = re.compile(r"h[1-6]|p|div|ul|ol|dl|table|section|article|header|footer|nav|aside|main|blockquote|pre|form|hr|figure|address|fieldset|details")
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "nav", "body"}


def parse(html: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(path, text, inside the article, outside what is kept) of each element start (text '') and text block."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, in article, outside
    parts: list[str] = []
    at, end = 0, len(html)

    def block() -> tuple[str, str, bool, bool] | None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, path, inside, outside = stack[-1] if stack else ("", "", False, False)
            return path, text, inside, outside
        return None

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            parts.append(unescape(html[at:]))
            break
        if m.start() > at:
            parts.append(unescape(html[at:m.start()]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br" or tag in INLINE:
                continue
            if (b := block()):
                yield b
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif m[2]:
            tag = m[2].lower()
            if tag in RAW:
                done = _ENDS[tag].search(html, at)
                at = done.end() if done else end
                if tag not in ("svg", "math") and (b := block()):
                    yield b
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in INLINE:
                continue
            if (b := block()):
                yield b
            if _CLOSES_P.fullmatch(tag) and stack and stack[-1][0] == "p":
                stack.pop()
            if tag in _SELF:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _BOUNDS and not (tag in ("td", "th", "tr") and stack[k][0] != "table"):
                        break
                    if stack[k][0] in _SELF[tag]:
                        del stack[k:]
                        break
            if tag in VOID:
                continue
            _, path, inside, outside = stack[-1] if stack else ("", "", False, False)
            names = " ".join(a or b or c for name, a, b, c in _ATTRIBUTE.findall(m[3]) if name.lower() in _NAMES).lower()
            main = tag in ("article", "main")
            outside = outside or tag in OUTSIDE or (tag == "header" and not inside) or (
                not main and tag not in ("html", "body") and _outside_by_name(names, inside))
            path = f"{path}/{tag}" + (f".{names}" if names else "")
            if not m[3].rstrip().endswith("/"):
                stack.append((tag, path, inside or main, outside))
            yield path, "", inside or main, outside
    if (b := block()):
        yield b


def token(path: str, text: str) -> int:
    return int.from_bytes(blake2b(f"{path}\n{text}".encode(), digest_size=8).digest(), "big", signed=True)


def _strings(html: str) -> list[tuple[str, str]]:
    """(path, text) of the blocks that can belong to the article."""
    kept = [(path, text, inside) for path, text, inside, outside in parse(html) if text and not outside]
    main = any(inside for *_, inside in kept)
    return [(path, text) for path, text, inside in kept if inside or not main]


def _single(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One page of each content of a host, and the number of these: copies of a page are no sign of a template."""
    names = ["host", "page", "content"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [token("", "\n".join(text for _, text in _strings(html.as_py() or ""))) for html in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(content, pa.int64())], names)

    contents = saved(pages.mapInArrow(read, "host string, page long, content long"))
    leads = saved(contents.groupBy("host", "content").agg(F.min("page").alias("lead")))
    copies = saved(contents.join(leads, ["host", "content"]).where("page <> lead").select("host", "page").distinct())
    twice = saved(contents.groupBy("host", "page").count().where("count > 1").select("host", "page"))
    single = pages.join(F.broadcast(copies) if fits_broadcast(copies, ID_ROWS) else copies, ["host", "page"], "left_anti")
    if not twice.isEmpty():  # repeated rows
        twice = F.broadcast(twice) if fits_broadcast(twice, ID_ROWS) else twice
        single = single.join(twice, ["host", "page"], "left_anti").unionByName(
            single.join(twice, ["host", "page"], "left_semi").dropDuplicates(["host", "page"]))
    return single.select("host", "html", "page"), leads.groupBy("host").agg(F.count("*").alias("pages"))


def _tokens(pages: DataFrame) -> DataFrame:
    """(host, token, n, page, is_text) once for each token of a page that can belong to a template."""
    names = ["host", "token", "n", "page", "is_text"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, html in enumerate(batch.column(1)):
                counts: dict[tuple[str, str], int] = {}
                for path, text, _, outside in parse(html.as_py() or ""):
                    if not (text and outside):  # strings that are left out anyway need no template
                        counts[path, text] = counts.get((path, text), 0) + 1
                rows.extend((row, token(*key), n, bool(key[1])) for key, n in counts.items())
            row, tokens, n, is_text = zip(*rows) if rows else ((),) * 4
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(tokens, pa.int64()), pa.array(n, pa.int32()), batch.column(2).take(at), pa.array(is_text, pa.bool_())], names)

    return pages.mapInArrow(counted, "host string, token long, n int, page long, is_text boolean")


def templates(pages: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, token, class, is_text) of the valid equivalence classes, from pages(host, html, page)."""
    pages, sizes = _single(pages)
    vectors = _tokens(pages).groupBy("host", "token").agg(
        F.count("*").alias("on"), F.bit_xor(F.xxhash64("page", "n")).alias("class"), F.first("is_text").alias("is_text"))
    vectors = saved(vectors.where(F.col("on") >= min_pages * support))
    known = sizes.where(F.col("pages") >= min_pages)
    layouts = vectors.where(~F.col("is_text") & (F.col("on") >= min_pages)).select("host", "class", F.lit(True).alias("layout")).distinct()
    return vectors.join(known, "host").join(layouts, ["host", "class"], "left").where(
        (F.col("on") >= support * F.col("pages")) | F.col("layout")).select("host", "token", "class", "is_text")


def extract(pages: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages without html, with text (blocks of the article, one a line) and n_chars (code points).

    A null or empty page, and one without an article, has an empty text and 0 characters. Pages without a url share
    one host. Text outside of any template (a host of few different pages) is judged by its elements alone. Pages of one
    host with the same content count as one page, so copies of a page don't make its article a template.
    Repeated rows are extracted each; other columns pass through (text and n_chars are replaced).
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    found = templates(pages.select(host.alias("host"), "html", F.xxhash64("url", "html").alias("page")), support, min_pages)
    strings = saved(found.where("is_text").select("host", "token"))
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    packed = pack(pages.select("url", "html", *[f"`{c}`" for c in names if c != "url"]), "url", "html")
    asked = packed.select("url", "_rest", host.alias("_host"), F.coalesce("html", F.lit("")).alias("_html"))
    schema = T.StructType([*asked.select("url", "_rest").schema.fields, T.StructField("text", T.StringType())])

    template = strings.groupBy("host").agg(F.collect_list("token").alias("_own")).withColumnRenamed("host", "_host")
    template = F.broadcast(template) if fits_broadcast(strings, TEMPLATE_ROWS) else template
    joined = asked.join(template, "_host", "left").select("url", "_rest", "_host", "_html", "_own")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, frozenset()
        for batch in batches:
            texts = []
            hosts, htmls, owns = (batch.column(k) for k in (2, 3, 4))
            for host, html, tokens in zip(hosts, htmls, owns):
                if host != last:
                    last, own = host, frozenset(tokens.as_py() or ())
                texts.append("\n".join(text for path, text in _strings(html.as_py()) if not own or token(path, text) not in own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["url", "_rest", "text"])

    out = joined.mapInArrow(written, schema)
    return out.select(*unpacked(names, "url"), "text", F.length("text").cast("long").alias("n_chars"))
