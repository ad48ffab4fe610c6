"""URL filter with redirect equivalence: block decisions reach the aliases of a url, explicit allows come first.

A rule (host, path, verdict) fits a host and all of its subdomains where the url's path starts with the rule's; the
longest fitting rule decides. Redirects (a table, and `<meta http-equiv=refresh>`) and canonical links are edges
between addresses; what they connect is one class of aliases. An address without a rule is blocked if its class holds
a blocked one and no explicitly allowed one. Pages never meet: a class travels as edges of addresses, and only pages
whose address has an edge are joined with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, saved
from corpusloom.session import fits_broadcast

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
RULE_ROWS = 4096  # rules that become a literal of the plan at most; more are joined
CLASS_ROWS = 100_000  # decided addresses that are broadcast at most (a few MB); more are joined by shuffle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Comments and raw text hold no tags; of the others only links, metas and bases count. Quotes open a value only after `=`.
_TAGS = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|template|xmp|iframe)\b.*?(?:</\1(?=[\s/>])|\Z)"""
    r"""|<(link|meta|base)(?=[\s/>])((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)>""", re.I | re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""", re.S)
_REFRESH = re.compile(r"""\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """(scheme, host, path with query) of a url; without `://` the last two are empty."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.when(at > 0, url.substr(F.lit(1), at - 1)), ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(
        rest, r"^[^/?#]*([^#]*)", 1)


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to `/`, `?`, `#` or the end; path from there up to `?`, `#` or the end; empty without `://`."""
    _, host, rest = _parts(url)
    return host, F.regexp_extract(rest, r"^[^?]*", 0)


def address(url: Column) -> Column:
    """What edges connect: scheme and host lower-cased, no fragment; null without `://`."""
    scheme, host, rest = _parts(F.trim(url))
    return F.concat(ascii_lower(scheme), F.lit("://"), host, rest)


def page_links(html: str, url: str) -> Iterator[str]:
    """Targets of the canonical links and refreshing metas of a page, resolved against its base."""
    base, found = None, []
    for tag in _TAGS.finditer(html):
        name = (tag[2] or "").lower()
        if not name:
            continue
        attributes: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(tag[3]):
            attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        if name == "base" and base is None and attributes.get("href"):
            base = attributes["href"]
        elif name == "link" and "canonical" in attributes.get("rel", "").lower().split():
            found.append(attributes.get("href", ""))
        elif name == "meta" and attributes.get("http-equiv", "").strip().lower() == "refresh":
            target = _REFRESH.fullmatch(attributes.get("content", "")) or _REFRESH.match(attributes.get("content", ""))
            found.append(next((x for x in target.groups() if x), ""))
    for href in found:
        if href.strip():
            try:
                yield urljoin(urljoin(url, base) if base else url, href.strip())
            except ValueError:  # not an address
                continue


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses of pages and of the targets that their html names."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, t) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in page_links(h, u)]
            src, dst = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])

    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)<(?:link|meta)[\s/]")).select("url", "html")
    return some.mapInArrow(linked, "src string, dst string")


def _suffixes(host: Column, depth: int) -> Column:
    """The host's last 1 to `depth` labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.greatest(n - (depth - 1), F.lit(1)), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))


def _rank(host, path, verdict):
    """Longest rule first, then the longest host, then an allow before a block."""
    return F.struct(
        F.length(F.concat(host, path)).alias("size"), F.length(host).alias("host_size"), (verdict == "allow").alias("allowed"),
        F.concat(host, path).alias("rule"), verdict.alias("verdict"))


def ruled(df: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of df(host, path, ...) with `rule` and `verdict` of the longest fitting rule, null where none fits.

    A bounded set of rules is a literal map from host to rules: no join, no shuffle. A larger set (its size is checked)
    is joined with the distinct (host, path) by the host's suffixes.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0]
    nothing = "struct<size:int,host_size:int,allowed:boolean,rule:string,verdict:string>"
    if depth is None:
        best = F.lit(None).cast(nothing)
        return df.select("*", best["rule"].alias("rule"), best["verdict"].alias("verdict"))
    if fits_broadcast(rules, RULE_ROWS):
        by_host: dict[str, list[tuple[str, str]]] = {}
        for r in rules.collect():  # RULE_ROWS at most
            by_host.setdefault(r["host"], []).append((r["path"], r["verdict"]))
        entries = F.create_map(*[
            x for host, own in sorted(by_host.items()) for x in (
                F.lit(host), F.array(*[F.struct(F.lit(p).alias("path"), _rank(F.lit(host), F.lit(p), F.lit(v)).alias("as")) for p, v in sorted(own)]))])
        found = F.flatten(F.filter(F.transform(_suffixes(F.col("host"), depth), lambda s: entries[s]), lambda x: x.isNotNull()))
        fitting = F.filter(found, lambda r: F.startswith(F.col("path"), r["path"]))
        # written out once: an expression used twice is computed twice
        return df.select("*", F.array_max(F.transform(fitting, lambda r: r["as"])).alias("_best")).select(
            *[f"`{c}`" for c in df.columns], F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))
    keys = df.select("host", "path").distinct().select("host", "path", F.explode(_suffixes(F.col("host"), depth)).alias("_suffix"))
    r = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_start"), F.col("verdict").alias("_verdict"))
    fits = keys.join(r, "_suffix").where(F.startswith("path", F.col("_start")))
    best = fits.groupBy("host", "path").agg(F.max(_rank(F.col("_suffix"), F.col("_start"), F.col("_verdict"))).alias("_best"))
    return df.join(best, ["host", "path"], "left").select(
        *[f"`{c}`" for c in df.columns], F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))


def alias_verdicts(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, alias_verdict) of the addresses whose class of aliases holds a ruled one.

    A class with an explicitly allowed address is allowed, else blocked if it holds a blocked one.
    """
    classes = saved(components(edges))
    host, path = host_path(F.col("node"))
    own = ruled(classes.select("node", "component", host.alias("host"), path.alias("path")), rules)
    # partial sums first: a class may hold any share of the addresses
    told = own.where("verdict is not null").groupBy("component").agg(
        F.when(F.max(F.col("verdict") == "allow"), "allow").otherwise("block").alias("alias_verdict"))
    return classes.join(told, "component").select(F.col("node").alias("address"), "alias_verdict")


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, decided_by ("rule", "alias", "default") of every row of pages(page_id, url, html).

    redirects(src, dst): known redirects between urls. A null url, or one without `://`, has an empty host and path,
    no address and the verdict "allow"; a null html has no links. Rows that repeat are judged alike; two equal rules
    of both verdicts allow. Other columns, whatever their names, are not looked at. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string").alias("html")
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), html)
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select("src", "dst"))
    edges = edges.select(address(F.col("src")).alias("a"), address(F.col("dst")).alias("b")).where("a <> b")
    edges = saved(edges.distinct())
    host, path = host_path(F.col("url"))
    own = ruled(pages.select("page_id", "url", host.alias("host"), path.alias("path")), rules)
    if edges.isEmpty():
        told = F.lit(None).cast("string")
    else:
        aliases = saved(alias_verdicts(edges, rules))
        aliases = F.broadcast(aliases) if fits_broadcast(aliases, CLASS_ROWS) else aliases
        own = own.withColumn("address", address(F.col("url"))).join(aliases, "address", "left")
        told = F.col("alias_verdict")
    return own.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("verdict", told, F.lit("allow")).alias("verdict"),
        F.when(F.col("verdict").isNotNull(), "rule").when(told.isNotNull(), "alias").otherwise("default").alias("decided_by"))
