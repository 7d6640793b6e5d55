"""Raw pages: readable text, links and the static URL policy. Text and links need an HTML parser, so they run in ``mapInArrow``, a page at a time."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Tags that are never content, links that lead nowhere, hosts and networks that are never fetched.
CHROME = ("script", "style", "noscript", "nav", "header", "footer", "svg")
NO_LINK = ("javascript:", "mailto:", "#")
BLOCKED_HOSTS = ("metadata.google.internal", "metadata.goog", "instance-data")
BLOCKED_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4")
BLOCKED_V6 = ("::1/128", "::/128", "fc00::/7", "fe80::/10", "ff00::/8")


class _Page(HTMLParser):
    """Pieces of text outside chrome, and the links with where their label stands among the pieces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.pieces, self.links, self.open = [], [], [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CHROME:
            self.skip.append(tag)
        elif tag == "a" and not self.skip and (href := dict(attrs).get("href")) is not None:
            self.open = (href, len(self.pieces))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """A tag closed at once holds nothing."""

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
        elif tag == "a" and self.open:
            self.links.append((*self.open, len(self.pieces)))
            self.open = None

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.pieces.append(data)


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _lines(pieces: list[str]) -> str:
    return "\n".join(line for piece in pieces for raw in piece.split("\n") if (line := raw.strip()))


def _absolute(base: str, href: str) -> str | None:
    """None for a malformed address, which leads nowhere."""
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def _labelled(page: _Page, base: str) -> list[tuple[int, int, str, str]]:
    """First piece, piece after the last, label and absolute address of each usable link."""
    found = ((a, b, " ".join(" ".join(page.pieces[a:b]).split()), _absolute(base, href)) for href, a, b in page.links)
    return [x for x in found if x[2] and x[3] is not None and not x[3].lower().startswith(NO_LINK)]


def _linked(html: str | None, base: str) -> str:
    page, out, at = _parsed(html), [], 0
    for a, b, label, href in _labelled(page, base):
        out += [*page.pieces[at:a], f"[{label}]({href})"]
        at = b
    return _lines(out + page.pieces[at:])


#: Bytes of pages that are Python texts at once, with what comes of them; one page may be longer.
HELD = 4 << 20


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``HELD`` bytes of html, as a batch may hold 10,000 pages."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b["html"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < len(b):
            end = max(start + 1, int(np.searchsorted(ends, before + HELD, "right")))
            yield b.slice(start, end - start)
            start, before = end, int(ends[end - 1])


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text, linked_text (every usable link as ``[label](address)``). A null page has empty texts; blank lines go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            rows = [(_lines(_parsed(h.as_py()).pieces), _linked(h.as_py(), u.as_py() or "")) for h, u in zip(b["html"], b["url"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], *(pa.array([r[i] for r in rows], pa.string()) for i in (0, 1))], ["page_id", "text", "linked_text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, text string, linked_text string")


# Tags that end a block of text.
BLOCK_TAGS = ("p", "div", "li", "ul", "ol", "td", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "aside", "blockquote", "pre", "form", "figure", "br", "hr", "body", "title")
#: A block of at least so many words is content unless more than this share of its letters are links; shorter ones go with a neighbour.
CONTENT_WORDS, LINK_SHARE, LEAST_ARTICLE = 15, 1 / 3, 200


class _Blocks(_Page):
    """Blocks of text: their pieces, and how many of their letters are links."""

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[tuple[list[str], int]] = []
        self.now, self.linked, self.in_link = [], 0, 0

    def cut(self) -> None:
        if "".join(self.now).strip():
            self.blocks.append((self.now, self.linked))
        self.now, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        if tag in BLOCK_TAGS:
            self.cut()
        self.in_link += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        if tag in BLOCK_TAGS:
            self.cut()
        self.in_link = max(0, self.in_link - (tag == "a"))

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        if not self.skip:
            self.now.append(data)
            self.linked += len(data.strip()) * (self.in_link > 0)


def article(html: str | None) -> str:
    """Text of a page's content blocks: long ones with few links, and short ones without links between two of them or right before one (headings)."""
    page = _Blocks()
    page.feed(html or "")
    page.close()
    page.cut()
    texts = [" ".join("".join(pieces).split()) for pieces, _ in page.blocks]
    few = [linked <= LINK_SHARE * max(len(t), 1) for t, (_, linked) in zip(texts, page.blocks, strict=True)]
    long = [f and len(t.split()) >= CONTENT_WORDS for t, f in zip(texts, few, strict=True)]
    kept = [a or (f and i + 1 < len(texts) and long[i + 1]) for i, (a, f) in enumerate(zip(long, few, strict=True))]
    out = "\n".join(t for t, k in zip(texts, kept, strict=True) if k)
    whole = _lines(page.pieces)
    return whole if len(out) < LEAST_ARTICLE and len(whole) > len(out) else out


def article_texts(pages: DataFrame) -> DataFrame:
    """page_id, text: the page's article without navigation, advertisements and lists of links; all its text where that leaves under 200 characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array([article(h.as_py()) for h in b["html"]], pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string")


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, label, href: a page's usable links, in order, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "pos": pa.int64(), "label": pa.string(), "href": pa.string()}
        for b in _few(batches):
            pages_of = zip(*(b[c].to_pylist() for c in ("page_id", "html", "url")), strict=True)
            rows = [(i, k, label, href) for i, h, u in pages_of for k, (_, _, label, href) in enumerate(_labelled(_parsed(h), u or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types.values())], list(types))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, pos long, label string, href string")


@F.pandas_udf(StringType())
def clean_fragment(html: pd.Series) -> pd.Series:
    """Readable text of a fragment whose entities may be encoded twice; null is empty."""
    plain = html.fillna("").map(unescape)
    return plain.map(lambda t: _lines(_parsed(t).pieces) if "<" in t else t.strip())


@F.pandas_udf(BooleanType())
def _blocked_v6(literal: pd.Series) -> pd.Series:
    v4, v6 = [ipaddress.ip_network(n) for n in BLOCKED_V4], [ipaddress.ip_network(n) for n in BLOCKED_V6]

    def blocked(text: str | None) -> bool:
        if text is None:
            return False
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return True
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return any(ip in n for n in (v4 if ip.version == 4 else v6))

    return literal.map(blocked)


def _blocked_v4(host: Column) -> Column:
    part = F.transform(F.split(host, r"\."), lambda x: x.try_cast("long"))
    number = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    inside = F.lit(False)
    for n in map(ipaddress.ip_network, BLOCKED_V4):
        inside = inside | number.between(int(n.network_address), int(n.broadcast_address))
    return inside | F.exists(part, lambda x: x > 255)


def url_policy(df: DataFrame, url: str) -> DataFrame:
    """Adds url_norm (null unless allowed), allowed and reason: empty, scheme, host, blocked, private, address or ok. Names are not resolved."""
    u = F.trim(F.coalesce(F.col(url), F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    netloc = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.lower(F.regexp_replace(netloc, "^.*@", ""))
    v6 = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    host = F.when(v6 != "", v6).otherwise(F.regexp_replace(F.regexp_replace(bare, ":.*$", ""), r"\.+$", ""))
    rows = df.withColumn("__tm_v6", F.when(v6 != "", v6))
    reason = (
        F.when(u == "", "empty").when(~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(host.isin(*BLOCKED_HOSTS), "blocked")
        .when((host == "localhost") | host.rlike(r"\.(localhost|internal|local)$"), "private")
        .when(F.coalesce(host.rlike(r"^\d{1,9}(\.\d{1,9}){3}$") & _blocked_v4(host), F.lit(False)) | F.col("__tm_v6_blocked"), "address").otherwise("ok")
    )
    rows = rows.withColumn("__tm_v6_blocked", _blocked_v6("__tm_v6")).withColumn("reason", reason).withColumn("allowed", F.col("reason") == "ok")
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return rows.withColumn("url_norm", F.when(F.col("allowed"), F.concat(scheme, F.lit("://"), F.lower(netloc), rest))).drop("__tm_v6", "__tm_v6_blocked")


# Hosts of boards whose payloads can be read, the payload's address for each, and last path parts that name no board.
BOARD_HOSTS = {"greenhouse": r"(?:job-boards|boards)\.greenhouse\.io", "lever": r"jobs\.lever\.co", "ashby": r"jobs\.ashbyhq\.com"}
BOARD_API = {"greenhouse": "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true", "lever": "https://api.lever.co/v0/postings/{}?mode=json", "ashby": "https://api.ashbyhq.com/posting-api/job-board/{}?includeCompensation=true"}
NO_BOARD = ("embed", "jobs", "job", "boards", "api", "v1", "static", "assets", "search")


def discover_boards(pages: DataFrame) -> DataFrame:
    """page_id, company_id, board_url, provider, api_url: the first readable board that a page of a company refers to.

    pages: page_id, company_id, source_type, html. Pages without a company, pages that are boards' payloads themselves (source_type ats_api) and pages without a board give no row.
    """
    refs = F.regexp_extract_all("html", F.lit(f"(?i)(?:{'|'.join(BOARD_HOSTS.values())})/[A-Za-z0-9_-]+"), F.lit(0))
    board = F.get(F.filter(refs, lambda r: ~F.lower(F.substring_index(r, "/", -1)).isin(*NO_BOARD)), F.lit(0))
    of_company = F.col("company_id").isNotNull() & ~F.coalesce(F.col("source_type") == "ats_api", F.lit(False))
    rows = pages.filter(of_company).select("page_id", "company_id", board.alias("board")).filter(F.col("board").isNotNull())
    token, provider, api = F.substring_index("board", "/", -1), F.lit(None), F.lit(None)
    for name, host in BOARD_HOSTS.items():
        at, (before, after) = F.col("board").rlike(f"(?i)^{host}/"), BOARD_API[name].split("{}")
        provider, api = F.when(at, name).otherwise(provider), F.when(at, F.concat(F.lit(before), token, F.lit(after))).otherwise(api)
    return rows.select("page_id", "company_id", F.concat(F.lit("https://"), "board").alias("board_url"), provider.alias("provider"), api.alias("api_url"))
