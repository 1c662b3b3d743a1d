"""Main text of web pages: markup roles, and a suffix array per host over the page token streams.

Parsing cuts a page into blocks of text, each with a role: content (inside an article or main element),
chrome (inside navigation, headers, footers, sidebars, forms, scripts, or elements whose class or id names
notices, adverts, comments and the like) or open (no markup tells).

The token streams of a host's pages give its suffix array: of the chrome and open blocks every suffix, of the content
blocks those at a block's start, each by its first RUN tokens (content blocks whole). The suffixes are sorted by host,
tokens and page, dealt out by range with the page included, so that no run of equal suffixes is a single task; one
pass compares neighbours and counts the distinct pages of each run of equal ones. The first and last run of a task,
which may go on in the next, are added up. Suffixes that MIN_PAGES differing pages or more share cover boilerplate:
overlapping runs make one long substring, whatever its length.

Covered tokens leave open blocks and the unique runs stay. Content blocks leave if they are on MIN_SHARE of the host's
pages or more, of which there are MIN_HOST at least, and make up less than half of the page's content: articles
that quote or copy one another keep their text. Pages with content blocks give these alone; other pages give what is
left of their open blocks.

Nulls: a null html is empty and gives an empty text; a null or odd URL counts as host "". Repeated rows are
parsed each and count as one page among the repeats. Pages of any length are parsed whole. Ties do not arise: runs
are equal or not. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, scratch, words_by_row

RUN, MIN_PAGES, MIN_HOST, MIN_SHARE = 8, 3, 8, 0.5

BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul button iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe textarea select object canvas".split())
CHROME = frozenset("nav footer aside form head title button dialog menu label fieldset audio video".split()) | RAW
CONTENT = frozenset("article main".split())
#: Elements that need no place on the stack without attributes, unless another of their name is there; those that may end themselves.
PLAIN = frozenset("p b i em strong span a u".split())
FOREIGN = frozenset("svg math canvas path g use image".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menu|menus|breadcrumb\w*|sidebar|side-bar|aside|widget\w*|footer|foot|masthead|site-header|page-header|topbar|toolbar|"
    r"comment|comments|commentlist|comment-list|respond|replies|reply|disqus|discussion|share|sharing|social|related|recommend\w*|teaser|teasers|trending|popular|pagination|pager|"
    r"copyright|legal|disclaimer|tags|meta|byline|search|skip|hidden)(?:$|[\s_-])",
    re.I,
)
#: The names that also count inside an article, where a section may well be called legal or a paragraph skip.
_INSIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notices|popup|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|menus|breadcrumb\w*|sidebar|side-bar|footer|comment|comments|commentlist|comment-list|respond|disqus|share|sharing|social|related|recommend\w*|pagination|pager)(?:$|[\s_-])",
    re.I,
)
_BODY = re.compile(r"(?:^|[\s_-])(?:article-?body|article-?content|article-?text|post-?content|post-?body|entry-?content|story-?body|main-?content|articlebody)(?:$|[\s_-])", re.I)
_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-hidden|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=\s|$|/)", re.I)
_SPACE = re.compile(r"\s+")


def _role(tag: str, attributes: str, inside: str, article: bool) -> str:
    """The role of an element's content from its own tag and attributes and the role it stands in."""
    if inside == "chrome":
        return inside
    if tag in CHROME or tag == "header" and not article:
        return "chrome"
    own = ""
    if attributes.strip():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id") and tag not in ("body", "html"):
                if _BODY.search(value):
                    own = "content"
                elif (_INSIDE if inside == "content" else _NAMES).search(value):
                    return "chrome"
            elif name == "role":
                if _ROLE.search(value):
                    return "chrome"
                if value.lower() in ("main", "article"):
                    own = "content"
            elif name == "itemprop" and value.lower() == "articlebody":
                own = "content"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                return "chrome"
    return "content" if own or tag in CONTENT else inside


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(role, text) of a page's blocks in order; white space is single, character references are decoded."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []
    role, at = "open", 0
    page = page or ""

    def flush():
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((role, text))

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                held.append(entities.escape(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:]))
            continue
        tag = m[2].lower()
        if tag in BLOCKS or tag in RAW:
            flush()
            if not m[1] and tag != "br" and stack and stack[-1][0] == "p":  # a new block ends an open paragraph
                role = stack.pop()[1]
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                if stack[depth][1] != role:
                    flush()
                role = stack[depth][1]
                del stack[depth:]
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if m[3].rstrip().endswith("/") and tag in ("svg", "math", "canvas"):
                continue
            at = end.end() if end else size
        elif tag not in VOID and not (tag in PLAIN and "=" not in m[3] and all(t != tag for t, _ in stack)) and not (m[3].endswith("/") and tag in FOREIGN):
            new = _role(tag, m[3], role, any(t in CONTENT for t, _ in stack))
            if new != role:
                flush()
            stack.append((tag, role))
            role = new
    flush()
    return out


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, rid, host, content, open, chrome): a hash of the host, and the blocks of each role."""

    def batches(it):
        for b in it:
            found = [blocks(x.as_py()) for x in b.column(4)]
            of = lambda role: pa.array([[t for r, t in bs if r == role] for bs in found], pa.list_(pa.string()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), of("content"), of("open"), of("chrome")], names=["page_id", "url", "rid", "host", "content", "open", "chrome"])

    from .url_filter import host

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.xxhash64("html").alias("rid"), F.xxhash64(host(F.col("url"))).alias("host"), "html").transform(in_arrow, batches, f"page_id {kind}, url string, rid long, host long, content array<string>, open array<string>, chrome array<string>")


def suffixes(rows: DataFrame) -> DataFrame:
    """(host, run, rid, block, pos, kind): the retained suffixes by their first RUN tokens; shorter blocks, and content blocks, by all.
    kind is 0 for content, 1 for open and 2 for chrome blocks."""

    def batches(it):
        from .suffix_dedup import Stream

        for b in it:
            hosts, rids = (b.column(i).to_numpy() for i in (0, 1))
            out = []
            for kind in (1, 2):
                lists = b.column(1 + kind)
                sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                parents = np.repeat(np.arange(len(b)), sizes)
                nth = np.arange(len(parents)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                for k, _, _, h in words_by_row(lists.flatten(), punctuation=True):
                    if not len(h):
                        continue
                    p = np.arange(max(1, len(h) - RUN + 1))
                    run, n = Stream(h).hash(p, np.minimum(p + RUN, len(h))), len(p)
                    out.append((np.full(n, hosts[parents[k]]), run, np.full(n, rids[parents[k]]), np.full(n, nth[k]), p, np.full(n, kind)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["host", "run", "rid", "block", "pos", "kind"])

    told = rows.select("host", "rid", "open", "chrome").transform(in_arrow, batches, "host long, run long, rid long, block long, pos long, kind long")
    content = rows.select("host", "rid", F.posexplode("content").alias("block", "text")).select("host", F.xxhash64("text").alias("run"), "rid", F.col("block").cast("long").alias("block"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("kind"))
    return told.unionByName(content)


def pages_of_runs(it):
    """(host, run, pages, edge): the distinct pages of each run of equal suffixes, by comparing sorted neighbours; edge
    marks a task's first and last run, which may go on elsewhere. A page's equal suffixes never part."""
    before, pages, first = None, 0, True
    for b in it:
        if not len(b):
            continue
        a = np.stack([b.column(i).to_numpy() for i in range(3)])
        if before is not None:
            a = np.concatenate([before, a], axis=1)
        same = (a[:2, 1:] == a[:2, :-1]).all(axis=0)
        fresh_page = ~same | (a[2, 1:] != a[2, :-1])
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        n = np.add.reduceat(np.concatenate([[before is None], fresh_page]).astype(np.int64), begin)
        n[0] += pages
        edge = np.zeros(len(begin), np.int64)
        edge[0] = first
        first = first and len(begin) == 1
        pages, before = int(n[-1]), a[:, -1:]
        yield pa.RecordBatch.from_arrays([pa.array(a[0, begin[:-1]]), pa.array(a[1, begin[:-1]]), pa.array(n[:-1]), pa.array(edge[:-1])], names=["host", "run", "pages", "edge"])
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array(before[0]), pa.array(before[1]), pa.array([pages], pa.int64()), pa.array([1], pa.int64())], names=["host", "run", "pages", "edge"])


def common_runs(array: DataFrame, min_pages: int) -> DataFrame:
    """(host, run, pages) of the runs that min_pages distinct pages or more share, from the suffixes."""
    sorted_ = array.select("host", "run", "rid").repartitionByRange("host", "run", "rid").sortWithinPartitions("host", "run", "rid")
    found = scratch(sorted_.transform(in_arrow, pages_of_runs, "host long, run long, pages long, edge long").where(f"pages >= {int(min_pages)} or edge = 1"), "runs")
    edges = found.where("edge = 1").groupBy("host", "run").agg(F.sum("pages").alias("pages"))  # two rows at most from each task
    return found.where("edge = 0").select("host", "run", "pages").unionByName(edges).where(F.col("pages") >= min_pages)


def _uncovered(blocks_: list[str], covered: list[tuple[int, int]]) -> tuple[str, int]:
    """The blocks without their covered runs, and how many tokens those held."""
    gone: dict[int, list[int]] = {}
    for block, pos in covered:
        gone.setdefault(block, []).append(pos)
    texts, dropped = [], 0
    for i, text in enumerate(blocks_):
        if i not in gone:
            texts.append(text)
            continue
        (_, starts, ends, h), raw = next(words_by_row(pa.array([text]), punctuation=True)), text.encode()
        cover = np.zeros(len(h) + 1, np.int64)
        for p in gone[i]:
            cover[p] += 1
            cover[min(p + RUN, len(h))] -= 1
        keep = np.cumsum(cover)[:-1] == 0
        dropped += int((~keep).sum())
        for part in np.split(np.arange(len(h)), np.flatnonzero(np.diff(keep.astype(np.int8))) + 1):
            if len(part) and keep[part[0]]:
                stop = ends[part[-1]] if part[-1] + 1 < len(h) else len(raw)
                if part[-1] + 1 < len(h):
                    stop = starts[part[-1] + 1]
                texts.append(raw[(0 if part[0] == 0 else starts[part[0]]) : stop].decode("utf-8", "ignore").strip())
    return " ".join(t for t in texts if t), dropped


def _own_content(blocks_: list[str], covered: list[int]) -> tuple[str, int]:
    """The content blocks without the covered ones, and how many tokens those held; all of them, if the covered ones are half of the text or more."""
    gone = set(covered)
    lost = sum(len(blocks_[i]) for i in gone)
    if not gone or 2 * lost >= sum(map(len, blocks_)):
        return " ".join(blocks_), 0
    return " ".join(t for i, t in enumerate(blocks_) if i not in gone), sum(len(blocks_[i].split()) for i in gone)


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_host: int = MIN_HOST, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, n_covered): n_covered counts the tokens that the host's repeated runs took."""
    rows = scratch(parsed(pages), "parsed")
    array = scratch(suffixes(rows), "suffix-array")
    common = scratch(common_runs(array, min_pages), "common-runs")
    sizes = rows.groupBy("host", "rid").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_pages"))
    wide = common.join(scratch(sizes, "host-sizes").where(F.col("host_pages") >= min_host), "host").where(F.col("pages") >= min_share * F.col("host_pages")).select("host", "run")
    taken = array.where("kind = 1").join(common.select("host", "run"), ["host", "run"], "left_semi").unionByName(array.where("kind = 0").join(scratch(wide, "wide-runs"), ["host", "run"], "left_semi"))
    covered = scratch(taken.groupBy("rid", "host").agg(F.collect_set(F.struct("kind", "block", "pos")).alias("covered")), "covered")

    def batches(it):
        for b in it:
            texts, gone = [], []
            for content, opened, cover in zip(b.column(2), b.column(3), b.column(4), strict=True):
                content, cover = content.as_py(), cover.as_py() or []
                if content:
                    text, n = _own_content(content, [c["block"] for c in cover if c["kind"] == 0])
                else:
                    text, n = _uncovered(opened.as_py() or [], [(c["block"], c["pos"]) for c in cover if c["kind"] == 1])
                texts.append(text)
                gone.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=["page_id", "url", "text", "n_covered"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = rows.join(covered, ["rid", "host"], "left").select("page_id", "url", "content", "open", "covered")
    return joined.transform(in_arrow, batches, f"page_id {kind}, url string, text string, n_covered long").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_covered")
