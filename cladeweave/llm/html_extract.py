"""Main-text extraction from raw HTML: a host suffix array, with structure as a guard.

* **Streams.**  Every page is cut into blocks of visible text.  A page that marks its article
  (``article``, ``main`` or that role) has its article's text guarded; all other visible text of all
  pages, also what the page names a menu, footer or advert, is the page's token stream.
* **Host suffix array.**  The streams of a host's pages are concatenated with a separator for each page,
  suffixes are sorted by prefix doubling, and the longest common prefixes of neighbours follow from the
  ranks.  Suffixes that share ``least_tokens`` tokens or more stand together; a substring of at least that
  length on ``least_pages`` distinct pages is boilerplate, and the tokens that it covers are removed.
  Pages with equal streams count once.
  Only hosts with a page that marks no article need this; the others are left out.
* **Unique runs.**  Of a page that marks no article the tokens that are left are its text, without blocks
  that it names boilerplate (by element, role, class or id).  Of a page that marks its article, the
  guarded text is its text.

Guarding is needed because articles that are copied between pages, and passages that articles share, are
repeated substrings too, but main text (see the README for figures).  Streams of marked pages still
count: what a marked page's menu says is known as boilerplate on pages that mark nothing.

Hosts of more than ``group_pages`` different streams are split into groups; each group counts its pages
under every window of ``least_tokens`` tokens, the counts of all groups of a host are added up, and the
windows that are frequent on the host come back to each group that has them.  So results do not depend
on the split.  Windows are named by 128-bit hashes there.

Defined results: null or empty html, or html without main text, gives an empty text; unclosed skipped
elements end where HTML ends them (with the element around them, or at the next item, cell or block), and scripts with the page; character references are decoded after tags are removed; repeated rows
are extracted each, and count as one page; pages without a host in their url (null urls too) are one
host; a header inside a marked article is article text (its title), any other header is not; what stands
in comments and scripts marks nothing; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.llm.shared import cut, lean
from cladeweave.llm.spans import mix64

#: Element and name lists.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title")
SKIP = ("head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "canvas", "audio", "video")
INLINE_SKIP = ("audio", "button", "canvas", "select", "video")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCK = (
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
)
NAMES = (
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "share", "sharing",
    "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
)
#: Words of a class or id that may follow a name (``ad-slot``, ``nav-links``), and that turn it round before it (``no-comments``).
TAILS = (
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "holder", "icons", "inner", "item", "items", "left", "link", "links",
    "list", "main", "outer", "panel", "posts", "primary", "right", "row", "secondary", "section", "signup", "slot", "text", "title", "top", "unit", "wrap", "wrapper", "zone",
)
TURNS = ("has", "hide", "is", "no", "not", "show", "toggle", "with", "without")
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar")

_RAW = "|".join(RAW)
#: Of a tag behind its name: quotes count where a value begins; what is matched is not tried another way.
_REST = r"(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+"
_TAG = re.compile(
    rf"(?is)<!--(?:-?>|.*?(?:--!?>|\Z))|<svg(?=[\s/])(?:[^>=/]+|=\s*(?:\"[^\"]*\"|'[^']*')|=|/(?!>))*+/>|<({_RAW})(?=[\s/>]){_REST}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(/?)([a-z][a-z0-9:-]*)({_REST})>|<[!?][^>]*>"
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
#: Elements whose end tags also end what is open within them; those of other elements don't reach beyond these.
_SPECIAL = frozenset(x for x in (*BLOCK, *SKIP, "caption", "td", "th") if x not in VOID)
#: Cells and tables: end tags within end nothing around them, except those of parts of tables.
_SCOPE = ("caption", "table", "td", "th")
_P_SCOPE, _LI_SCOPE = ("button", *_SCOPE), ("menu", "ol", "ul", *_SCOPE)
_TABLE_PARTS = ("caption", "table", "tbody", "td", "tfoot", "th", "thead", "tr")
#: Open elements that the start of another one ends, unless one of the second names is open within them.
_ENDED_BY = {
    "li": (("li",), _LI_SCOPE), "dd": (("dd", "dt"), ("dl", *_SCOPE)), "dt": (("dd", "dt"), ("dl", *_SCOPE)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("td", "th", "tr"), ("table",)),
    **dict.fromkeys(("tbody", "tfoot", "thead"), (("tbody", "td", "tfoot", "th", "thead", "tr"), ("table",))),
}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_IN_HEAD = ("base", "link", "meta", *RAW)
_ENDS_P = frozenset(_SPECIAL | {"hr"}) - {"body", "button", "canvas", "audio", "html", "select", "video"}
#: Kinds of blocks: guarded article text, other text, text that the page names boilerplate.
ARTICLE, PLAIN, NAMED = 0, 1, 2


def _attributes(raw: str) -> Iterator[tuple[str, str]]:
    """Lower-cased names and values of a tag's attributes, one by one."""
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] or ""
        yield m[1].lower(), (value[1:-1] if value[:1] in ("\"", "'") else value).strip().lower()


def _is_boilerplate(attributes: str) -> bool:
    for name, value in _attributes(attributes):
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and any(_is_name(x) for x in value.split()):
            return True
    return False


def _is_name(value: str) -> bool:
    """Whether one class or id is a boilerplate name: ``sidebar``, ``site-header``, ``ad-slot-2``, but not ``has-sidebar`` or ``related-topics``."""
    parts = [x for x in re.split(r"[^a-z]+", value) if x]
    while len(parts) > 1 and parts[-1] in TAILS and parts[-1] not in NAMES:
        parts.pop()
    return bool(parts) and parts[-1] in NAMES and not any(x in TURNS for x in parts[:-1])


def _clean(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((html_lib.unescape(text) if "&" in text else text).split())


def _marks_article(name: str, attributes: str) -> bool:
    return name in ("article", "main") or ("role" in attributes.lower() and any(n == "role" and not {"article", "main"}.isdisjoint(v.split()) for n, v in _attributes(attributes)))


def _closes_itself(attributes: str) -> bool:
    """Whether a tag ends with a slash that belongs to no value."""
    return "/" in attributes and attributes.rstrip().endswith("/") and not re.search(r"=\s*[^\s\"'>]*/\s*\Z", attributes)


class _Open:
    """The open elements around a place, with the ends that HTML implies: an element that is not closed ends with the one around it."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.special: list[int] = []

    def _last(self, names: tuple) -> int:
        return max((p[-1] for x in names if (p := self.places.get(x))), default=-1)

    def _cut(self, at: int) -> None:
        for name in self.names[at:]:
            self.places[name].pop()
        while self.special and self.special[-1] >= at:
            self.special.pop()
        del self.names[at:]

    def before(self, name: str, skipped: int = 0) -> None:
        """End what the start of an element ends; within a skipped element, a paragraph around it ends at the next one only."""
        if (heads := self.places.get("head")) and name not in _IN_HEAD:
            self._cut(heads[-1])
        if (paragraphs := self.places.get("p")) and name in _ENDS_P and paragraphs[-1] > self._last(_P_SCOPE) and (name == "p" or paragraphs[-1] >= skipped):
            self._cut(paragraphs[-1])
        if name in _ENDED_BY:
            ended, within = _ENDED_BY[name]
            barrier = self._last(within)
            places = [p[i] for x in ended if (p := self.places.get(x)) and (i := bisect_right(p, barrier)) < len(p)]
            if places:
                self._cut(min(places))

    def start(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in _SPECIAL:
            self.special.append(len(self.names))
        self.names.append(name)

    def end(self, name: str) -> None:
        """An end tag; one that belongs to no open element within reach says nothing."""
        at = self._last(_HEADINGS if name in _HEADINGS else (name,))
        if name in ("body", "html") or at < 0:
            return
        if name in _TABLE_PARTS:
            reach = -1 if name == "table" else self._last(("table",))
        elif name in _SPECIAL:
            reach = self._last(_P_SCOPE if name == "p" else _LI_SCOPE if name == "li" else _SCOPE)
        else:
            reach = self.special[-1] if self.special else -1
        if at > reach:
            self._cut(at)


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """Blocks of visible text in page order, each with its kind.

    Where everything that marks an article is named boilerplate or stands within an element that is, marks win (a
    second reading keeps marked elements and the elements around them) unless the page has more text than they have that
    nothing names boilerplate: then they are the comments or the sidebar of a page whose article is not marked.
    """
    page, tags = _tags(page or "")
    found = _read(page, tags, set())
    if any(kind == ARTICLE for kind, _ in found):
        return found
    around = _around_marks(tags)
    if not around:
        return found
    kept = _read(page, tags, around)
    size = lambda blocks, which: sum(len(text) for kind, text in blocks if kind == which)
    return kept if size(kept, ARTICLE) >= size(found, PLAIN) else found


def _tags(page: str) -> tuple[str, list[re.Match]]:
    """The page, without what a comment or script that is not closed hides at its end, and its tags.

    None is looked for behind the last ``>``, where each start of a tag would be read to the end of the page.
    """
    end = page.rfind(">") + 1
    tags = list(_TAG.finditer(page, 0, end))
    if tags and tags[-1].end() == end:
        last, raw = tags[-1][0], (tags[-1][1] or "").lower()
        closed = re.match(rf"{raw}[\s/>]", last.rpartition("</")[2].lower()) if raw else not last.startswith("<!--") or last.endswith(("-->", "--!>", "<!--->", "<!-->"))
        if not closed:
            return page[:end], tags
    comment = page.find("<!--", end)
    return page if comment < 0 else page[:comment], tags


def _around_marks(tags: list[re.Match]) -> set[int]:
    """Places of the outermost tags that mark an article and of those whose elements hold one."""
    found: set[int] = set()
    mark = -1  # depth of the open outermost element that marks
    opened, at = _Open(), []
    for k, m in enumerate(tags):
        name = (m[3] or "").lower()
        if not name or name in VOID or _closes_itself(m[4]):
            continue
        if m[2]:
            opened.end(name)
        else:
            opened.before(name)
        del at[len(opened.names) :]
        if len(at) <= mark:
            mark = -1
        if m[2]:
            continue
        opened.start(name)
        at.append(k)
        if mark < 0 and _marks_article(name, m[4]):
            mark = len(at) - 1
            found.update(at)
    return found


def _read(page: str, tags: list[re.Match], kept: set[int]) -> list[tuple[int, str]]:
    """Blocks of a page; the elements that the tags at ``kept`` open are not skipped."""
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    outside: list[str] | None = None  # the open block around a skipped inline element
    article: list[str] = []  # open elements that mark the article
    opened = _Open()
    skip, depth, at = "", 0, 0  # the skipped element and how many are open around it

    def close() -> None:
        if parts:
            if skip != "head" and (text := _clean(parts)):
                found.append((NAMED if skip else ARTICLE if article else PLAIN, text))
            parts.clear()

    def end_skip() -> None:
        nonlocal skip, depth, outside
        close()
        skip, depth = "", 0
        parts.extend(outside or ())
        outside = None

    for k, m in enumerate(tags):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        ends = bool(m[2])
        if name in BLOCK or (name in SKIP and name not in INLINE_SKIP):
            close()
        elif name in ("td", "th"):
            parts.append(" ")
        empty = name in VOID or (not ends and _closes_itself(m[4]))
        if ends:
            opened.end(name)
        else:
            opened.before(name, depth if skip else 0)
        own = bool(skip) and ends and name == skip  # the end tag of the skipped element, or of one within it
        if skip and len(opened.names) <= depth:
            end_skip()
            if name in ("td", "th"):
                parts.append(" ")
            elif not own and name in _SPECIAL:
                close()  # the block around an inline element that was not closed
        elif skip:
            if not ends and not empty:
                opened.start(name)
            continue
        if not ends and not empty:
            opened.start(name)
        if ends:
            if article and article[-1] == name and not own:
                article.pop()
        elif name not in VOID:
            named = k not in kept and m[4] and name not in ("html", "body") and _is_boilerplate(m[4])
            if named or (k not in kept and name in SKIP and not (name == "header" and article)):
                if name in BLOCK or (name in SKIP and name not in INLINE_SKIP):
                    close()
                else:  # the text goes on behind an inline element
                    outside = parts.copy()
                    parts.clear()
                if not empty:
                    skip, depth = name, len(opened.names) - 1
                elif outside is not None:
                    end_skip()
            elif _marks_article(name, m[4]) or (article and article[-1] == name):
                article.append(name)  # elements of the marking kind are counted to find its end
    if at < len(page):
        parts.append(page[at:])
    if skip:
        end_skip()
    close()
    return found


def main_text(page: str | None) -> str:
    """Text of the marked article; of all blocks that are not named boilerplate if the page marks none."""
    blocks = blocks_of(page)
    inside = [text for kind, text in blocks if kind == ARTICLE]
    return "\n".join(inside or [text for kind, text in blocks if kind == PLAIN])


def suffix_array(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``flat`` in order, and the length of each one's common prefix with the one before.

    Prefix doubling: round ``k`` ranks suffixes by their first ``2**k`` tokens.  The ranks of all rounds
    give common prefixes of neighbours, the longest steps first.
    """
    n = len(flat)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, rank = np.unique(flat, return_inverse=True)
    rounds, step = [rank.astype(np.int64)], 1
    while True:
        rank = rounds[-1]
        order = np.argsort(rank, kind="stable")
        if rank[order[-1]] == n - 1 or step >= n:
            break
        following = np.zeros(n, dtype=np.int64)
        following[: n - step] = rank[step:] + 1
        pair = rank * (n + 1) + following
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(pair[order[1:]] != pair[order[:-1]])
        rounds.append(new)
        step *= 2
    common = np.zeros(n, dtype=np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for k in range(len(rounds) - 1, -1, -1):
        inside = (left < n) & (right < n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = rounds[k][left[inside]] == rounds[k][right[inside]]
        # A round's rank reaches past the end only for a suffix that is shorter, and then ranks differ.
        common[1:][same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    return order, common


def repeated_tokens(streams: list[np.ndarray], least_tokens: int, least_pages: int) -> list[np.ndarray]:
    """For each token stream, which tokens lie in substrings repeated on distinct pages.

    Suffixes whose neighbours share ``least_tokens`` tokens or more form an interval of the suffix array;
    if it spans ``least_pages`` different pages, those tokens of all its suffixes are covered.
    """
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    if not sizes.sum():
        return [np.zeros(n, dtype=bool) for n in sizes]
    distinct: dict[bytes, int] = {}
    page = np.array([distinct.setdefault(s.tobytes(), len(distinct)) for s in streams])
    flat = np.concatenate([np.append(s, -1 - k) for k, s in enumerate(streams)])
    owner = np.repeat(page, sizes + 1)
    order, common = suffix_array(flat)
    interval = np.cumsum(common < least_tokens) - 1
    both = np.unique(interval * len(distinct) + owner[order]) // len(distinct)
    many = np.bincount(both, minlength=int(interval[-1]) + 1) >= least_pages
    # An interval of one suffix says nothing of its length.
    many &= np.bincount(interval) > 1
    begins = np.zeros(len(flat) + 1, dtype=np.int64)
    begins[order] = many[interval]
    starts = np.concatenate(([0], np.cumsum(begins)))
    at = np.arange(len(flat))
    covered = starts[at + 1] - starts[np.maximum(at - least_tokens + 1, 0)] > 0
    ends = np.cumsum(sizes + 1)
    return [covered[e - 1 - n : e - 1] for e, n in zip(ends, sizes, strict=True)]


def _words(page: list[str]) -> list[str]:
    return [w for block in page for w in block.split(" ")]


def _without(page: list[str], kinds: list[int], drop: np.ndarray) -> str:
    """Text of a page (a list of blocks) without named blocks and the marked tokens."""
    kept, at = [], 0
    for block, kind in zip(page, kinds, strict=True):
        tokens = block.split(" ")
        left = [w for w, d in zip(tokens, drop[at : at + len(tokens)], strict=True) if not d]
        at += len(tokens)
        if left and kind == PLAIN:
            kept.append(" ".join(left))
    return "\n".join(kept)


def unique_runs(pages: list[list[str]], kinds: list[list[int]], least_tokens: int = 8, least_pages: int = 3) -> list[str]:
    """Texts of pages (lists of blocks and their kinds) of one host without their repeated substrings."""
    table: dict[str, int] = {}
    streams = [np.array([table.setdefault(w, len(table)) for w in _words(page)], dtype=np.int64) for page in pages]
    covered = repeated_tokens(streams, least_tokens, least_pages)
    return [_without(page, kind, drop) for page, kind, drop in zip(pages, kinds, covered, strict=True)]


_WINDOW = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def window_hashes(host: str, pages: list[list[str]], least_tokens: int) -> list[np.ndarray]:
    """For each page the 128-bit hashes of its windows of ``least_tokens`` tokens, in order; hosts share none."""
    table: dict[str, bytes] = {}

    def lanes(w: str) -> bytes:
        if (found := table.get(w)) is None:
            found = table[w] = hashlib.blake2b(w.encode(), digest_size=16).digest()
        return found

    factors = mix64(np.arange(1, 2 * least_tokens + 1, dtype=np.uint64)).reshape(-1, 2) | np.uint64(1)
    start = np.frombuffer(hashlib.blake2b(host.encode(), digest_size=16, person=b"host").digest(), "<u8")
    out = []
    for page in pages:
        tokens = np.frombuffer(b"".join(map(lanes, _words(page))), "<u8").reshape(-1, 2)
        n = max(0, len(tokens) - least_tokens + 1)
        total = np.tile(start, (n, 1))
        for j in range(least_tokens if n else 0):
            total += tokens[j : j + n] * factors[j]
        out.append(total.view("<i8").view(_WINDOW).reshape(-1))
    return out


def _blocks(body: str) -> list[str]:
    return body.split("\n") if body else []


def streams(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, host, guarded, body, kinds``: per page its article's text (null if it marks none),
    and the blocks of its stream, one a line, with a digit for the kind of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            guarded, bodies, kinds = [], [], []
            for page in b.column(3):
                blocks = blocks_of(page.as_py())
                inside = [text for kind, text in blocks if kind == ARTICLE]
                rest = [(kind, text) for kind, text in blocks if kind != ARTICLE]
                guarded.append("\n".join(inside) if inside else None)
                bodies.append("\n".join(text for _, text in rest))
                kinds.append("".join(str(kind) for kind, _ in rest))
            columns = [b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.string()) for x in (guarded, bodies, kinds))]
            yield pa.record_batch(columns, names=["page_id", "url", "host", "guarded", "body", "kinds"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, host string, guarded string, body string, kinds string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = 256, least_tokens: int = 8, least_pages: int = 3) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def flush() -> pa.RecordBatch:
            hosts, keys, bodies, kinds = zip(*held, strict=True)
            texts = unique_runs([_blocks(x) for x in bodies], [[int(c) for c in k] for k in kinds], least_tokens, least_pages)
            return pa.record_batch([pa.array(hosts, pa.string()), pa.array(keys, pa.string()), pa.array(texts, pa.string())], names=["host", "key", "text"])

        for b in batches:
            for g, *row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if g != group and held:
                    yield flush()
                    held = []
                group = g
                held.append(row)
        if held:
            yield flush()

    def count_windows(group: pa.Table) -> pa.Table:
        # Pages that differ only in their blocks have equal streams and count once.
        bodies = list(dict.fromkeys(x.replace("\n", " ") for x in group["body"].to_pylist()))
        found = window_hashes(group["host"][0].as_py(), [_blocks(x) for x in bodies], least_tokens)
        windows, n = np.unique(np.concatenate([np.unique(w) for w in found]), return_counts=True)
        part = pa.array([group["part"][0].as_py()] * len(windows), pa.string())
        return pa.table([part, pa.array(windows["h1"]), pa.array(windows["h2"]), pa.array(n.astype(np.int64))], names=["part", "h1", "h2", "n"])

    def without_windows(group: pa.Table, frequent: pa.Table) -> pa.Table:
        pages = [_blocks(x) for x in group["body"].to_pylist()]
        known = np.empty(frequent.num_rows, dtype=_WINDOW)
        known["h1"], known["h2"] = frequent["h1"].to_numpy(), frequent["h2"].to_numpy()
        texts = []
        for page, kinds, windows in zip(pages, group["kinds"].to_pylist(), window_hashes(group["host"][0].as_py(), pages, least_tokens) if pages else [], strict=True):
            drop = np.zeros(len(_words(page)), dtype=bool)
            for at in np.flatnonzero(np.isin(windows, known)):
                drop[at : at + least_tokens] = True
            texts.append(_without(page, [int(c) for c in kinds], drop))
        return pa.table([group["host"].cast(pa.string()), group["key"].cast(pa.string()), pa.array(texts, pa.string())], names=["host", "key", "text"])

    key = F.sha2(F.concat("kinds", F.lit("\n"), "body"), 256)
    listed = cut(streams(pages, id_col, url_col, html_col).withColumn("key", key))
    guarded = listed.where("guarded IS NOT NULL").select("page_id", "url", F.col("guarded").alias("text"))
    if listed.where("guarded IS NULL").isEmpty():  # no page needs what its host repeats
        return guarded.withColumn("n_chars", F.length("text").cast("long"))
    # Each different stream of a host with a page that marks nothing is worked on once; equal ones fall into one group.
    bodies = listed.groupBy("host", "key", "body", "kinds").agg(F.max(F.col("guarded").isNull()).alias("open"))
    counts = bodies.groupBy("host").agg(F.ceil(F.count("*") / group_pages).alias("groups"), F.max("open").alias("needed")).where("needed")
    group = F.pmod(F.xxhash64(F.translate("body", "\n", " ")), F.col("groups")).cast("string")
    columns = ["part", "host", "key", "body", "kinds"]
    parts = cut(bodies.join(counts, "host").select(F.concat_ws("|", "host", group).alias("part"), "host", "key", "body", "kinds", (F.col("groups") > 1).alias("split")))
    whole = parts.where("NOT split").select(columns).repartition("part").sortWithinPartitions("part")
    texts = whole.mapInArrow(lean(by_host), "host string, key string, text string")
    split = parts.where("split").select(columns)
    if not split.isEmpty():
        windows = cut(split.groupBy("part").applyInArrow(count_windows, "part string, h1 long, h2 long, n long"))
        many = windows.groupBy("h1", "h2").agg(F.sum("n").alias("pages")).where(F.col("pages") >= least_pages)
        frequent = windows.join(many, ["h1", "h2"], "left_semi").select("part", "h1", "h2")
        freed = split.groupBy("part").cogroup(frequent.groupBy("part")).applyInArrow(without_windows, "host string, key string, text string")
        texts = texts.unionByName(freed)
    plain = listed.where("guarded IS NULL").select("page_id", "url", "host", "key").join(texts, ["host", "key"]).select("page_id", "url", "text")
    return guarded.unionByName(plain).withColumn("n_chars", F.length("text").cast("long"))


def boilerplate_found(pages: DataFrame, least_tokens: int = 8, least_pages: int = 3) -> dict[str, float]:
    """How the suffix array agrees with structure, for pages that fit one task: shares of pages with a stream,
    of named tokens that repeats cover, and of covered tokens that are named."""
    rows = streams(pages).select("host", "body", "kinds").collect()
    hosts: dict[str, list] = {}
    for host, body, kinds in rows:
        hosts.setdefault(host, []).append((_blocks(body), kinds))
    named = covered = both = 0
    for held in hosts.values():
        table: dict[str, int] = {}
        tokens = [np.array([table.setdefault(w, len(table)) for w in _words(page)], dtype=np.int64) for page, _ in held]
        for (page, kinds), drop in zip(held, repeated_tokens(tokens, least_tokens, least_pages), strict=True):
            is_named = np.repeat([int(c) == NAMED for c in kinds], [len(x.split(" ")) for x in page]).astype(bool)
            named, covered, both = named + int(is_named.sum()), covered + int(drop.sum()), both + int((drop & is_named).sum())
    return {"pages": sum(bool(b) for _, b, _ in rows) / max(1, len(rows)), "recall": both / max(1, named), "precision": both / max(1, covered)}
