"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in the order of their URL path; each is paired with the nearer of its two neighbours there: the
one whose path has the longer start in common with its own (the next one on ties). All text lines of the two, menus and
footers included, are aligned by longest common subsequence, and shared lines are template text, so they are deleted. A
neighbour that has all of a page's lines is a copy and says nothing about the template: the other one counts then, and if
both are copies, nothing is deleted. Lines inside <article> or <main> are main text by the page's own mark and are not
deleted, even where both pages say them. Then go the lines that differ from page to page but stand in elements that the
page itself marks as menu, header, footer, sidebar, notice, advert, form or comments: by the element's kind or role, or by
a class or id made only of such words (`ad`, `cookie-notice`; not `comments-enabled`). Such an element is taken for a
wrapper if the first <article> or <main> of the page stands in it, or, marked by class or a form, if it holds over half of the
text of a page that has neither. Lines travel as 64-bit hashes; a page's html
is never shuffled, only the blocks that its markup leaves.

Edge cases: null html is empty; pages without text give an empty text. Null URLs form one host; pages of one URL are
ordered by page id. A host with a single page is not differenced. Repeated rows get one result each; when several rows
of a host agree in URL and id, equal ones count once. Unclosed elements end with their parent or the page; a quote that
nothing closes is a character like others; a tag that nothing closes ends the page. The scan is linear in the page's
length. Invalid UTF-8 becomes U+FFFD. Extra columns are ignored.
"""

from __future__ import annotations

import html
import os.path
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity, map_batches, write_table
from .neighbours import neighbours, release

_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[a-zA-Z-]++(?:=(?:"[^"<>]*+"|[^\s"'<>=`]++))?+)*+)\s*+/?>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+)?+")
_NAMES = re.compile(r"""\b(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
_RAW_END = {n: re.compile(f"</{n}(?=[\\s/>])", re.I | re.A) for n in ("script", "style", "textarea", "title", "iframe")}
# Elements by kind, and the words of roles, classes and ids.
_FURNITURE = frozenset("nav header footer aside menu button select object svg canvas head audio video noscript template".split())
_LOOSE = frozenset("form dialog".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo popup modal cookie cookies consent notice disclaimer sidebar menu nav navbar navigation breadcrumb breadcrumbs header "
    "footer masthead comment comments disqus replies share sharing social newsletter subscribe related recommended pagination pager toolbar widget search login signup".split()
)
_BESIDE = frozenset("site page main top bottom left right global primary secondary bar box block list section area container wrapper form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


#: Bits of the alignment that are held at once; beyond, pages are halved.
HELD = 1 << 28


def _marked(attributes: str) -> bool:
    """Whether a role, class or id says that an element is furniture."""
    for kind, value in _NAMES.findall(attributes) if "=" in attributes else ():
        for token in value.strip("\"'").lower().split():
            if kind.lower() == "role":
                if token in _ROLES:
                    return True
                continue
            parts = [x for x in re.split(r"[-_]+", token) if x]
            if any(x in _WORDS for x in parts) and all(x in _WORDS or x in _BESIDE for x in parts):
                return True
    return False


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place behind the tag whose attributes begin at `at`, or -1: as browsers do, quotes count behind = only."""
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m is None:
            end = page.find(">", at)
            return end + 1 if end >= 0 else -1
        at = m.end()
        if m[0].rstrip().endswith("="):
            quote = page[at : at + 1]
            if quote in ("'", '"') and last[quote] > at:
                at = page.index(quote, at + 1) + 1
            else:
                while at < len(page) and page[at] != ">" and not page[at].isspace():
                    at += 1
        if at >= len(page):
            return -1


def lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """The page's text blocks in order: (text, whether inside article or main, whether in marked furniture)."""
    page = page or ""
    last = {c: page.rfind(c) for c in "\"'>"}
    out: list[tuple[str, bool, int]] = []
    part: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, furniture, in main
    opened: Counter[str] = Counter()
    at, size, seen_main, marks = 0, len(page), False, 0

    def state() -> tuple[int, bool]:
        """The furniture that the place is in (0: none, -1: by kind, else the number of a loose one), and in main or not."""
        return stack[-1][1:] if stack else (0, False)

    def flush() -> None:
        if part:
            text = " ".join(html.unescape("".join(part)).split())
            part.clear()
            if text:
                bad, main = state()
                out.append((text, main, bad))

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            part.append(page[at:])
            break
        if lt > at:
            part.append(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            end = page.find("-->", lt + 2 if page.startswith(("<!-->", "<!--->"), lt) else lt + 4) + 3 if page.startswith("<!--", lt) else page.find(">", lt) + 1
            at = end if end > (2 if page.startswith("<!--", lt) else 0) else size
            continue
        m = _PLAIN_TAG.match(page, lt)
        if m is not None:
            close, name, attributes, at = m[1], m[2].lower(), m[3], m.end()
        else:
            m = _NAME.match(page, lt)
            if m is None:  # no tag, but a character of the text
                part.append("<")
                at = lt + 1
                continue
            end = _tag_end(page, m.end(), last) if last[">"] > lt else -1
            if end < 0:
                break
            close, name, attributes, at = "/" if after == "/" else "", m[1].lower(), page[m.end() : end - 1], end
        if not close and name in _RAW_END:
            m = _RAW_END[name].search(page, at)
            at = m.start() if m else size
            if name in ("textarea", "title", "iframe"):
                flush()
            continue
        if name in _RAW_END:
            continue
        marked = not close and name not in ("html", "body", "article", "main") and _marked(attributes)
        if name in _INLINE and not marked and not opened[name]:
            if name == "br" and part:
                part.append(" ")
            continue
        flush()
        if close:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _CLOSED_BY and stack:  # an open element that this one ends
            if stack[-1][0] in (_CLOSED_BY[name] or {"p"}):
                pop()
        elif stack and stack[-1][0] == "p":
            pop()
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        bad, main = state()
        if name in ("article", "main"):
            if not seen_main:
                bad = 0
            elif not bad and name == "article" and _marked(attributes):
                bad = -1
            main = main or not bad
            seen_main = True
        elif not bad and name in _FURNITURE:
            bad = -1
        elif not bad and (marked or name in _LOOSE):
            marks += 1
            bad = marks
        stack.append((name, bad, main))
        opened[name] += 1
    flush()
    if not seen_main and marks:
        held: defaultdict[int, int] = defaultdict(int)
        for text, _, bad in out:
            held[bad] += len(text)
        wrappers = {k for k, n in held.items() if k > 0 and 2 * n > sum(held.values())}
        return [(t, main, bad != 0 and bad not in wrappers) for t, main, bad in out]
    return [(t, main, bad != 0) for t, main, bad in out]


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of one longest common subsequence with b; bit-parallel, halved like Hirschberg where long."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = list(range(low))
    mid = _middle(a[low : len(a) - high], b[low : len(b) - high])
    return out + [low + i for i in mid] + list(range(len(a) - high, len(a)))


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Row by row of a: zero bits mark where the length of the subsequence with b grows."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _middle(a: list[int], b: list[int]) -> list[int]:
    both = set(a) & set(b)
    keep = [i for i, x in enumerate(a) if x in both]
    a, b = [a[i] for i in keep], [x for x in b if x in both]
    if not a or not b:
        return []
    if len(a) * len(b) > HELD and len(a) > 1:  # too many bits to hold: cut a in half, b where both halves do best
        h = len(a) // 2
        ahead, back = _rows(a[:h], b)[-1], _rows(a[:h - 1 : -1] if h else a[::-1], b[::-1])[-1]
        left = np.concatenate(([0], np.cumsum([not ahead >> j & 1 for j in range(len(b))])))
        right = np.concatenate(([0], np.cumsum([not back >> j & 1 for j in range(len(b))])))[::-1]
        cut = int(np.argmax(left + right))
        found = _middle(a[:h], b[:cut]) + [h + i for i in _middle(a[h:], b[cut:])]
        return [keep[i] for i in found]
    rows, out, j = _rows(a, b), [], len(b)
    for i in range(len(a) - 1, -1, -1):
        if not j:
            break
        here = j - (rows[i] & ((1 << j) - 1)).bit_count()  # length with b[:j]
        above = j - (rows[i - 1] & ((1 << j) - 1)).bit_count() if i else 0
        if here > above:  # a[i] takes part, with the last b that equals it: no other leaves more to the rows above
            out.append(keep[i])
            j -= 1
            while b[j] != a[i]:
                j -= 1
    return out[::-1]


def template(own: list[int], path: str, others: list[tuple[str, list[int]]]) -> list[int]:
    """The places of the lines that a page shares with the nearer of its neighbours that is no copy of it."""
    for _, them in sorted(others, key=lambda o: -len(os.path.commonprefix((path, o[0])))):
        shared = common(own, them)
        if len(shared) < len(own):
            return shared
    return []


def blocks(page: str | None) -> tuple[bytes, bytes]:
    """The blocks that markup leaves, by lines, and of every block in order whether it is furniture (2), main text (1) or neither."""
    found = lines(page)
    return "\n".join(t for t, _, bad in found if not bad).encode("utf-8", "surrogatepass"), bytes(2 if bad else int(main) for _, main, bad in found)


def kept(texts: bytes, kinds: bytes, shared: list[int] | None) -> tuple[str, int, int]:
    """The main text of blocks(), and how many blocks went as template text, and as furniture afterwards."""
    gone, out, cut, marked = set(shared or ()), [], 0, 0
    left = iter(texts.decode("utf-8", "surrogatepass").split("\n"))
    for i, kind in enumerate(kinds):
        text = None if kind == 2 else next(left)
        if i in gone and kind != 1:
            cut += 1
        elif kind == 2:
            marked += 1
        else:
            out.append(text)
    return "\n".join(out), cut, marked


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_template, n_marked) for every page: its text, and how many blocks the differencing deleted
    and how many went by their markup."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    rows = rows.withColumn("rid", identity("page_id", "url", "html"))

    def marks(b: dict) -> dict:
        hashes = [[xxhash.xxh3_64_intdigest(x[0].encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines(p)] for p in b["html"]]
        return {c: b[c] for c in ("rid", "page_id", "url")} | {"lines": hashes}

    kind = pages.schema[page_id].dataType.simpleString()
    known = map_batches(rows.select("rid", "page_id", "url", "html"), marks, f"rid string, page_id {kind}, url string, lines array<long>")
    address = F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    known = known.groupBy("rid").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("lines").alias("lines"))
    known = known.withColumn("host", F.regexp_extract(address, "^[^/?#]*", 0)).withColumn("path", F.regexp_replace(F.regexp_replace(address, "^[^/?#]*", ""), r"[?#].*$", ""))
    near = neighbours(known.select("host", "path", "page_id", "rid", "lines"), ["host", "path", "page_id", "rid"], ["host", "path", "lines"])
    other = lambda x: F.when(F.col(f"{x}.host") == F.col("host"), F.struct(f"{x}.path", f"{x}.lines"))

    def align(b: dict) -> dict:
        found = [template(own, path, [(o["path"], o["lines"]) for o in (a, z) if o]) for own, path, a, z in zip(b["lines"], b["path"], b["a"], b["z"])]
        return {"rid": b["rid"], "shared": found}

    shared = write_table(map_batches(near.select("rid", "lines", "path", other("after").alias("a"), other("before").alias("z")), align, "rid string, shared array<int>"), "shared")
    release(near)

    def strip(b: dict) -> dict:
        found = [blocks(p) for p in b["html"]]
        return {c: b[c] for c in ("rid", "page_id", "url")} | {"texts": [zlib.compress(f[0], 1) for f in found], "kinds": [f[1] for f in found]}

    def cut(b: dict) -> dict:
        got = [kept(zlib.decompress(t), k, x) for t, k, x in zip(b["texts"], b["kinds"], b["shared"])]
        return {"page_id": b["page_id"], "url": b["url"], "text": [g[0] for g in got], "n_template": [g[1] for g in got], "n_marked": [g[2] for g in got]}

    # what is furniture goes before pages meet their shared lines, whose places alone tell what to count
    stripped = map_batches(rows, strip, f"rid string, page_id {kind}, url string, texts binary, kinds binary")
    return map_batches(stripped.join(shared, "rid", "left").select("page_id", "url", "texts", "kinds", "shared"), cut, f"page_id {kind}, url string, text string, n_template int, n_marked int")
