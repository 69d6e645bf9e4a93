"""Main text of web pages by a suffix array over each host's token streams.

A page is cut into blocks at block-level tags. The blocks of all pages of a host
make token streams, chrome and articles included; a block boundary counts as
``EDGE`` tokens of the stream, so menus and short blocks that stand alone make
long enough runs. The streams are joined, a suffix array orders their positions
by the ``RUN`` tokens that follow, and where neighbours agree but come from
distinct pages, those tokens are covered. Pages that agree in all text outside
chrome are one page here, so a page isn't covered by its own copy.

Covered runs are boilerplate and go; unique runs stay. Markup only overrules the
array where an element says what its text is: text of an article or main element
stays though other pages quote it, and menus, forms, adverts, notices, comment
sections and hidden elements (also inside an article) go though they are unique,
but no class or id makes a wrapper of an article, or of most of a page, go;
script, style and head are no text at all. An article's own header is part of
it. A page without an article of which less than a tenth is unique is a copy of
another with other surroundings: its paragraphs (``PARAGRAPH`` words) stay.

Pages are dealt by host; hosts of more than ``CHUNK`` pages or ``CHUNK_BYTES``
are split into parts by page, which changes no result: the suffix array of a
part settles what repeats within it; then the windows of ``RUN`` tokens that
could still be covered are looked up among those of the host's other parts, by
64-bit hashes, with a bitmap of fixed size that spares the shuffle the windows
that nobody asks for.

Defined cases: null html is empty, null url is a host of its own; repeated rows
and equal pages don't cover each other; very long pages are whole; an empty
table gives an empty result; extra columns are unread.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.common import kept, map_arrow, small_batches, written

#: Tokens of the stream that a repeated passage has at least; tokens that a block boundary counts for.
RUN, EDGE = 12, 4
#: Words of a block that is a paragraph.
PARAGRAPH = 25
#: Pages and bytes of a host in one part, about.
CHUNK, CHUNK_BYTES = 250, 16 << 20
#: Hosts in parts that may be broadcast; more are joined by a shuffle.
HOT_HOSTS = 100_000
#: log2 of the bits of the bitmap of wanted windows (8 MB).
BITS = 26

# HTML elements by what they hold.
NOTHING = frozenset("script style head noscript template svg math iframe object canvas audio video select option datalist textarea title".split())
CHROME = frozenset("nav footer header aside form button menu dialog fieldset label".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CHROME_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|promoted|cookies?|consent|notice|notification|alert|popup|modal|overlay|sidebar|side|menu|navbar|navigation|nav|breadcrumbs?|header|masthead|footer|foot|comments?|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|widget)(?=$|[\s_-])",
    re.I,
)
_ADVERT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted".split())
_GENERIC = frozenset("area bar block box button buttons container content footer form group header inner item items link links list outer panel section wrap wrapper".split())
_CHROME_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>])*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN, _QUOTED, _OWN_HEADER = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I), re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')"), re.compile("header", re.I)
_VOUCHED = re.compile(r"<(?:article|main)(?=[\s/>])|\brole\s*=\s*[\"']?main\b", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}

KEEP, UNSURE, DROP = 0, 1, 2
#: Stands for a block boundary in a stream; texts hold none, as white space it would have been replaced.
_MARK = "\x1c"


def _kind(tag: str, attrs: str, inside_content: bool) -> int | None:
    """What an element makes of its text: DROP, KEEP, or None for what stands around it. A header inside content is the article's own."""
    if tag in NOTHING or tag in CHROME and not (tag == "header" and inside_content):
        return DROP
    if attrs:
        if "hidden" in attrs.lower() and _HIDDEN.search(_QUOTED.sub("=", attrs)):
            return DROP
        for name, a, b, c in _ATTR.findall(attrs):
            value = a or b or c
            name = name.lower()
            if name == "role" and value.lower() in _CHROME_ROLE or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return DROP
        if re.search(r"\brole\s*=\s*[\"']?main\b", attrs, re.I):
            return KEEP
    return KEEP if tag in CONTENT else None


def _named_chrome(tag: str, attrs: str, inside_content: bool) -> bool:
    """Whether an element's class or id says that it isn't content.

    Inline elements are words of a sentence whatever they are called, but for
    adverts. Inside content an id is a place that links lead to, so all of its
    words must say so.
    """
    if tag in ("html", "body") or tag in CONTENT:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name not in ("class", "id"):
            continue
        if tag in INLINE:
            if any(word in _ADVERT for word in value.lower().split()):
                return True
            continue
        if inside_content:
            value = _OWN_HEADER.sub("", value)
        if not _CHROME_WORD.search(value):
            continue
        if name == "class" or not inside_content or all(not w or w in _GENERIC or _CHROME_WORD.fullmatch(w) for w in re.split(r"[\s_-]", value.lower())):
            return True
    return False


@lru_cache(maxsize=256)
def _tags(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])", re.I)


def _holds_content(page: str, at: int, tag: str) -> bool:
    """Whether the element that has begun before ``at`` is a wrapper: with an article or main element in it, or most of the page's words."""
    depth, end = 1, len(page)
    for m in _tags(tag).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            end = m.start()
            break
    if _VOUCHED.search(page, at, end):
        return True
    if end - at < 0.4 * len(page):
        return False
    words = lambda part: len(_TAG.sub(" ", part).split())
    return 2 * words(page[at:end]) > words(page)


def blocks(page: str) -> list[tuple[int, str]]:
    """(KEEP, UNSURE or DROP, text) of a page's blocks in order; white space is one space, empty blocks are left out."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    state, parts, at = UNSURE, [], 0

    def close() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append((state, text))
            parts.clear()

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not any(tag in NOTHING for tag, _ in stack[-3:]):
            parts.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                close()
            if opened[tag]:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                before = stack[depth][1]
                if before != state:
                    close()
                opened.subtract(t for t, _ in stack[depth:])
                del stack[depth:]
                state = before
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            close()
        if tag in VOID or m[3].endswith("/") and tag not in CONTENT | CHROME | NOTHING:
            continue
        kind = _kind(tag, m[3], state == KEEP)
        if kind is None and state != DROP and m[3] and _named_chrome(tag, m[3], state == KEEP) and not _holds_content(page, at, tag):
            kind = DROP
        new = state if kind is None or state == DROP else kind
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            opened[tag] -= 1
            state_before = stack.pop()[1]
            new = state_before if kind is None or state_before == DROP else kind
            if state_before != state:
                close()
            state = state_before
        if tag in _RAW_END and new == DROP:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in INLINE and new == state:
            continue  # its end changes nothing either
        if new != state:
            close()
        stack.append((tag, state))
        opened[tag] += 1
        state = new
    close()
    return out


def covered(streams: list[list[str]], run: int = RUN, owners: list[int] | None = None) -> list[np.ndarray]:
    """For each stream which of its tokens lie in a passage of run or more tokens that a distinct stream (of another owner, if they are given) has too.

    Positions of the joined streams are ordered by the next run tokens, by prefix
    doubling: a suffix array as deep as passages need to be.
    """
    ids: dict[str, int] = {}
    parts = [np.fromiter((ids.setdefault(t, len(ids)) for t in s), np.int64, len(s)) for s in streams]
    lengths = np.array([len(p) for p in parts], np.int64)
    total = int(lengths.sum())
    if not total:
        return [np.zeros(0, bool) for _ in parts]
    owner = np.repeat(np.arange(len(parts)) if owners is None else np.array(owners, np.int64), lengths)
    left = np.concatenate([np.arange(n, 0, -1) for n in lengths if n])  # tokens to the stream's end
    rank, depth = np.concatenate(parts), 1
    while depth < run:
        step = min(depth, run - depth)
        later = np.full(total, -1, np.int64)
        later[: max(0, total - step)] = rank[step:]
        later[left <= step] = -1
        _, rank = np.unique(rank * (rank.max() + 2) + later + 1, return_inverse=True)
        depth += step
    whole = np.flatnonzero(left >= run)
    order = whole[np.lexsort((owner[whole], rank[whole]))]
    first = np.r_[True, rank[order][1:] != rank[order][:-1]]
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], len(order)] - 1
    shared = owner[order[starts]] != owner[order[ends]] if len(order) else np.zeros(0, bool)
    hits = order[shared[group]] if len(order) else order
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + run, -1)
    return np.split(np.cumsum(edges[:-1]) > 0, np.cumsum(lengths)[:-1])


def _stream(page: list[tuple[int, str]]) -> tuple[list[str], list[tuple[int, int]]]:
    """A page's tokens with EDGE marks around each block, and where each block's tokens lie."""
    stream, places = [_MARK] * EDGE, []
    for _, text in page:
        tokens = text.split(" ")
        places.append((len(stream), len(stream) + len(tokens)))
        stream += tokens
        stream += [_MARK] * EDGE
    return stream, places


def _unsure(page: list[tuple[int, str]], places: list[tuple[int, int]], size: int) -> np.ndarray:
    """Which tokens of the stream belong to blocks that no element settles."""
    out = np.zeros(size, bool)
    for (kind, _), span in zip(page, places):
        if kind == UNSURE:
            out[slice(*span)] = True
    return out


def owner_of(page: list[tuple[int, str]]) -> int:
    """The same number for pages whose text outside chrome is the same."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest("\0".join(t for k, t in page if k != DROP).encode("utf-8", "surrogatepass"))).astype(np.int64))


def packed(page: list[tuple[int, str]]) -> bytes:
    """A page's blocks as they are shuffled and kept: each its kind and text, in one compressed frame."""
    import zstandard

    return kept("pack", lambda: zstandard.ZstdCompressor(level=3)).compress(_MARK.join(f"{kind}{text}" for kind, text in page).encode("utf-8", "surrogatepass"))


def unpacked(frame: bytes) -> list[tuple[int, str]]:
    import zstandard

    found = zstandard.ZstdDecompressor().decompress(frame).decode("utf-8", "surrogatepass")
    return [(int(x[0]), x[1:]) for x in found.split(_MARK)] if found else []


def window_hashes(host: str, stream: list[str], run: int = RUN) -> np.ndarray:
    """64-bit hashes of a stream's windows of run tokens, the same in every process."""
    import xxhash

    n = len(stream) - run + 1
    if n < 1:
        return np.zeros(0, np.int64)
    tokens = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in stream), np.uint64, len(stream))
    # With a seed of its own: pages name their host, and equal hashes would cancel out.
    total = np.full(n, xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"), seed=1), np.uint64)
    for k in range(run):
        total = (total ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def asked_windows(host: str, page: list[tuple[int, str]], cover: np.ndarray) -> np.ndarray:
    """Hashes of the windows on which it depends whether a token of the page stays."""
    stream, places = _stream(page)
    open_ = np.r_[0, np.cumsum(_unsure(page, places, len(stream)) & ~cover)]
    asked = open_[RUN:] > open_[: max(0, len(open_) - RUN)]
    return np.unique(window_hashes(host, stream)[asked]) if asked.any() else np.zeros(0, np.int64)


def _long_runs(cover: np.ndarray) -> np.ndarray:
    """cover without runs of fewer than EDGE tokens: a word that happens to follow a repeated block isn't part of it."""
    ends = np.flatnonzero(np.diff(np.r_[False, cover, False]))
    out = np.zeros(len(cover), bool)
    for a, b in zip(ends[::2], ends[1::2]):
        out[a:b] = b - a >= EDGE
    return out


def page_text(page: list[tuple[int, str]], cover: np.ndarray, host: str = "", repeated: np.ndarray | None = None) -> str:
    """A page's main text, given which tokens of its stream are covered; repeated has hashes of windows that other parts of the host have too."""
    if all(kind != UNSURE for kind, _ in page):
        return " ".join(text for kind, text in page if kind == KEEP)
    stream, places = _stream(page)
    cover = cover.copy()
    if repeated is not None and len(repeated):
        for i in np.flatnonzero(np.isin(window_hashes(host, stream), repeated)):
            cover[i : i + RUN] = True
    for (kind, _), (a, b) in zip(page, places):
        if kind == UNSURE and not (mine := cover[a:b]).all() and mine.any():
            cover[a:b] = _long_runs(mine)
    open_ = _unsure(page, places, len(stream))
    copy = 10 * (open_ & ~cover).sum() < open_.sum() and all(kind != KEEP for kind, _ in page)
    out = []
    for (kind, text), (a, b) in zip(page, places):
        if kind == KEEP or kind == UNSURE and copy and b - a >= PARAGRAPH:
            out.append(text)
        elif kind == UNSURE:
            unique = [t for t, c in zip(stream[a:b], cover[a:b]) if not c]
            if unique:
                out.append(" ".join(unique))
    return " ".join(out)


def main_texts(pages: list[list[tuple[int, str]]]) -> list[str]:
    """Main texts of pages of one host, given their blocks."""
    return [page_text(page, cover) for page, cover in zip(pages, covered([_stream(p)[0] for p in pages], owners=[owner_of(p) for p in pages]))]


def part_of(host: str, part: int) -> int:
    """A number for a part of a host."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{part} {host}".encode("utf-8", "surrogatepass")) >> 1


def _wanted(asks: DataFrame) -> np.ndarray:
    """Which top BITS bits occur among the windows asked for: 2 ** (BITS - 6) words at most reach the driver, whatever the size of the table."""
    at = F.shiftrightunsigned("window", 64 - BITS)
    with small_batches(asks.sparkSession):
        words = asks.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def extract_pages(pages: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"))

    def parse(batches):
        for batch in batches:
            found = [blocks(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([owner_of(page) for page in found], pa.int64()), pa.array(map(packed, found), pa.binary())], names=["page_id", "url", "host", "owner", "page"])

    def settle_parts(batches):
        """The suffix array of each part; a row a page with what it covers of it, and the windows to look up in other parts."""
        held, key = [], None

        def settled():
            host, _, split = key
            found = [unpacked(x) for *_, x in held]
            covers = covered([_stream(page)[0] for page in found], owners=[x[2] for x in held])
            part = part_of(*key[:2])
            out = []
            for k, ((page_id, url, _, frame), page, cover) in enumerate(zip(held, found, covers)):
                asked = asked_windows(host, page, cover).tolist() if split else []
                if asked:
                    out.append((part, k, host, page_id, url, None, frame, np.packbits(cover).tobytes(), asked))
                else:
                    out.append((part, k, None, page_id, url, page_text(page, cover), None, None, None))
            for at in range(0, len(out), 100):
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out[at : at + 100]), formats)], names=names)

        for batch in batches:
            for page_id, url, host, owner, part, split, page in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (host, part, split) != key:
                    yield from settled()
                    held = []
                key = host, part, split
                held.append((page_id, url, owner, page))
        if held:
            yield from settled()

    names = ["part", "k", "host", "page_id", "url", "text", "page", "cover", "asked"]
    formats = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()))

    sizes = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.coalesce("bytes", F.lit(0)) / chunk_bytes)).cast("int")
    hot = written(sizes.select(F.col("host").alias("hot_host"), parts.alias("parts")).where("parts > 1"), "split-hosts")
    few = hot.count() <= HOT_HOSTS
    parsed = map_arrow(rows, parse, "page_id long, url string, host string, owner long, page binary")
    dealt = parsed.join(F.broadcast(hot) if few else hot, F.col("host") == F.col("hot_host"), "left")
    dealt = dealt.select("page_id", "url", "host", "owner", F.coalesce(F.pmod(F.xxhash64("owner"), F.col("parts")), F.lit(0)).cast("int").alias("part"), F.col("parts").isNotNull().alias("split"), "page")
    whole = map_arrow(dealt.repartition("host", "part").sortWithinPartitions("host", "part"), settle_parts, "part long, k int, host string, page_id long, url string, text string, page binary, cover binary, asked array<long>")
    done = written(whole, "settled-pages", compression="zstd")

    asks = done.where("asked is not null").select("part", "k", F.explode("asked").alias("window"))
    if asks.isEmpty():
        return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    wanted = spark.sparkContext.broadcast(_wanted(asks))  # 8 MB

    def tell(batches):
        """The wanted windows of each page of a host in parts."""
        for batch in batches:
            for host, part, page in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.unique(window_hashes(host, _stream(unpacked(page))[0]))
                at = found.view(np.uint64) >> np.uint64(64 - BITS)
                found = found[(wanted.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), part_of(host, part)))], names=["window", "part"])

    told = map_arrow(dealt.where("split").select("host", "part", "page"), tell, "window long, part long")
    several = told.groupBy("window").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("window")
    marks = asks.join(several, "window", "left_semi").groupBy("part", "k").agg(F.collect_list("window").alias("repeated"))  # windows of one page

    def judge(batches):
        for batch in batches:
            texts = []
            for host, text, page, cover, repeated in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                if page is not None:
                    page = unpacked(page)
                    bits = np.unpackbits(np.frombuffer(cover, np.uint8))[: len(_stream(page)[0])].astype(bool)
                    text = page_text(page, bits, host, np.array(repeated or [], np.int64))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    ready = done.join(marks, ["part", "k"], "left").select("page_id", "url", "host", "text", "page", "cover", "repeated")
    return map_arrow(ready, judge, "page_id long, url string, text string, n_chars long")
