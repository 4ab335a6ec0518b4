"""Main text of web pages by template deduction from equivalence classes.

A token is a block tag with its role, which is the path of block tags above it with their
classes, or a whole text block with its path. A token's occurrence vector says how often each
page of a host holds it; tokens of equal vectors form an equivalence class. A class is valid if
its tokens come in the same order in every cycle on every page, and if each cycle lies within
one gap of the classes around it. The root class, once on every page, holds the template's
frame; its texts are the template's own. What lies in the gaps are slots. A host's main slot is
the container of most text that is neither template nor link: an article if there is one, else
the innermost container that holds half of all. Where that slot is missing on a page, and on
hosts of few pages, which deduce nothing, the same choice is made from the page alone.

Spark never holds a vector: its fingerprint is two sums of hashes of (page, count), so vectors
of a host of any size are counted in pieces before the shuffle. A token counts only if half of
the host's pages hold it, so a template is no longer than two pages of mean length.

Pages are read three times: to count tokens, to check the classes and weigh the slots, and to
extract. The templates reach the pages by broadcast if they hold at most BROADCAST_TOKENS
tokens, else by a join in which large hosts are salted.

Nulls and odd rows: a null html has the text ''; a null url belongs to no host. Equal rows give
equal rows. Tags may be unclosed, cut off or wrongly nested; a page without tags is one block.
White space is what Unicode calls so. A line break tag is white space inside a block. Inside
an article its own header gives its headings only.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Written, bound_batches
from quillspark.llm.words import mix

#: Pages that a host needs for a template.
LEAST_PAGES = 8
#: Tokens of all templates together that are broadcast at most.
BROADCAST_TOKENS = 200_000
#: A host with this part of all pages is salted.
HOT_PART = 1000
SALTS = 64

# Tags of HTML by what they mean for the text.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup
    hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Tags whose text isn't the article's.
DROPPED = frozenset(
    """aside audio button canvas dialog embed fieldset footer form head iframe input menu nav noembed noframes noscript object option script select style svg template
    textarea title video""".split()
)
CONTAINERS = frozenset("article body center div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes: the tags, and those beyond which it doesn't look.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "body": (("head",), ()),
}
P_SCOPE = ("table", "td", "th", "caption", "button", "object", "template")
#: Words of classes, ids and roles that mark what isn't the article.
MARKS = frozenset(
    """ad ads advert advertisement advertising adverts alert alertdialog aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie
    cookies copyright dialog disqus foot footer form gdpr login menu menubar modal nav navbar navigation newsletter notice notices notification
    overlay pager pagination popup promo promotion recommended related replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar
    topbar widget widgets""".split()
)
HEADER_MARKS = frozenset("head header masthead".split())
UNMARKS = frozenset("has with no without".split())

_SCAN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_ROOT = 0


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_path = lru_cache(maxsize=1 << 16)(_hash)


@lru_cache(maxsize=1 << 12)
def _traits(tag: str, raw: str) -> tuple[str, bool, bool, bool]:
    """Signature of a tag; whether its kind or its marks keep it out; whether it is a header; whether it says that it is the article."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}
    names, role = f"{found.get('class', '')} {found.get('id', '')}".split(), found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").lower().replace(" ", "")
    marks: set[str] = set()
    for name in names if tag not in ("html", "body", "main") else ():
        words = {w.lower() for w in _WORD.findall(name)}
        marks |= set() if words & UNMARKS else words
    out = tag in DROPPED or role in MARKS or hidden or bool(marks & MARKS)
    main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
    return f"{tag}.{re.sub('[0-9][0-9]+', '00', ' '.join(names))}", out, tag == "header" or bool(marks & HEADER_MARKS), main and not out


class Page:
    """A page's block elements and text blocks in order.

    Elements: parent, path (a hash), depth, tag, out (not of the article), head (in an article's
    own header), main (says that it is the article), inside (it or one above it does). Blocks:
    element, text, characters outside of links, token. sequence: all tokens.
    """

    def __init__(self, source: str):
        self.parent, self.path, self.depth, self.tag = [0], [_ROOT], [0], ["body"]
        self.out, self.head, self.main, self.inside = [False], [False], [False], [False]
        self.blocks: list[tuple[int, str, int, int]] = []
        self.sequence: list[int] = []
        self._stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, block element, keeps text out
        self._open: dict[str, list[int]] = {}  # places in the stack by name
        self._open_blocks = [0]
        self._run: list[str] = []
        self._free = self._links = 0  # characters outside of links, open links
        self._read(source)

    def _read(self, source: str) -> None:
        pos, end = 0, len(source)
        while pos < end:
            m = _SCAN.search(source, pos)
            self._say(source[pos : m.start() if m else end])
            if not m:
                break
            pos = m.end()
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self._shut(name)
                elif self._enter(name, m[3]):
                    close = _END[name].search(source, pos)
                    pos = close.end() if close else end
        self._flush()

    def _say(self, text: str) -> None:
        if text and not self._stack[-1][2]:
            self._run.append(html.unescape(text) if "&" in text else text)
            self._free += 0 if self._links else len(text)

    def _flush(self) -> None:
        if text := " ".join("".join(self._run).split()):
            node = self._stack[-1][1]
            token = _hash(self.path[node], text)
            self.blocks.append((node, text, min(self._free, len(text)), token))
            self.sequence.append(token)
        self._run.clear()
        self._free = 0

    def _pop(self, place: int) -> None:
        while len(self._stack) > place:
            name = self._stack.pop()[0]
            self._open[name].pop()
            self._links -= name == "a"
        while self._open_blocks[-1] >= place:
            self._open_blocks.pop()

    def _shut(self, name: str) -> None:
        """An end tag: closes the innermost open element of its name; one that is no block only within its block."""
        block = name in BLOCKS
        if block:
            self._flush()
        if places := self._open.get(name):
            if block:
                self.sequence.append(~self.path[self._stack[places[-1]][1]])
                self._pop(places[-1])
            elif places[-1] > self._open_blocks[-1]:
                self._pop(places[-1])

    def _close_implied(self, names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        bound = max((self._open[n][-1] for n in scope if self._open.get(n)), default=0)
        inner = [self._open[n][-1] for n in names if self._open.get(n) and self._open[n][-1] > bound]
        if inner:
            self._pop(min(inner))

    def _enter(self, name: str, attributes: str) -> bool:
        """A start tag; whether raw text follows."""
        block = name in BLOCKS
        if block:
            self._flush()
            if name in CLOSES:
                self._close_implied(*CLOSES[name])
            self._close_implied(("p",), P_SCOPE)
        elif name == "br":
            self._run.append(" ")
        signature, out, header, main = _traits(name, attributes)
        _, node, quiet = self._stack[-1]
        if block:
            above, node = node, len(self.path)
            self.parent.append(above)
            self.path.append(_path(self.path[above], signature))
            self.depth.append(self.depth[above] + 1)
            self.tag.append(name)
            self.out.append(self.out[above] or out or header and not self.inside[above])
            self.head.append((self.head[above] or header and self.inside[above]) and name not in HEADINGS)
            self.main.append(main and not self.out[node])
            self.inside.append(self.main[node] or self.inside[above])
            self.sequence.append(self.path[node])
        if name in RAW:
            return True
        if name not in VOID:
            self._open.setdefault(name, []).append(len(self._stack))
            if block:
                self._open_blocks.append(len(self._stack))
            self._links += name == "a"
            self._stack.append((name, node, quiet or not block and (out or header)))
        return False

    def kept(self, template: frozenset[int]) -> Iterator[tuple[int, str, int]]:
        """Element, text and characters outside of links of the blocks that may be the article's."""
        for node, text, free, token in self.blocks:
            if not self.out[node] and not self.head[node] and token not in template:
                yield node, text, free

    def weights(self, template: frozenset[int]) -> dict[int, list[int]]:
        """By path of containers: elements, characters outside of links in all below, depth, 1 if it says that it is the article."""
        below = [0] * len(self.path)
        for node, _, free in self.kept(template):
            below[node] += free
        for node in range(len(below) - 1, 0, -1):
            below[self.parent[node]] += below[node]
        found: dict[int, list[int]] = {_ROOT: [1, below[0], 0, 0]}
        for node in range(1, len(below)):
            if self.tag[node] in CONTAINERS and not self.out[node] or self.main[node]:
                one = found.setdefault(self.path[node], [0, 0, self.depth[node], 0])
                one[0] += 1
                one[1] += below[node]
                one[3] |= self.main[node]
        return found

    def text(self, main: int, template: frozenset[int]) -> str:
        """The kept blocks of the elements with that path."""
        inside = [main == _ROOT]
        for node in range(1, len(self.path)):
            inside.append(self.path[node] == main and not self.out[node] or inside[self.parent[node]])
        return "\n".join(text for node, text, _ in self.kept(template) if inside[node])


def main_slot(weights: dict[int, list[int]]) -> int:
    """The path of the main slot of one page, by the rules that main_slots follows for hosts."""
    total = weights[_ROOT][1]
    best = max((w[1] for w in weights.values() if w[3]), default=0)
    if best and 4 * best >= total:
        fit = [(w[2], -p) for p, w in weights.items() if w[3] and 2 * w[1] >= best]
    else:
        fit = [(w[2], -p) for p, w in weights.items() if w[0] == 1 and 2 * w[1] >= total]
    return -max(fit)[1]


def host(url: Column) -> Column:
    """The lower-case host of a URL; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _sources(batch: pa.RecordBatch, name: str = "html") -> Iterator[str]:
    for value in batch.column(name):
        yield value.as_py() or ""


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


_COUNTED = pa.schema([("host", pa.string()), ("token", pa.int64()), ("pages", pa.int64()), ("times", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token of a batch: pages, occurrences and the sums of the halves of the hashes of (page, count). Token 0 is the page itself."""
    for batch in batches:
        found: dict[tuple[str, int], list[int]] = {}
        for name, source, ident in zip(batch.column("host").to_pylist(), _sources(batch), batch.column("page").to_pylist(), strict=True):
            counts: dict[int, int] = {_ROOT: 1}
            for token in Page(source).sequence:
                counts[token] = counts.get(token, 0) + 1
            with np.errstate(over="ignore"):
                prints = mix(np.array(list(counts.values()), np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ident & (1 << 64) - 1))
            for (token, n), low, high in zip(counts.items(), (prints & np.uint64(0xFFFFFFFF)).tolist(), (prints >> np.uint64(32)).tolist(), strict=True):
                one = found.setdefault((name, token), [0, 0, 0, 0])
                one[0] += 1
                one[1] += n
                one[2] += low
                one[3] += high
        yield _emit([(*k, *v) for k, v in found.items()], _COUNTED)


def templates(pages: DataFrame) -> Written:
    """By host of at least LEAST_PAGES pages: pages, tokens, their classes, and how many of these begin with the root class.

    A token's class is a hash of its fingerprint; tokens that half of the pages hold are kept.
    """
    keyed = pages.where("host IS NOT NULL").withColumn("page", F.xxhash64("page_id", "url", "html"))
    counts = keyed.mapInArrow(_count, "host string, token long, pages long, times long, low long, high long")
    counts = Written(counts.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "times", "low", "high"))).where(F.col("pages") >= LEAST_PAGES), "tokens")
    hosts = counts.df.where(F.col("token") == _ROOT).select("host", F.col("pages").alias("of"), F.col("low").alias("root_low"), F.col("high").alias("root_high"))
    kept = counts.df.where(F.col("token") != _ROOT).join(hosts, "host").where("2 * pages >= of")
    same = (F.col("low") == F.col("root_low")) & (F.col("high") == F.col("root_high"))
    one = F.struct(F.when(same, 0).otherwise(F.xxhash64("pages", "times", "low", "high")).alias("class"), "token")
    out = Written(kept.groupBy("host").agg(F.max("of").alias("of"), F.array_sort(F.collect_list(one)).alias("tokens")).select("host", "of", F.col("tokens.token").alias("tokens"), F.col("tokens.class").alias("classes")), "templates")
    counts.drop()
    return out


def broken(sequence: list[int], classes: dict[int, int], sizes: dict[int, int]) -> tuple[set[int], dict[int, list[int]]]:
    """The classes that a page's tokens show to be unordered or not nested, and each class's order in its first cycle."""
    orders: dict[int, list[int]] = {}
    place: dict[int, int] = {}
    bad: set[int] = set()
    stack: list[list[int]] = []
    for token in sequence:
        own = classes.get(token)
        if own is None:
            continue
        order = orders.setdefault(own, [])
        if token not in place:
            place[token] = len(order)
            order.append(token)
        at = place[token]
        if at == 0:
            if sizes[own] > 1:
                stack.append([own, 1])
            continue
        while stack and stack[-1][0] != own and any(c == own for c, _ in stack):
            bad.add(stack.pop()[0])  # its cycle doesn't end in the gap where it began
        if stack and stack[-1] == [own, at]:
            stack[-1][1] += 1
            if at + 1 == sizes[own]:
                stack.pop()
        else:
            bad.add(own)
    bad.update(c for c, _ in stack)
    return bad, orders


_WEIGHED = pa.schema([("host", pa.string()), ("slot", pa.bool_()), ("key", pa.int64()), ("pages", pa.int64()), ("amount", pa.int64()), ("elements", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("main", pa.int64())])


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host: the pages that break its root class, on which the template rests, and the hashes of its orders; its slots' containers with their weights."""
    known: dict[str, tuple[dict[int, int], dict[int, int], frozenset[int]]] = {}
    for batch in batches:
        found: dict[tuple[str, bool, int], list[int]] = {}
        for name, source, tokens, kinds in zip(batch.column("host").to_pylist(), _sources(batch), batch.column("tokens"), batch.column("classes"), strict=True):
            if name not in known:
                if len(known) > 256:
                    known.clear()
                classes = dict(zip(tokens.as_py(), kinds.as_py(), strict=True))
                sizes: dict[int, int] = {}
                for c in classes.values():
                    sizes[c] = sizes.get(c, 0) + 1
                known[name] = classes, sizes, frozenset(t for t, c in classes.items() if c == 0)
            classes, sizes, root = known[name]
            page = Page(source)
            bad, orders = broken(page.sequence, classes, sizes)
            if 0 in orders:
                print_ = zlib.crc32(np.array(orders[0], np.int64).tobytes())
                _add(found, (name, False, 0), 0 in bad, len(orders[0]), print_, print_, 0)
            for path, (n, chars, depth, main) in page.weights(root).items():
                _add(found, (name, True, path), chars, n, depth, depth, main)
        yield _emit([(*k, *v) for k, v in found.items()], _WEIGHED)


def _add(found: dict[tuple[str, bool, int], list[int]], key: tuple[str, bool, int], amount: int, elements: int, least: int, most: int, main: int) -> None:
    one = found.setdefault(key, [0, 0, 0, least, most, 0])
    for i, v in ((0, 1), (1, int(amount)), (2, elements)):
        one[i] += v
    one[3], one[4], one[5] = min(one[3], least), max(one[4], most), max(one[5], int(main))


def main_slots(weighed: DataFrame) -> DataFrame:
    """host, the path of its main slot, and whether its root class is valid, from what _weigh counted.

    A slot must be on half of the host's pages; one that doesn't say that it is the article must
    be about once on each. Ties go to the deeper and then the smaller path.
    """
    slots = weighed.where("slot")
    hosts = slots.where(F.col("key") == _ROOT).select("host", F.col("pages").alias("of"), F.col("amount").alias("total"))
    fit = slots.join(hosts, "host").where("2 * pages >= of")
    best = fit.where("main = 1").groupBy("host").agg(F.max("amount").alias("best"))
    fit = fit.join(best, "host", "left").withColumn("best", F.when(4 * F.col("best") >= F.col("total"), F.col("best")))
    fit = fit.where("best IS NOT NULL AND best > 0 AND main = 1 AND 2 * amount >= best OR (best IS NULL OR best = 0) AND 2 * elements <= 3 * pages AND 2 * amount >= total")
    chosen = fit.groupBy("host").agg(F.max_by("key", F.struct("most", -F.col("key"))).alias("main"))
    valid = weighed.where((F.col("key") == 0) & ~F.col("slot")).select("host", F.expr("amount = 0 AND least = most").alias("valid"))
    return chosen.join(valid, "host", "left").select("host", "main", F.coalesce("valid", F.lit(False)).alias("valid"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, main, tokens in zip(_sources(batch), batch.column("main").to_pylist(), batch.column("template"), strict=True):
            page = Page(source)
            template = frozenset(tokens.as_py() or ())
            if main is None or main not in page.path:
                main = main_slot(page.weights(template))
            texts.append(page.text(main, template).encode("utf-8", "replace"))
        rest = [batch.column(c) for c in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.binary()).cast(pa.string())], ["page_id", "url", "text"])


def _meet(pages: DataFrame, hosts: DataFrame, n_tokens: int, hot: list[str]) -> DataFrame:
    """pages with the columns of their host, nulls where there are none."""
    if n_tokens <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(hosts), "host", "left")
    salt = F.when(F.col("host").isin(hot), F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("host").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return pages.withColumn("salt", salt).join(hosts.withColumn("salt", F.explode(salts)), ["host", "salt"], "left").drop("salt")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page. pages: page_id, url, html; more columns are ignored."""
    bound_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    found = templates(rows)
    size = found.df.agg(F.sum(F.size("tokens")).alias("tokens"), F.sum("of").alias("of")).first()
    n_tokens, least = size.tokens or 0, (size.of or 0) / HOT_PART
    hot = [r.host for r in found.df.where(F.col("of") >= least).select("host").limit(HOT_PART).collect()] if n_tokens > BROADCAST_TOKENS else []
    known = _meet(rows.where("host IS NOT NULL"), found.df.drop("of"), n_tokens, hot).where("tokens IS NOT NULL")
    weighed = known.select("host", "html", "tokens", "classes").mapInArrow(_weigh, "host string, slot boolean, key long, pages long, amount long, elements long, least long, most long, main long")
    sums = (F.sum(c).alias(c) for c in ("pages", "amount", "elements"))
    weighed = Written(weighed.groupBy("host", "slot", "key").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"), F.max("main").alias("main")), "weighed")
    template = F.when(F.col("valid"), F.filter(F.transform("tokens", lambda t, i: F.when(F.get("classes", i) == 0, t)), lambda t: t.isNotNull()))
    hosts = Written(found.df.join(main_slots(weighed.df), "host").select("host", "main", template.alias("template")), "slots")
    weighed.drop()
    found.drop()
    return _meet(rows, hosts.df, n_tokens, hot).select("page_id", "url", "html", "main", "template").mapInArrow(_extract, "page_id long, url string, text string")


def op11(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
