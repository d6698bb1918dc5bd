"""Main text of pages by the template that pages of one host share.

Tags (by their path) and whole text nodes are tokens. Tokens with equal occurrence vectors over
the pages of a host form an equivalence class; valid classes, which nearly every page
holds once and in one order, are the template's skeleton, and classes whose every occurrence
lies in one of its gaps are nested there. Gaps are slots. Slots that pages fill with long, varied
text outside links hold content; the skeleton's deepest element around most of it is where the
main text stands. One template a host is deduced, then all pages of the host are read by it.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Distinct pages from which on variation between pages counts, share of them that holds a token
#: of the skeleton, characters a page from which on a slot is long, share of the content around
#: which the main element stands.
LEAST, SHARE, LONG, MOST = 4, 0.9, 80, 0.8
_raw = re.compile(r"<!--|<(script|style|noscript|template|svg|iframe|textarea|title)\b", re.I)
_ends = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe textarea title".split()}
_token = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*(?:>|\Z)|([^<]+|<)""", re.S)
_attribute = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_word = re.compile(r"[a-z]+")
_void = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_blocks = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold running text, never the main element.
_leaves = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption summary".split())
_boiler_tags = frozenset("nav footer aside form button select option label head menu dialog input fieldset".split())
_boiler_words = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget".split()
)
#: Words that may stand beside one of them in a name, as in ``site-footer`` or ``comment-list``.
_beside_words = frozenset(
    "area articles bar block body bottom box button buttons container content entry form group header holder icons inner item items left links list main outer page panel placeholder "
    "post posts right row section site slot thread title top unit user users wrap wrapper".split()
)


class Paths:
    """Paths of open elements as numbers: each is its parent's number and a label, kept once. A path
    below others has the higher number. Numbers of ``base``, which isn't changed, hold here too."""

    def __init__(self, base: "Paths | None" = None):
        self.base, self.first = base, len(base) if base else 1
        self.ids: dict[tuple[int, str], int] = {}
        self.keys: list[tuple[int, str]] = []
        self.depths: list[int] = []

    def __len__(self) -> int:
        return self.first + len(self.keys)

    def child(self, path: int, label: str) -> int:
        if self.base and path < self.first and (path, label) in self.base.ids:
            return self.base.ids[path, label]
        found = self.ids.get((path, label))
        if found is None:
            found = self.ids[path, label] = len(self)
            self.depths.append(self.depth(path) + 1)
            self.keys.append((path, label))
        return found

    def known(self, path: int, label: str) -> int:
        """The number of a path, 0 where nothing has it."""
        return (self.base.ids.get((path, label)) if self.base else None) or self.ids.get((path, label), 0)

    def parent(self, path: int) -> int:
        return 0 if not path else self.base.parent(path) if path < self.first else self.keys[path - self.first][0]

    def label(self, path: int) -> str:
        return self.base.label(path) if path < self.first else self.keys[path - self.first][1]

    def depth(self, path: int) -> int:
        return 0 if not path else self.base.depth(path) if path < self.first else self.depths[path - self.first]

    def summed(self, sizes: dict[int, int]) -> dict[int, int]:
        """What a path and all below it add up to, in one walk from the highest number down."""
        out = dict(sizes)
        heap = [-p for p in out if p]
        heapify(heap)
        while heap:
            p = -heappop(heap)
            up = self.parent(p)
            if up and up not in out:
                heappush(heap, -up)
            out[up] = out.get(up, 0) + out[p]
        return out

    def below(self, main: int) -> Callable[[int], bool]:
        """Whether a path is ``main`` or below it; what was asked is remembered."""
        seen = {main: True, 0: not main}

        def asked(path: int) -> bool:
            way = []
            while path not in seen:
                if path < main:
                    seen[path] = False
                    break
                way.append(path)
                path = self.parent(path)
            for p in way:
                seen[p] = seen[path]
            return seen[path]

        return asked


@dataclass
class Text:
    """A text node: its token, its place among the page's tokens, and where it stands."""

    token: tuple
    place: int
    text: str
    block: int
    boiler: bool
    main: bool
    link: bool


@dataclass
class Page:
    paths: Paths = field(default_factory=Paths)
    tokens: list[tuple] = field(default_factory=list)
    texts: list[Text] = field(default_factory=list)


def _named_boiler(name: str) -> bool:
    """Whether a class, id or role names boilerplate: as a whole or by its words, of which all are
    such words or words that stand beside them. ``social-policy`` or ``ad-hoc`` don't."""
    if name in _boiler_words:
        return True
    words = _word.findall(name)
    return len(words) > 1 and not _boiler_words.isdisjoint(words) and all(w in _boiler_words or w in _beside_words for w in words)


def _is_boiler(tag: str, attributes: str) -> tuple[bool, str, bool]:
    """Whether a tag opens a boilerplate region, its label, and whether it opens the main one."""
    names, main, hidden, listed = [], tag in ("article", "main"), False, False
    for m in _attribute.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names += _word.findall(value)
            listed |= any(map(_named_boiler, value.split()))
            main |= key == "role" and value == "main"
        else:
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "")
    boiler = hidden or tag in _boiler_tags or tag not in ("html", "body", "article", "main") and listed
    return boiler, tag + "".join("." + n for n in names[:4]), main


_often_boiler = lru_cache(20_000)(_is_boiler)


def _bare(source: str) -> str:
    """A page without comments, scripts, styles and the like, each a blank; one that isn't closed
    goes to the end. One pass: what isn't found once isn't looked for again."""
    parts, at = [], 0
    while m := _raw.search(source, at):
        if m[1] is None:
            end = source.find("-->", m.end())
            end = end + 3 if end >= 0 else len(source)
        else:
            opened = source.find(">", m.end())
            if opened < 0:
                break
            closed = _ends[m[1].lower()].search(source, opened + 1)
            end = closed.end() if closed else len(source)
        parts += [source[at : m.start()], " "]
        at = end
    return "".join([*parts, source[at:]])


class _Open:
    """The open elements (tag, path, boilerplate, main), and how many there are of each tag."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, bool]] = []
        self.count: Counter = Counter()

    def push(self, tag: str, *more) -> None:
        self.stack.append((tag, *more))
        self.count[tag] += 1

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.count[self.stack.pop()[0]] -= 1

    def close(self, tag: str) -> bool:
        """End the innermost element of a tag and those in it, if there is one."""
        if not self.count[tag]:
            return False
        while self.stack[-1][0] != tag:
            self.cut(len(self.stack) - 1)
        self.cut(len(self.stack) - 1)
        return True

    def end_before(self, tag: str, bounds: frozenset) -> None:
        """End the innermost element of a tag if no bound lies in it."""
        if self.count[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self.cut(i)
                    break
                if self.stack[i][0] in bounds:
                    break

    def top(self) -> tuple[int, bool, bool]:
        return self.stack[-1][1:] if self.stack else (0, False, False)


_rows, _lists = frozenset("li dt dd tr td th".split()), frozenset("ul ol dl table tr menu".split())


def parse(source: str | None, paths: Paths | None = None) -> Page:
    """Tokens and text nodes of a page; unclosed tags end with their parents or by a new block.
    Pages that are compared with each other share ``paths``."""
    page = Page(Paths() if paths is None else paths)
    open_, block = _Open(), 0
    for m in _token.finditer(_bare(source or "")):
        closing, tag, attributes, text = m.groups()
        path, boiler, main = open_.top()
        if text is not None:
            if not text.isspace():
                text = html.unescape(text)
                clean = " ".join(text.split())
                if clean:
                    page.texts.append(Text((path, clean), len(page.tokens), text, block, boiler, main, open_.count["a"] > 0))
                    page.tokens.append((path, clean))
                    continue
            if page.texts and page.texts[-1].block == block:
                page.texts[-1].text += " "
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _blocks:
            block += 1
        elif tag == "br" and page.texts:
            page.texts[-1].text += " "
        if closing:
            if open_.close(tag):
                page.tokens.append((path, "/" + tag))
            continue
        if tag in _blocks:  # a new block ends an open paragraph, a new item or cell the one before it
            open_.end_before("p", _blocks - {"p", "li"})
            if tag in _rows:
                open_.end_before(tag, _lists - {tag})
            path, boiler, main = open_.top()
        bad, label, opens = (_often_boiler if len(attributes or "") < 500 else _is_boiler)(tag, attributes or "")
        if tag == "header" and not main:
            bad = True
        page.tokens.append((path, "<" + label))
        if tag in _void or (attributes or "").endswith("/"):
            continue
        if tag in _blocks or bad or opens:
            path = page.paths.child(path, label)
        open_.push(tag, path, boiler or bad, main or opens)
    return page


def equivalence_classes(pages: list[Page]) -> dict[tuple, list[tuple]]:
    """Occurrence vector over the pages to the tokens that have it."""
    counts: dict[tuple, list[int]] = defaultdict(lambda: [0] * len(pages))
    for i, page in enumerate(pages):
        for token, n in Counter(page.tokens).items():
            counts[token][i] = n
    classes: dict[tuple, list[tuple]] = defaultdict(list)
    for token, vector in counts.items():
        classes[tuple(vector)].append(token)
    return classes


def skeleton(pages: list[Page], classes: dict[tuple, list[tuple]]) -> list[tuple]:
    """Tokens of the classes that ``SHARE`` of the pages hold once and none more often, in the
    order that all pages agree on."""
    once = {t for vector, tokens in classes.items() if max(vector) == 1 and sum(vector) >= SHARE * len(pages) for t in tokens}
    at = [{t: i for i, t in enumerate(p.tokens) if t in once} for p in pages]
    mean = {t: sum(a[t] / len(p.tokens) for a, p in zip(at, pages) if t in a) / sum(t in a for a in at) for t in once}
    out: list[tuple] = []
    for token in sorted(once, key=lambda t: (max(at, key=lambda a: t in a).get(t, 0), mean[t])):
        if all(a[out[-1]] < a[token] for a in at if out and token in a and out[-1] in a):
            out.append(token)
    return out


def nested(pages: list[Page], classes: dict[tuple, list[tuple]], root: list[tuple]) -> set[tuple]:
    """Tokens of the classes that recur on half the pages and lie in one gap of the skeleton."""
    gaps: dict[tuple, set[int]] = defaultdict(set)
    in_root = set(root)
    for page in pages:
        places = sorted(i for i, t in enumerate(page.tokens) if t in in_root)
        for i, token in enumerate(page.tokens):
            gaps[token].add(bisect_right(places, i))
    found = set()
    for vector, tokens in classes.items():
        if 2 * sum(n > 0 for n in vector) >= len(pages) and not in_root.issuperset(tokens):
            if len({g for t in tokens for g in gaps[t]}) == 1:
                found.update(tokens)
    return found


@dataclass
class Template:
    """A host's skeleton, the path of its main element, texts there that belong to the template,
    and whether variation between pages stands behind it."""

    paths: Paths
    root: list[tuple]
    main: int
    fixed: set[tuple]
    known: bool

    def dump(self) -> bytes:
        """With the paths that the template names and those above them, numbered anew."""
        need = {self.main, *(p for p, _ in self.root), *(p for p, _ in self.fixed)}
        for p in sorted(need, reverse=True):
            while (p := self.paths.parent(p)) and p not in need:
                need.add(p)
        new = {p: i for i, p in enumerate(sorted(need | {0}))}
        keys = [(new[self.paths.parent(p)], self.paths.label(p)) for p in sorted(need - {0})]
        named = lambda tokens: [(new[p], t) for p, t in tokens]
        return zstandard.ZstdCompressor(9).compress(json.dumps([keys, named(self.root), new[self.main], sorted(named(self.fixed)), self.known]).encode())

    @staticmethod
    def load(data: bytes) -> "Template":
        keys, root, main, fixed, known = json.loads(zstandard.ZstdDecompressor().decompress(data))
        paths = Paths()
        for parent, label in keys:
            paths.child(parent, label)
        return Template(paths, [tuple(t) for t in root], main, {tuple(t) for t in fixed}, known)


def deduce(pages: list[Page], labels: bool = True) -> Template:
    """The template of some pages of one host, parsed with the same paths. ``labels`` off: tag and class names say nothing."""
    sample = list({tuple(p.tokens): p for p in pages if p.texts}.values())
    known = len(sample) >= LEAST
    if not sample:
        return Template(Paths(), [], 0, set(), False)
    paths = sample[0].paths
    classes = equivalence_classes(sample)
    root = skeleton(sample, classes)
    fixed = {t for t in [*root, *nested(sample, classes, root)] if not t[1].startswith(("<", "/"))} if known else set()
    tags, slots = set(root), defaultdict(list)
    for n, page in enumerate(sample):
        at = [(i, t) for i, t in enumerate(page.tokens) if t in tags]
        places = [i for i, _ in at]
        for x in page.texts:
            k = bisect_right(places, x.place)
            slots[at[k - 1][1] if k else ()].append((n, x))
    content: list[Text] = []
    for found in slots.values():
        size, linked = sum(len(x.text) for _, x in found), sum(len(x.text) for _, x in found if x.link)
        varied = len({x.token for _, x in found}) > 0.5 * len(found)
        if 2 * linked <= size and size >= LONG * len({n for n, _ in found}) and (varied or not known):
            content += [x for _, x in found]
    free = lambda x: not labels or not x.boiler
    content = [x for x in content if free(x)] or [x for p in sample for x in p.texts if not x.link and free(x)]
    if labels and not known and any(x.main for x in content):
        content = [x for x in content if x.main]
    # the deepest element of the skeleton around most of the content
    direct: Counter = Counter()
    for x in content:
        direct[x.token[0]] += len(x.text)
    held = paths.summed(direct)
    total = held.get(0, 0)
    elements = {paths.known(p, t[1:]) for p, t in root if t.startswith("<") and t[1:].partition(".")[0] not in _leaves}
    main = max((m for m in elements if total and held.get(m, 0) >= MOST * total), key=lambda m: (paths.depth(m) if m else 0, held.get(m, 0), m), default=0)
    # its parents as well, while what they add is varied text outside links; texts of different
    # paths are different tokens, so that counts of distinct ones add up
    texts = [x for p in sample for x in p.texts if free(x)]
    there = paths.summed(Counter(x.token[0] for x in texts))
    fresh = paths.summed(Counter(p for p, _ in {x.token for x in texts if not x.link and x.token not in fixed}))
    while main:
        up = paths.parent(main)
        more = there.get(up, 0) - there.get(main, 0)
        good = 2 * (fresh.get(up, 0) - fresh.get(main, 0)) > more
        if more and (not good or not known or paths.depth(up) < 2):
            break
        if not up:
            break
        main = up
    # inside the main element pages may share paragraphs; what all of many pages hold is a notice
    notices = {t for t in root if t in fixed} if len(sample) >= 2 * LEAST else set()
    return Template(paths, root, main, notices, known)


def read(page: Page, template: Template, labels: bool = True, alone: bool = True) -> str:
    """Main text of a page by its host's template: what stands in the main element, without the
    texts that pages repeat, unless they are most of it. Names decide only what no comparison of
    pages can tell: comments, forms, notices and the like inside the main element. A page that
    holds nothing there is of another layout and read by itself."""
    below = page.paths.below(template.main)
    inside = [x for x in page.texts if below(x.token[0]) and not (labels and x.boiler)]
    if labels and not template.known and any(x.main for x in inside):
        inside = [x for x in inside if x.main]
    if not inside and page.texts and alone:
        return read(page, deduce([page], labels), labels, False)
    own = sum(len(x.text) for x in inside if x.token not in template.fixed)
    copied = 2 * own < sum(len(x.text) for x in inside)
    blocks: list[tuple[int, list[Text]]] = []
    for x in inside:
        if not blocks or blocks[-1][0] != x.block:
            blocks.append((x.block, []))
        blocks[-1][1].append(x)
    # a block goes if all of it is the template's
    lines = (" ".join("".join(x.text for x in parts).split()) for _, parts in blocks if copied or any(x.token not in template.fixed for x in parts))
    return "\n".join(x for x in lines if x)


def extract(sources: list[str | None], labels: bool = True) -> list[str]:
    """Main texts of some pages of one host by their own template."""
    paths = Paths()
    pages = [parse(s, paths) for s in sources]
    template = deduce(pages, labels)
    return [read(p, template, labels) for p in pages]


_hashes: dict[tuple[int, str], int] = {}


def named(path: int, text: str) -> int:
    """64 bits of a token or of a path below another, the same in every task."""
    return int.from_bytes(blake2b(text.encode(errors="surrogatepass"), digest_size=8, key=path.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _tag(path: int, label: str) -> int:
    """``named`` for the few names of tags, kept."""
    found = _hashes.get((path, label))
    if found is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        found = _hashes[path, label] = named(path, label)
    return found


_marks: dict[tuple[int, str], tuple] = {}


def _mark(path: int, text: str) -> tuple:
    """Of a tag's token below a path: its name, and what ``_TOKENS`` has of its element; kept."""
    found = _marks.get((path, text))
    if found is None:
        if len(_marks) > 100_000:
            _marks.clear()
        if text[0] == "<":
            found = _tag(path, text), _tag(path, text[1:]), path, _LEAF if text[1:].partition(".")[0] in _leaves else _OPEN
        else:
            found = _tag(path, text), 0, 0, _CLOSE
        _marks[path, text] = found
    return found


def path_names(paths: Paths) -> list[int]:
    """The 64 bits of each path by its number; 0 stays 0."""
    out = [0]
    for parent, label in paths.keys:
        out.append(_tag(out[parent], label))
    return out


#: A different token of a page: name, occurrences, first and last place, and of an opening tag the element's
#: path, the path around it and whether it holds running text.
_TOKENS = pa.struct([("t", pa.int64()), ("c", pa.int32()), ("a", pa.int32()), ("z", pa.int32()), ("e", pa.int64()), ("up", pa.int64()), ("kind", pa.int32())])
#: A text: token, place, length, path, and boilerplate, main and link as bits.
_TEXTS = pa.struct([("t", pa.int64()), ("a", pa.int32()), ("size", pa.int32()), ("path", pa.int64()), ("flags", pa.int32())])
_PATHS = pa.struct([("path", pa.int64()), ("up", pa.int64())])
_TEXT, _OPEN, _LEAF, _CLOSE = range(4)


def summary(page: Page) -> tuple[int, list[tuple], list[tuple], list[tuple]]:
    """A digest of a page's tokens, and what of it the template is deduced from."""
    path_of = path_names(page.paths)
    texts = {x.place: named(path_of[x.token[0]], "=" + x.token[1]) for x in page.texts}
    found: dict[int, list] = {}
    names = []
    for i, (path, text) in enumerate(page.tokens):
        # a text may begin with < or / too
        name, *more = (texts[i], 0, 0, _TEXT) if i in texts else _mark(path_of[path], text)
        names.append(name)
        if name in found:
            found[name][1] += 1
            found[name][3] = i
        else:
            found[name] = [name, 1, i, i, *more]
    digest = blake2b(np.array(names, "<i8").tobytes(), digest_size=8)
    texts = [(texts[x.place], x.place, len(x.text), path_of[x.token[0]], x.boiler + 2 * x.main + 4 * x.link) for x in page.texts]
    ups = [(path_of[i + 1], path_of[parent]) for i, (parent, _) in enumerate(page.paths.keys)]
    return int.from_bytes(digest.digest(), "little", signed=True), [tuple(x) for x in found.values()], texts, ups


def _nested(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of tuples as an Arrow column of lists of structs."""
    flat = [x for r in rows for x in r]
    columns = list(zip(*flat)) or [()] * kind.num_fields
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, kind.field(i).type) for i, c in enumerate(columns)], fields=list(kind)))


def _unnested(column: pa.Array) -> list[list[tuple]]:
    """The other way round."""
    flat = list(zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in column.flatten().flatten())))
    upto = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
    return [flat[a:b] for a, b in zip(upto[:-1], upto[1:])]


def _summaries(rows: DataFrame) -> DataFrame:
    """(h, digest, tokens, texts, paths) of the different pages of each host that hold text."""
    names = ["h", "digest", "tokens", "texts", "paths"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = [(h, *summary(page)) for h, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if (page := parse(x)).texts]
                h, digest, tokens, texts, paths = ([m[i] for m in made] for i in range(5))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(digest, pa.int64()), _nested(tokens, _TOKENS), _nested(texts, _TEXTS), _nested(paths, _PATHS)], names=names)

    kinds = "h long, digest long, tokens array<struct<t:long,c:int,a:int,z:int,e:long,up:long,kind:int>>, texts array<struct<t:long,a:int,size:int,path:long,flags:int>>, paths array<struct<path:long,up:long>>"
    pages = cut(rows.where("html is not null").select("h", "html").mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id()), "page-summaries")
    again = pages.groupBy("h", "digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return pages.join(again, ["h", "digest"], "left").where("first is null or first = row").drop("first", "row")


def _by_host(pages: DataFrame, plans: DataFrame, column: str, kind: str, f: Callable) -> DataFrame:
    """Rows that ``f(plan, pages)`` adds up in a task; it gets the pages of a batch host by host, and rows
    of equal keys come as often as batches hold their host."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                of: dict[int, tuple[bytes, list]] = {}
                for h, plan, *page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _unnested(part.column(2)), _unnested(part.column(3)), _unnested(part.column(4))):
                    of.setdefault(h, (plan, []))[1].append(page)
                made = [(h, *row) for h, (plan, some) in of.items() for row in f(json.loads(plan), some)]
                columns = list(zip(*made)) or [()] * len(kind.split(","))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in kind.split(", ")])

    return pages.join(plans.select("h", column), "h").select("h", column, "tokens", "texts", "paths").mapInArrow(run, kind)


def _turned(order: list[int], pages: list) -> set[tuple[int, int]]:
    """Pairs of the order's places whose tokens some page holds the other way round."""
    at = {t: i for i, t in enumerate(order)}
    found: set[tuple[int, int]] = set()
    for tokens, _, _ in pages:
        seen = [at[x[0]] for x in sorted((x for x in tokens if x[0] in at), key=lambda x: x[2])]
        if seen != sorted(seen):
            places = np.array(seen)
            i, j = np.nonzero(np.triu(places[:, None] > places[None, :], 1))
            found.update(zip(places[j].tolist(), places[i].tolist()))
    return found


def _filled(plan: dict, pages: list) -> list[tuple]:
    """What stands in the slots, by (what, slot, path, flags, token): texts, length and pages of the slot that
    they are the first of; and of the recurring tokens the lowest and highest gap."""
    root, known = {t: i for i, t in enumerate(plan["root"])}, set(plan["recurring"])
    ups = {0, *map(int, plan["ups"])}
    gaps: dict[int, tuple[int, int]] = {}
    out: dict[tuple, list[int]] = {}
    for tokens, texts, paths in pages:
        at = sorted((x[2], root[x[0]]) for x in tokens if x[0] in root)
        places = [a for a, _ in at]
        for t, _, a, z, *_ in tokens:
            if t in known:
                low, high = gaps.get(t, (2**31, -1))
                gaps[t] = min(low, bisect_right(places, a)), max(high, bisect_right(places, z))
        above, begun = dict(paths), set()
        for t, a, size, path, flags in texts:
            while path not in ups:
                path = above[path]
            k = bisect_right(places, a)
            slot = at[k - 1][1] if k else -1
            now = out.setdefault((0, slot, path, flags, t), [0, 0, 0])
            now[0] += 1
            now[1] += size
            now[2] += slot not in begun
            begun.add(slot)
    return [(*k, *v) for k, v in out.items()] + [(1, 0, 0, 0, t, *g, 0) for t, g in gaps.items()]


def _main(plan: dict, rows: list[tuple]) -> tuple[int, list[int], bool]:
    """The path of a host's main element, the texts that are notices, and whether variation stands behind them, as ``deduce``
    finds them: from rows (what, slot, path, flags, token or 0, texts, length, pages, different texts)."""
    known, ups = plan["pages"] >= LEAST, {int(k): v for k, v in plan["ups"].items()}
    groups: dict[int, list[int]] = defaultdict(list)
    for t, g in zip(plan["recurring"], plan["classes"]):
        groups[g].append(t)
    gaps = {r[4]: (r[5], r[6]) for r in rows if r[0] == 1}
    inside = {t for tokens in groups.values() if len({g for t in tokens for g in gaps[t]}) == 1 for t in tokens}
    texts = set(plan["texts"])
    fixed = {t for t in [*plan["root"], *inside] if t in texts} if known else set()
    rows = [r for r in rows if r[0] == 0]
    slots: dict[int, list] = defaultdict(list)
    for r in rows:
        slots[r[1]].append(r)
    content = []
    for some in slots.values():
        size, linked = sum(r[6] for r in some), sum(r[6] for r in some if r[3] & 4)
        varied = sum(r[8] for r in some) > 0.5 * sum(r[5] for r in some)
        if 2 * linked <= size and size >= LONG * sum(r[7] for r in some) and (varied or not known):
            content += some
    free = [r for r in rows if not r[3] & 1]
    content = [r for r in content if not r[3] & 1] or [r for r in free if not r[3] & 4]
    if not known and any(r[3] & 2 for r in content):
        content = [r for r in content if r[3] & 2]

    depth = {0: 0}
    for path in ups:
        way = []
        while path not in depth:
            way.append(path)
            path = ups[path]
        for p in reversed(way):
            depth[p] = depth[ups[p]] + 1
    upwards = sorted(ups, key=lambda p: -depth[p])

    def summed(sizes: list[tuple[int, int]]) -> Counter:
        out: Counter = Counter()
        for p, n in sizes:
            out[p] += n
        for p in upwards:
            out[ups[p]] += out[p]
        return out

    held, there = summed([(r[2], r[6]) for r in content]), summed([(r[2], r[5]) for r in free])
    fresh = summed([(r[2], r[8]) for r in free if not r[3] & 4 and r[4] not in fixed])
    total = held[0]
    main = max((m for m in plan["elements"] if total and held[m] >= MOST * total), key=lambda m: (depth[m], held[m], m), default=0)
    while main:
        up = ups[main]
        more = there[up] - there[main]
        good = 2 * (fresh[up] - fresh[main]) > more
        if more and (not good or not known or depth[up] < 2) or not up:
            break
        main = up
    return main, sorted(t for t in plan["root"] if t in fixed) if plan["pages"] >= 2 * LEAST else [], known


def _on(page: Page, made: tuple[int, set[int], bool]) -> Template:
    """A host's template in the numbers of a page; no path of the page is the main element where it has none."""
    main, fixed, known = made
    path_of = path_names(page.paths)
    notices = {x.token for x in page.texts if named(path_of[x.token[0]], "=" + x.token[1]) in fixed} if fixed else set()
    return Template(page.paths, [], path_of.index(main) if main in path_of else -1, notices, known)


def host_templates(rows: DataFrame) -> DataFrame:
    """(h, template) of pages (h, html): the template of each host from all its different pages.

    Each page is parsed once into names of its tokens, texts and paths. What all pages say is added up by Spark: in how many a token
    occurs and a fingerprint of its occurrence vector, which pairs of the skeleton some page turns round, what stands in each slot.
    A group of one host holds only tokens that half its pages have, and sums by slot and element.
    """
    pages = cut(_summaries(rows), "different-pages")
    sizes = pages.groupBy("h").agg(F.count(F.lit(1)).alias("pages"))
    place = F.floor(F.col("x.a").cast("long") * 2**20 / F.col("size")).alias("place")
    tokens = pages.select("h", "digest", F.size("tokens").alias("size"), F.explode("tokens").alias("x")).select("h", "digest", place, "x.*")
    tokens = tokens.groupBy("h", "t").agg(
        F.count(F.lit(1)).alias("n"), F.max("c").alias("most"), F.bit_xor(F.xxhash64("digest", "c")).alias("vector"), F.min_by("a", "digest").alias("first"),
        F.sum("place").alias("place"), F.max("e").alias("e"), F.max("up").alias("up"), F.max("kind").alias("kind"),
    )
    often = cut(tokens.join(sizes, "h").where("2 * n >= pages"), "host-tokens")

    def order_of(rows: list[dict]) -> list[int]:
        # by the place on the first page, by its digest, that holds them
        once = sorted((r for r in rows if r["most"] == 1 and r["n"] >= SHARE * r["pages"]), key=lambda r: (r["first"], r["place"] / r["n"], r["t"]))
        return [r["t"] for r in once]

    def ordered(group: pa.Table) -> pa.Table:
        return pa.table({"h": group.column("h")[:1], "skeleton": [json.dumps(order_of(group.to_pylist())).encode()]})

    skeletons = cut(often.groupBy("h").applyInArrow(ordered, "h long, skeleton binary"), "host-skeletons")
    turned = _by_host(pages, skeletons, "skeleton", "h long, i long, j long", _turned).distinct()

    def planned(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, wrong = left.to_pylist(), set(zip(right.column("i").to_pylist(), right.column("j").to_pylist()))
        order, root = order_of(rows), []
        for i in range(len(order)):
            if not root or (root[-1], i) not in wrong:
                root.append(i)
        root = [order[i] for i in root]
        of = {r["t"]: r for r in rows}
        vectors: dict[tuple, int] = {}
        # a class whose every token belongs to the skeleton isn't nested anywhere
        classes = {r["t"]: vectors.setdefault((r["n"], r["vector"]), len(vectors)) for r in rows}
        outside = {classes[t] for t in of.keys() - set(root)}
        recurring = sorted(t for t in of if classes[t] in outside)
        plan = {
            "root": root, "recurring": recurring, "classes": [classes[t] for t in recurring], "ups": {r["e"]: r["up"] for r in rows if r["kind"] in (_OPEN, _LEAF)},
            "texts": sorted(t for t, r in of.items() if r["kind"] == _TEXT), "elements": sorted(of[t]["e"] for t in root if of[t]["kind"] == _OPEN), "pages": rows[0]["pages"],
        }
        return pa.table({"h": [rows[0]["h"]], "plan": [json.dumps(plan).encode()]})

    plans = cut(often.groupBy("h").cogroup(turned.groupBy("h")).applyInArrow(planned, "h long, plan binary"), "host-plans")
    kind = "h long, what long, slot long, path long, flags long, t long, texts long, size long, pages long"
    found = _by_host(pages, plans, "plan", kind, _filled)
    key = ["h", "what", "slot", "path", "flags"]
    # sums of what stands in slots, bounds of what says in which gaps a token lies, from one pass over the pages
    slot = F.col("what") == 0
    sums = found.groupBy(*key, "t").agg(F.min("texts").alias("low"), F.max("size").alias("high"), *[F.sum(c).alias(c) for c in ("texts", "size", "pages")])
    sums = sums.withColumns({"texts": F.when(slot, F.col("texts")).otherwise(F.col("low")), "size": F.when(slot, F.col("size")).otherwise(F.col("high"))})
    sums = sums.join(often.select("h", "t", F.lit(True).alias("often")), ["h", "t"], "left").withColumn("t", F.when(~slot | F.col("often"), F.col("t")).otherwise(0))
    sums = sums.groupBy(*key, "t").agg(*[F.sum(c).alias(c) for c in ("texts", "size", "pages")], F.count(F.lit(1)).alias("kinds"))

    def template(group: pa.Table, plans: pa.Table) -> pa.Table:
        plan = json.loads(plans.column("plan")[0].as_py())
        made = _main(plan, list(zip(*(group.column(c).to_pylist() for c in ("what", "slot", "path", "flags", "t", "texts", "size", "pages", "kinds")))))
        return pa.table({"h": plans.column("h")[:1], "template": pa.array([json.dumps(made).encode()], pa.binary())})

    return cut(sums.groupBy("h").cogroup(plans.groupBy("h")).applyInArrow(template, "h long, template binary"), "host-templates")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    The template of a host comes from all its different pages (``host_templates``), some KB a
    host, and is joined back on the host, in a join that Spark broadcasts where they are few and
    splits where a host is hot. A host of under ``LEAST`` different pages has no template: its pages are
    read by ``<article>``, ``<main>`` and names alone, or as a whole where they have none of them; notices that
    pages repeat inside the main element are told from ``2 * LEAST`` pages on. Null or empty html: an empty text. Null urls share one host.
    Repeated rows give a row each; null ids stay. Extra columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html"), F.xxhash64(host).alias("h"))
    kind = rows.schema["page_id"].dataType.simpleString()
    joined = rows.join(host_templates(rows), "h", "left").select("page_id", "url", "html", "template")
    kept: dict[bytes | None, tuple[int, set[int], bool]] = {}

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = []
                for source, data in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if data not in kept:
                        if len(kept) > 200:
                            kept.clear()
                        main, fixed, known = json.loads(data) if data else (0, [], False)
                        kept[data] = main, set(fixed), known
                    page = parse(source)
                    made.append(read(page, _on(page, kept[data])))
                lens = pa.array([len(x) for x in made], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string()), lens], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
