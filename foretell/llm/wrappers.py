"""HTML main text by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and text slots. Streams of one host are aligned one
after the other with the host's wrapper so far; a mismatch becomes an optional
group, a run of equal parts becomes a repeated group, and differing texts
become slots named by the elements around them. The amount of text in each slot
tells which slots are the article. Every page is then matched against its
wrapper, and a slot's texts that nearly all pages share at that place of the
wrapper are the template's and left out of the article.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from hashlib import blake2b
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foretell.llm.common import checkpointed, slices

#: Alignments of one host are dealt to so many tasks, whose wrappers are then aligned with each other.
SALTS = 16
#: A text at one place of a wrapper in this share of at least so many pages that have the place is the template's, not the article's.
FIXED_SHARE, MIN_PAGES = 0.9, 5
#: The longest part that is looked for as a repeated group, in items of the stream.
MAX_GROUP = 8
#: Wrappers of this many bytes in all are sent to every task; beyond it pages and wrappers are joined by host.
BROADCAST_BYTES = 8 << 20

# Fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg select object canvas".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that say how a page is built; the path of a text is followed through these only where there is no main element.
CONTAINERS = set("html body div section center table tbody tr td form".split())
#: and so many of them.
TEMPLATE_DEPTH = 4
#: Elements that an opening tag closes if they are the innermost of their kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}} | {b: {"p"} for b in BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "body", "html", "head", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}}
BOILERPLATE_TAGS = set("head nav header footer aside form button dialog menu label fieldset".split())
BOILERPLATE_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr header login masthead menu message modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promotion recommended related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe taboola toolbar warning widget widgets".split()
)
#: Words that say nothing of their own in a class name: a name of these and boilerplate words only ("site-header", "comment-list") is boilerplate.
NEUTRAL_WORDS = set("area bar block body bottom box btn button buttons col column container content form global group icon icons inner item items left link links list main middle outer page panel primary region right row secondary section site slot text title top unit wrap wrapper".split())
#: Elements whose ids are often made from their text, so that an id says nothing of them.
TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 p li dt dd td th caption figcaption legend summary".split())
#: Elements deeper than this are not named in paths, so that a path is of bounded length; their texts belong to the element above.
MAX_DEPTH = 200
#: Share of a host's text, or of a template's, from which a marked element encloses the article rather than boilerplate.
MOST = 0.6
MAIN_TAGS, MAIN_WORDS = {"article", "main"}, {"article", "content", "entry", "main", "post", "story"}

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>"[^"]*+"|'[^']*+'|[^'">])*+)>|[^<]++|<""", re.DOTALL)
_attribute = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_quoted = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_words = re.compile(r"[a-z]+")
_space = re.compile(r"\s+")


def _is_boilerplate(name: str) -> bool:
    """Whether a whole class name, id or role names boilerplate: a listed word, with others only if they are listed or neutral."""
    words = _words.findall(name)
    return any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in NEUTRAL_WORDS for w in words)


def _label(name: str, attributes: str) -> tuple[str, str]:
    """An element's name with its first class word, and its mark as boilerplate by itself.

    "!" is for elements that are boilerplate wherever they stand, "~" for forms
    and names, which count unless the element encloses the article.
    """
    firm = name in BOILERPLATE_TAGS and name != "form"
    if not attributes or attributes.isspace():
        return name, "!" if firm else "~" if name == "form" else ""
    values = [(m[2] or m[3] or m[4] or "").lower() for m in _attribute.finditer(attributes) if name not in TEXT_TAGS or m[1].lower() != "id"]
    words = [w for v in values for w in _words.findall(v)]
    hidden = re.search(r"\shidden(?=[\s=/]|$)", " " + _quoted.sub("", attributes), re.IGNORECASE) is not None or re.search(r"display\s*:\s*none", attributes, re.IGNORECASE) is not None
    named = name not in ("html", "body") and any(_is_boilerplate(c) for v in values for c in v.split())
    return (f"{name}.{words[0]}" if words else name), "!" if firm or hidden else "~" if named or name == "form" else ""


def stream(page: str | None) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, value)`` of a page: "open" and "close" of block elements, and "text" with its slot's name.

    A slot's name is the path of elements around the text; "!" and "~" mark the
    elements that are boilerplate by themselves. Comments, declarations and the
    contents of raw elements are left out; references are not yet decoded.
    """
    page = page or ""
    stack: list[tuple[str, str]] = []  # names, and paths from the root
    at, end = 0, len(page)
    while at < end:
        m = _token.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                yield "text", stack[-1][1] if stack else "", m[0]
            continue
        name = name.lower()
        if m[1]:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                if name in BLOCKS:
                    yield "close", name, ""
            elif name == "p":
                yield "close", "p", ""
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
            continue
        label, off = _label(name, m[3])
        if name in VOID:
            yield ("open" if name == "hr" else "void"), label, ""
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(name, ()):
                del stack[k:]
                break
            if stack[k][0] in BLOCKS and stack[k][0] != "p":
                break
        if name in BLOCKS or off:
            above = stack[-1][1] if stack else ""
            stack.append((name, above if len(stack) >= MAX_DEPTH else f"{above}>{label}{off}" if stack else label + off))
        if name in BLOCKS:
            yield "open", label, ""


def _squash(items: list[str]) -> None:
    """If the stream ends in two equal parts, or in a repeated group and its body, make that one repeated group."""
    n = len(items)
    for k in range(1, min(MAX_GROUP, n - 1) + 1):
        tail = items[n - k :]
        group = "( " + " ".join(tail) + " )+"
        if items[n - k - 1] == group:
            del items[n - k :]
            return
        if n >= 2 * k and items[n - 2 * k : n - k] == tail:
            items[n - 2 * k :] = [tail[0] if k == 1 and tail[0].endswith(" )+") else group]
            return


def shape(page: str | None) -> tuple[list[str], Counter]:
    """A page's stream with runs of equal parts as repeated groups, and the code points in each slot."""
    items: list[str] = []
    mass: Counter = Counter()
    for kind, name, value in stream(page):
        if kind == "text":
            n = len(value) if len(value) > 1 or not value.isspace() else 0
            if value.isspace():
                continue
            mass[name] += n
            item = "#" + name
            if items and items[-1] == item:  # texts split by inline elements are one slot
                continue
        elif kind == "void":
            continue
        else:
            item = f"<{name}>" if kind == "open" else f"</{name}>"
        items.append(item)
        _squash(items)
    return items, mass


def _optional(items: list[str]) -> list[str]:
    return ["( " + " ".join(items) + " )?"] if items else []


def _body(item: str) -> list[str]:
    """The items inside a group."""
    inner, out, depth, start = item[2 : item.rindex(")")].split(" "), [], 0, 0
    for i, word in enumerate(inner):
        if word == "":
            start = i + 1 if depth == 0 else start
            continue
        depth += (word == "(") - (word in (")+", ")?"))
        if depth == 0:
            out.append(" ".join(inner[start : i + 1]))
            start = i + 1
    return out


def _core(item: str) -> str:
    """What two items must share to be aligned: a group stands for its first inner item, whatever its mark."""
    while item.startswith("( "):
        item = _body(item)[0]
    return item


def align(wrapper: list[str], page: list[str]) -> list[str]:
    """The union-free expression for both: common items stay, the rest becomes optional, repeated on either side is repeated."""
    if wrapper == page:
        return wrapper
    out: list[str] = []
    a, b = [_core(x) for x in wrapper], [_core(x) for x in page]
    i = j = 0
    for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        out += _mismatch(wrapper[i : m.a]) + _mismatch(page[j : m.b])
        for x, y in zip(wrapper[m.a : m.a + m.size], page[m.b : m.b + m.size]):
            out.append(x if x == y else _unify(x, y))
            if len(out) > 1 and out[-1] == out[-2] and out[-1].endswith((")+", ")?")):
                out.pop()
        i, j = m.a + m.size, m.b + m.size
    return out


def _mismatch(items: list[str]) -> list[str]:
    if len(items) == 1 and items[0].endswith(")?"):
        return items
    return _optional(items)


def _unify(x: str, y: str) -> str:
    """One group for two items with one core."""
    marks = {z[-1] if z.startswith("( ") else "" for z in (x, y)}
    bodies = [_body(z) if z.startswith("( ") else [z] for z in (x, y)]
    body = align(*bodies)
    mark = ")*" if marks >= {"+", "?"} else ")+" if "+" in marks else ")?" if "?" in marks else ""
    if mark == ")*":  # repeated or absent: an optional repeated group
        return "( ( " + " ".join(body) + " )+ )?"
    return "( " + " ".join(body) + " " + mark if mark else " ".join(body)


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(host, template, salt, shape, n)`` sorted by group, the commonest shape first: one wrapper for each group, held alone in memory."""
    key, wrapper, pages, rows = None, [], 0, []
    for batch in batches:
        for *group, text, n in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "salt", "shape", "n"))):
            items = _body(f"( {text} )")
            if group != key:
                if key is not None:
                    rows.append((*key, " ".join(wrapper), pages))
                key, wrapper, pages = group, items, n
            else:
                wrapper, pages = align(wrapper, items), pages + n
    if key is not None:
        rows.append((*key, " ".join(wrapper), pages))
    host, template, salt, text, n = zip(*rows) if rows else ((),) * 5
    columns = [pa.array(host, pa.string()), pa.array(template, pa.string()), pa.array(salt, pa.int32()), pa.array(text, pa.string()), pa.array(n, pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["host", "template", "salt", "shape", "n"])


def _is_main(label: str) -> bool:
    name, _, word = label.rstrip("!~").partition(".")
    return name in MAIN_TAGS or (name in ("div", "section", "td") and word in MAIN_WORDS)


def _is_main_tag(label: str) -> bool:
    return label.rstrip("!~").partition(".")[0] in MAIN_TAGS


def _path(slot: str) -> list[str]:
    return slot.split(">") if slot else []


def template_of(mass: dict[str, int]) -> str:
    """A name for the pages of a host that are built alike: where the main elements stand or, without one, which containers there are."""
    kinds = [[_path(s) for s in mass if "!" not in s and "~" not in s], [_path(s) for s in mass if "!" not in s]]
    for test in (_is_main_tag, _is_main):
        for paths in kinds:
            found = {">".join(p[: k + 1]) for p in paths for k in [next((i for i, x in enumerate(p) if test(x)), -1)] if k >= 0}
            if found:
                return " ".join(sorted(found))
    return " ".join(sorted({">".join(takewhile(lambda x: x.rstrip("!~").partition(".")[0] in CONTAINERS, p[:TEMPLATE_DEPTH])) for p in kinds[1]}))


def _shape_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of shapes and sums of slots by host and template, added up before they leave the task."""
    shapes: Counter = Counter()
    slots: Counter = Counter()

    def rows():
        keys = [(*key, "shape", s) for *key, s in shapes] + [(*key, "slot", s) for *key, s in slots]
        host, template, kind, value = zip(*keys) if keys else ((), (), (), ())
        columns = [pa.array(c, pa.string()) for c in (host, template, kind, value)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([*shapes.values(), *slots.values()], pa.int64())], ["host", "template", "kind", "value", "n"])

    for batch in batches:
        for part in slices(batch, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                items, mass = shape(page)
                template = template_of(mass)
                if items:
                    shapes[host, template, " ".join(items)] += 1
                for slot, n in mass.items():
                    slots[host, template, slot] += n
            if len(shapes) + len(slots) > 20000:
                yield rows()
                shapes.clear()
                slots.clear()
    yield rows()


def _enclosing(slots: dict[str, int], host: dict[str, int]) -> set[str]:
    """The paths of elements marked "~" that enclose the article: most of the host's text, or a main element with most of the template's."""
    lifted = set()
    for masses, inside in ((host, lambda rest: True), (slots, lambda rest: any(_is_main_tag(x) and "~" not in x for x in rest))):
        total, under = 0, Counter()
        for s, n in masses.items():
            if "!" in s:
                continue
            total += n
            path = _path(s)
            for k, x in enumerate(path):
                if x.endswith("~") and inside(path[k + 1 :]):
                    under[">".join(path[: k + 1])] += n
        lifted |= {p for p, n in under.items() if n >= MOST * total}
    return lifted


def article_slots(slots: dict[str, int], host: dict[str, int] | None = None) -> list[str]:
    """The slots of a template that hold the article: those in its main element, without what is boilerplate inside it.

    The main element is an article or main element, or one named like it; of
    several, those inside no other count. Without one it is found by going down
    from the root as long as one child holds most of the text. ``host`` has the
    slots of all templates of the host.
    """
    lifted = _enclosing(slots, slots if host is None else host)

    def is_open(s: str) -> bool:
        path = _path(s)
        return "!" not in s and all(">".join(path[: k + 1]) in lifted for k, x in enumerate(path) if x.endswith("~"))

    open_ = {s: n for s, n in slots.items() if is_open(s)}
    for test in (_is_main_tag, _is_main):
        inside = [s for s in open_ if any(test(x) for x in _path(s))]
        if inside:
            return sorted(inside)
    root: list[str] = []
    while open_:
        below: Counter = Counter()
        for s, n in open_.items():
            path = _path(s)
            if len(path) > len(root) and path[: len(root)] == root:
                below[path[len(root)]] += n
        total = sum(n for s, n in open_.items() if _path(s)[: len(root)] == root)
        if not below or below.most_common(1)[0][1] < 0.6 * total or below.most_common(1)[0][0].partition(".")[0] in ("p", "h1", "h2", "h3", "li"):
            break
        root.append(below.most_common(1)[0][0])
    return sorted(s for s in open_ if _path(s)[: len(root)] == root)


def _keep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each template of a host; a host's templates come together as sums by slot."""
    for batch in batches:
        rows = []
        for host, slots in zip(batch.column("host").to_pylist(), batch.column("slots").to_pylist()):
            templates: dict[str, dict[str, int]] = {}
            whole: Counter = Counter()
            for s in slots:
                templates.setdefault(s["template"], {})[s["value"]] = s["n"]
                whole[s["value"]] += s["n"]
            rows += [(host, name, article_slots(mine, whole)) for name, mine in templates.items()]
        host, template, keep = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(template, pa.string()), pa.array(keep, pa.list_(pa.string()))], ["host", "template", "keep"])


def host_of(url):
    """A URL's host in lower case; nothing for nulls and relative addresses."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, template, pages, wrapper, keep)`` for every template of every host of ``pages (url, html)``, from all its pages; ``keep`` names the article's slots.

    Equal shapes are counted first, so a template's pages come together only as
    its distinct shapes, in SALTS tasks that hold one wrapper at a time.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    counts = rows.mapInArrow(_shape_batches, "host string, template string, kind string, value string, n long").groupBy("host", "template", "kind", "value").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    key = ["host", "template"]
    shapes = counts.where("kind = 'shape'").select(*key, F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int").alias("salt"), F.col("value").alias("shape"), "n")
    kind = "host string, template string, salt int, shape string, n long"
    first = shapes.repartition(*key, "salt").sortWithinPartitions(*key, "salt", F.desc("n"), "shape").mapInArrow(_fold_batches, kind)
    whole = first.repartition(*key).sortWithinPartitions(*key, "salt").select(*key, F.lit(0).alias("salt"), "shape", "n").mapInArrow(_fold_batches, kind)
    slots = counts.where("kind = 'slot'").groupBy("host").agg(F.collect_list(F.struct("template", "value", "n")).alias("slots"))
    kept = slots.mapInArrow(_keep_batches, "host string, template string, keep array<string>")
    return whole.select(*key, F.col("n").alias("pages"), F.col("shape").alias("wrapper")).join(kept, key)


def masses(items: list[tuple[str, str, str]]) -> Counter:
    """The code points in each slot of a stream."""
    mass: Counter = Counter()
    for kind, name, value in items:
        if kind == "text" and not value.isspace():
            mass[name] += len(value) if len(value) > 1 else 1
    return mass


class Wrapper:
    """A wrapper read as places: its tags and slots in order, with the repeated groups around each."""

    def __init__(self, wrapper: str):
        self.names: list[str] = []
        open_: list[int] = []
        groups: list[tuple[int, int]] = []
        for word in wrapper.split(" "):
            if word == "(":
                open_.append(len(self.names))
            elif word in (")+", ")?"):
                start = open_.pop()
                if word == ")+":
                    groups.append((start, len(self.names)))
            elif word:
                self.names.append(word)
        #: By place the innermost repeated group and by group the next one around it; groups are listed from the inside.
        self.group, self.outer = [-1] * len(self.names), [-1] * len(groups)
        self.groups, self.at = groups, {}
        inside: list[int] = []
        begins: dict[int, list[int]] = {}
        for g, (start, end) in enumerate(groups):
            if end > start:
                begins.setdefault(start, []).append(g)
        for i, name in enumerate(self.names):
            while inside and groups[inside[-1]][1] <= i:
                inside.pop()
            for g in reversed(begins.get(i, ())):  # the outer ones are listed later
                self.outer[g] = inside[-1] if inside else -1
                inside.append(g)
            self.group[i] = inside[-1] if inside else -1
            self.at.setdefault(name, []).append(i)

    def next(self, place: int, name: str) -> int:
        """The place of the next item of a page after ``place``: onwards or from the start again in the groups around it, from the inside; -1 if there is none."""
        places = self.at.get(name)
        if places is None:
            return -1
        after = bisect_right(places, place)
        g = self.group[place] if place >= 0 else -1
        while g >= 0:
            start, end = self.groups[g]
            if after < len(places) and places[after] < end:
                return places[after]
            first = bisect_left(places, start)
            if first < len(places) and places[first] < end:
                return places[first]
            g = self.outer[g]
        return places[after] if after < len(places) else -1


def blocks(items: Iterable[tuple[str, str, str]], keep: set[str], wrapper: Wrapper | None = None) -> Iterator[tuple[int, str]]:
    """The texts of the kept slots by block, white space as single spaces, each with the wrapper's place that it matches.

    A text that the wrapper doesn't have after the last place has the nearest
    place of its slot before it, and -1 without one.
    """
    run: list[str] = []
    place = at = -1  # of the page's last item, of the block's first kept text
    before = ""
    for kind, name, value in [*items, ("close", "", "")]:
        if wrapper is not None and kind != "void":
            item = f"#{name}" if kind == "text" else f"<{name}>" if kind == "open" else f"</{name}>"
            if not (kind == "text" and (value.isspace() or item == before)):
                found = wrapper.next(place, item)
                if found < 0 and kind == "text" and item in wrapper.at:
                    found = wrapper.at[item][bisect_right(wrapper.at[item], place) - 1]
                place, before = found if found >= 0 else place, item
        if kind == "text":
            if name in keep:
                if at < 0 and wrapper is not None and not value.isspace() and wrapper.names[place] == f"#{name}":
                    at = place
                run.append(html.unescape(value))
        elif kind == "void":
            if name.partition(".")[0] == "br":
                run.append(" ")
        elif run:
            text = _space.sub(" ", "".join(run)).strip()
            if text:
                yield at, text
            run, at = [], -1


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(page: str | None, keep: set[str], wrapper: Wrapper | None = None, fixed: dict[int, set[int]] | None = None) -> str:
    """The page's blocks, joined by line ends, without the texts that are ``fixed`` at their place of the wrapper."""
    return _article(stream(page), keep, wrapper, fixed)


def _article(items: Iterable[tuple[str, str, str]], keep: set[str], wrapper: Wrapper | None, fixed: dict[int, set[int]] | None) -> str:
    if not fixed:
        return "\n".join(text for _, text in blocks(items, keep))
    return "\n".join(text for at, text in blocks(items, keep, wrapper) if at not in fixed or digest(text) not in fixed[at])


class Templates:
    """What is known of templates, by host and name: sent to every task if it is small, else joined to the pages by their template."""

    def __init__(self, known: DataFrame):
        self.columns = [c for c in known.columns if c not in ("host", "template")]
        texts = [c for c, kind in known.dtypes if kind in ("string", "array<string>")]
        size = known.agg(F.sum(sum((F.length(F.array_join(c, ">") if dict(known.dtypes)[c] == "array<string>" else F.col(c)) for c in texts), F.lit(0)))).first()[0] or 0
        self.known, self.sent = known, None
        if size <= BROADCAST_BYTES:
            table = {(r.host, r.template): tuple(r[c] for c in self.columns) for r in known.collect()}
            self.sent = known.sparkSession.sparkContext.broadcast(table)

    def map(self, rows: DataFrame, function, schema: str) -> DataFrame:
        """``function(batch, found)`` over ``rows (host, html, ...)``; found has for each row its stream and its template's columns, or None."""
        if self.sent is None:
            named = rows.mapInArrow(_template_batches, StructType([*rows.schema, StructField("template", StringType())]))
            rows = named.join(self.known, ["host", "template"], "left")
        sent, columns = self.sent, self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "html"):
                    streams = (list(stream(page)) for page in part.column("html").to_pylist())
                    if sent is not None:
                        found = ((items, sent.value.get((host, template_of(masses(items))))) for items, host in zip(streams, part.column("host").to_pylist()))
                    else:
                        found = ((items, values if values[0] is not None else None) for items, *values in zip(streams, *(part.column(c).to_pylist() for c in columns)))
                    yield from function(part, found)

        return rows.mapInArrow(run, schema)


def _template_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            names = [template_of(masses(list(stream(page)))) for page in part.column("html").to_pylist()]
            yield part.append_column("template", pa.array(names, pa.string()))


def _digest_batches(part: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
    """``(host, template, place, digest, n, chars)``: in how many pages a text stands at a place; without digest, how many have the place and their text."""
    counts: dict[tuple, list[int]] = {}
    read: dict[tuple, tuple[Wrapper, set[str]]] = {}
    for host, (items, values) in zip(part.column("host").to_pylist(), found):
        if values is None or values[1] < MIN_PAGES:
            continue
        key, _, wrapper, keep = values
        if key not in read:
            read[key] = Wrapper(wrapper), set(keep)
        seen: dict[tuple, int] = {}
        for at, text in blocks(items, read[key][1], read[key][0]):
            seen[key, at, None] = seen.get((key, at, None), 0) + len(text)
            if at >= 0:
                seen[key, at, digest(text)] = len(text)
        for what, chars in seen.items():
            count = counts.setdefault(what, [0, 0])
            count[0] += 1
            count[1] += chars
    key, place, text = zip(*counts) if counts else ((), (), ())
    n, chars = zip(*counts.values()) if counts else ((), ())
    columns = [pa.array(key, pa.int64()), pa.array(place, pa.int32()), pa.array(text, pa.int64()), pa.array(n, pa.int64()), pa.array(chars, pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["key", "place", "digest", "n", "chars"])


def fixed_texts(templates: Templates, rows: DataFrame) -> DataFrame:
    """``(key, fixed)``: the texts that belong to a template and not to an article, as digests by place of the wrapper.

    A text is fixed at a place that at least MIN_PAGES pages have if it stands
    there in FIXED_SHARE of them. Where fixed texts would be half of the
    template's text or more, its pages are copies of each other, and none is.
    """
    counts = templates.map(rows, _digest_batches, "key long, place int, digest long, n long, chars long")
    counts = checkpointed(counts.groupBy("key", "place", "digest").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).where(f"digest IS NULL OR n >= {MIN_PAGES * FIXED_SHARE}"))
    places = counts.where("digest IS NULL").select("key", "place", F.col("n").alias("having"))
    whole = counts.where("digest IS NULL").groupBy("key").agg(F.sum("chars").alias("whole"))
    texts = counts.where("digest IS NOT NULL").join(places, ["key", "place"]).where(f"having >= {MIN_PAGES} AND n >= {FIXED_SHARE} * having")
    lists = texts.groupBy("key").agg(F.sum("chars").alias("chars"), F.collect_list(F.struct("place", "digest")).alias("fixed"))
    return lists.join(whole, "key").where("2 * chars < whole").select("key", "fixed")


def _texts(part: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
    read: dict[int, tuple] = {}
    texts = []
    for items, values in found:
        if values is None:
            texts.append("")
            continue
        key, _, wrapper, keep, fixed = values
        if key not in read:
            by_place: dict[int, set[int]] = {}
            for f in fixed or ():
                by_place.setdefault(f["place"], set()).add(f["digest"])
            read[key] = set(keep), Wrapper(wrapper) if by_place else None, by_place
        texts.append(_article(items, *read[key]))
    yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages (page_id, url, html)``.

    text is the article by the wrapper of the page's host and template, empty
    where there is none and for null and empty pages. Pages without a host
    share wrappers by template. What stands at the same place of the wrapper in
    nearly all pages is the template's text and left out. Pages are read whole, cut-off and badly nested
    ones included. Repeated rows each get a row; other columns are not read.
    """
    known = checkpointed(infer_wrappers(pages).select("host", "template", F.xxhash64("host", "template").alias("key"), "pages", "wrapper", "keep"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    fixed = fixed_texts(Templates(known), rows)
    templates = Templates(checkpointed(known.join(fixed, "key", "left").select("host", "template", "key", "pages", "wrapper", "keep", "fixed")))
    return templates.map(rows, _texts, "page_id long, url string, text string")
