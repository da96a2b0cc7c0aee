"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a stream of text blocks, each with the path of elements it stands in, their classes and ids. Runs
that repeat become repeated groups; streams of the same host are aligned one after the other, and where they
mismatch, what only some pages have becomes an optional group. Each page is then matched against its host's wrapper:
text that a slot has on every page that has the slot is part of the template and goes, whatever varies is data. Of the data,
content is what stands in the host's main element and in nothing whose tag or names say that it holds menus, adverts, forms,
notices or comments.
"""

import html as _html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, join_groups, materialise, modest_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[/a-zA-Z][^<]*\Z|<[/a-zA-Z](?:[^<>]*>)|[^<]+|<",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_RAW = {
    t: re.compile(rf"</{t}\b[^>]*>", re.I)
    for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "template")
}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends without a closing tag of its own.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
#: Where such an end stops.
_STOPS = {"ul", "ol", "dl", "table", "select", "menu"}
_AWAY_TAGS = set(
    "head nav footer aside form menu dialog select button object canvas svg math audio video map search optgroup option legend fieldset".split()
)
#: Words of classes, ids and roles that say an element holds no content. They count where all of a name's parts are such
#: words or plain ones; the vaguer ones only if the element has no other names either.
_SURE = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup login sidebar nav navbar navigation breadcrumb breadcrumbs footer disqus comment comments replies popup modal pagination pager masthead complementary contentinfo".split()
)
_VAGUE = set(
    "notice notices notification alert overlay menu toolbar social share sharing related recommended recommendations reply respond response responses widget widgets skip banner search dialog header".split()
)
_PLAIN = set(
    "box boxes container wrapper wrap list lists item items bar section block area inner outer body links link post posts article articles story stories button buttons icon icons panel group row col grid top bottom left right main page site global primary secondary form title heading count thread more read also next prev small large sticky fixed hidden mobile desktop js user reader visitor".split()
)
_HEAD_WORDS = {"header", "masthead", "banner"}


def _parts(name: str) -> list[str]:
    return [p for p in re.split(r"[_-]+|[0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if p]


def _says_away(names: list[str], in_main: bool) -> bool:
    """Whether an element's names say that it holds no content: "share-buttons" and "comments" do, "share price" and
    "comment-on-policy" don't."""
    sure, vague = (_SURE - _HEAD_WORDS, _VAGUE - _HEAD_WORDS) if in_main else (_SURE | _HEAD_WORDS, _VAGUE)
    cut = [_parts(n) for n in names]
    closed = [all(p in _SURE or p in _VAGUE or p in _PLAIN for p in parts) for parts in cut]
    if any(ok and not sure.isdisjoint(parts) for ok, parts in zip(closed, cut, strict=True)):
        return True
    return bool(cut) and all(closed) and any(not vague.isdisjoint(parts) for parts in cut)


def _label(name: str, tag: str, in_main: bool) -> str:
    """An element as a path shows it: its name, and "!" if nothing in it is content."""
    away = name in _AWAY_TAGS or (name == "header" and not in_main)
    if not away and name not in ("html", "body", "article", "main"):
        names = [n for m in _ATTR.finditer(tag) for n in (m[2] or m[3] or m[4] or "").split()]
        away = _says_away(names, in_main)
    return f"{name}!" if away else name


def _mark(name: str, tag: str) -> str:
    """An element as wrappers tell it apart: its name, classes and id, with numbers in them alike."""
    found = {
        m[1].lower(): sorted((m[2] or m[3] or m[4] or "").split()) for m in _ATTR.finditer(tag)
    } if " " in tag or "\n" in tag or "\t" in tag else {}
    return re.sub(
        r"[0-9]+", "0", ".".join([name, *found.get("class", [])]) + "".join("#" + x for x in found.get("id", [])),
    ).replace("/", "|") if found else name


def _marked(path: str, token: str) -> str:
    """A block's token, with the path's "!"."""
    return "/".join(m + "!" * x.endswith("!") for x, m in zip(path.split("/"), token.split("/"), strict=True))


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(path, text) of each block with text, in page order. Tags need not match: a closing tag ends what is open
    within its element, and is ignored if there is none; a tag cut off by the end of the page is dropped."""
    return [(path, t) for path, _, t in marked_blocks(page)]


def marked_blocks(page: str | None) -> list[tuple[str, str, str]]:
    """(path, token, text) of each block: the token is the path with the elements' classes and ids."""
    if not page:
        return []
    stack: list[tuple[str, str, str]] = []  # name, label, mark of open elements that shape the path
    out: list[tuple[str, str, str]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            if joined := " ".join("".join(text).split()):
                out.append(("/".join(x for _, x, _ in stack), "/".join(x for _, _, x in stack), joined))
            text.clear()

    def close(names: set, stops: set) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    at = 0
    while m := _TOKEN.match(page, at):
        at, token = m.end(), m[0]
        if token[0] != "<" or token == "<":
            text.append(_html.unescape(token))  # by itself: tags end a reference
            continue
        if not (n := _NAME.match(token)):
            continue
        if token[-1] != ">":
            break
        name = n[1].lower()
        if token[1] == "/":
            if name in _BLOCK or any(x == name for x, _, _ in stack):
                close({name}, set())
            elif name == "br":
                text.append(" ")
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in ("br", "hr", "img", "wbr", "input") or name in _VOID:
            if name == "hr":
                flush()
            elif name == "br":
                text.append(" ")
            continue
        if name in _BLOCK or name in _AWAY_TAGS:
            if name in _BLOCK:
                flush()
                close({"p"}, _BLOCK - {"p"})
            if name in _ENDS:
                close(_ENDS[name], _STOPS)
            if name in ("html", "body") and any(x == name for x, _, _ in stack):
                continue
            if name not in _BLOCK:
                flush()
            if not token.endswith("/>") or name in _BLOCK:
                stack.append(
                    (
                        name, _label(name, token, any(x in ("article", "main") for x, _, _ in stack)),
                        _mark(name, token),
                    )
                )
    flush()
    return out


def repeats(stream: list[str]) -> list[list]:
    """Items [unit, may be absent, may repeat]: adjacent equal runs of up to 6 blocks fold into one repeated unit."""
    return folded(stream)[0]


def folded(stream: list[str]) -> tuple[list[list], list[tuple[int, int]]]:
    """The items of a stream, and of each of its blocks the item and the place in the item's unit."""
    items, places, i, n = [], [], 0, len(stream)
    while i < n:
        for size in range(1, min(6, (n - i) // 2) + 1):
            unit = stream[i : i + size]
            if stream[i + size : i + 2 * size] == unit:
                j = i + size
                while stream[j : j + size] == unit:
                    j += size
                places += [(len(items), k % size) for k in range(j - i)]
                items.append([unit, False, True])
                i = j
                break
        else:
            places.append((len(items), 0))
            items.append([[stream[i]], False, False])
            i += 1
    return items, places


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of what both wrappers match: items of one alone become optional, repeats stay repeats."""
    keys = [[json.dumps(i[0]) for i in x] for x in (a, b)]
    out = []
    for op, a0, a1, b0, b1 in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if op == "equal":
            out += [[x[0], x[1] or y[1], x[2] or y[2]] for x, y in zip(a[a0:a1], b[b0:b1], strict=True)]
        else:
            only = [[u, True, many] for u, _, many in a[a0:a1]]
            seen = {json.dumps(x[0]): x for x in only}
            for u, _, many in b[b0:b1]:
                if (x := seen.get(json.dumps(u))) is not None:
                    x[2] = x[2] or many
                else:
                    only.append([u, True, many])
            out += only
    return out


class Matcher:
    """Matches pages' items against a wrapper as a regular expression: sets of wrapper positions are the bits of a number."""

    def __init__(self, wrapper: list[list]):
        self.n, self.optional, self.of = len(wrapper), 0, {}
        for j, (unit, absent, _) in enumerate(wrapper):
            self.optional |= absent << j
            key = json.dumps(unit)
            self.of[key] = self.of.get(key, 0) | 1 << j

    def match(self, items: list[list]) -> list[int] | None:
        """The wrapper's item that each item is, or None if the wrapper doesn't match. What may be absent is skipped."""
        masks = [self.of.get(json.dumps(unit), 0) for unit, _, _ in items]
        reach, at = [], 1
        for mask in [*masks, 0]:
            at |= self.optional ^ (self.optional + (at & self.optional))  # the carry runs through what may be skipped
            reach.append(at)
            at = (at & mask) << 1
        if not reach[-1] >> self.n & 1:
            return None
        out, end, needed = [], self.n, ((1 << self.n) - 1) & ~self.optional
        for mask, before in zip(reversed(masks), reversed(reach[:-1]), strict=True):
            least = max((needed & ((1 << end) - 1)).bit_length() - 1, 0)  # nothing that is needed lies after the item and before the next one
            end = ((before & mask & ((1 << end) - 1)) >> least << least).bit_length() - 1
            out.append(end)
        return out[::-1]


def show(wrapper: list[list]) -> str:
    """A wrapper as a regular expression over block paths."""
    return " ".join(f"({' '.join(u)}){'*' if o and m else '?' if o else '+' if m else ''}" for u, o, m in wrapper)


def main_element(texts: dict[str, int]) -> str:
    """The path of the element that holds the main text, from the length of the text at each path (or marked token): an
    article or main element if there is one, else the deepest one that holds most of what isn't kept away."""
    name = lambda part: re.split(r"[.#!]", part, maxsplit=1)[0]
    good = {p: n for p, n in texts.items() if "!" not in p}
    marked: dict[str, int] = {}
    for p, n in good.items():
        parts = p.split("/")
        names = [name(x) for x in parts]
        for mark in ("article", "main"):
            if mark in names:
                top = "/".join(parts[: names.index(mark) + 1])
                marked[top] = marked.get(top, 0) + n
                break
    if marked:
        return max(sorted(marked), key=lambda p: marked[p])
    total, best = sum(good.values()), ""
    while True:
        inner: dict[str, int] = {}
        for p, n in good.items():
            if (p + "/").startswith(best + "/" if best else "") and p != best:
                head = p[len(best) + 1 if best else 0 :].split("/")[0]
                inner[head] = inner.get(head, 0) + n
        top = max(sorted(inner), key=lambda h: inner[h], default=None)
        if top is None or name(top) in (
            "p", "li", "h1", "h2", "h3", "td", "tr", "dd", "dt", "pre",
        ) or inner[top] < 0.6 * total:
            return best
        best = f"{best}/{top}" if best else top


def is_content(path: str, main: str) -> bool:
    return "!" not in path and (not main or path == main or path.startswith(main + "/"))


_STREAM = pa.schema(
    [
        ("host", pa.string()), ("stream", pa.string()), ("main", pa.string()), ("weight", pa.int64()),
        ("n", pa.int64()), ("least", pa.string()), ("most", pa.string()), ("texts", pa.list_(pa.string())),
        ("masses", pa.list_(pa.struct([("i", pa.int32()), ("k", pa.int32()), ("path", pa.string()), ("chars", pa.int64())])))
    ]
)


def _digest(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))


def _streams(batches):
    """A row for each host, structure and main element of a partition: text and pages there, the least and the largest digest
    of a page's content, the texts ("item:place:digest") that all these pages have in the same slot, and how much text
    each slot has."""
    seen: dict[tuple, list] = {}

    def rows():
        cols = zip(*[
            (*k, *v[:-2], sorted(v[-2]), [{"i": i, "k": j, "path": x, "chars": c} for (i, j, x), c in sorted(v[-1].items())])
            for k, v in seen.items()
        ], strict=True)
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, _STREAM.types, strict=True)], schema=_STREAM,
        )
        seen.clear()
        return out

    for hosts, page in chunks(batches, ["host", "html"], "html"):
        for h, p in zip(hosts, page, strict=True):
            found = marked_blocks(p)
            lens: dict[str, int] = {}
            for path, _, t in found:
                lens[path] = lens.get(path, 0) + len(t)
            main, (items, places) = main_element(lens), folded([x for _, x, _ in found])
            body = _digest("\n".join(t for path, _, t in found if is_content(path, main)))
            texts = {f"{i}:{k}:{_digest(t)}" for (i, k), (_, _, t) in zip(places, found, strict=True)}
            if (known := seen.get(key := (h, json.dumps(items), main))) is None:
                known = seen[key] = [sum(lens.values()), 1, body, body, texts, {}]
            else:
                known[:5] = known[0] + sum(lens.values()), known[1] + 1, min(
                    known[2], body,
                ), max(known[3], body), known[4] & texts
            masses = known[5]
            for (i, k), (path, token, t) in zip(places, found, strict=True):
                at = i, k, _marked(path, token)
                masses[at] = masses.get(at, 0) + len(t)
        if len(seen) > 2000:
            yield rows()
    if seen:
        yield rows()


#: Structures or wrappers that one task folds into one.
FOLD = 400


def _fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper, from a host's distinct streams or wrappers in the order of their text."""
    shapes = sorted(x for batch in batches for x in batch.column("wrapper").to_pylist())
    wrapper: list | None = None
    for shape in shapes:
        wrapper = json.loads(shape) if wrapper is None else align(wrapper, json.loads(shape))
    columns = {
        "host": pa.array([key[0].as_py()], pa.string()),
        "wrapper": pa.array([json.dumps(wrapper or [])], pa.string()),
    }
    yield pa.RecordBatch.from_pydict(columns)


def _folded(shapes: DataFrame) -> DataFrame:
    """host, wrapper: all streams (host, wrapper) of a host in one, FOLD of them at a time, then FOLD of what came out."""
    level = shapes
    while True:
        sizes = level.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / FOLD).cast("int").alias("_parts"))
        most = sizes.agg(F.max("_parts")).first()[0] or 0
        if most <= 1:
            return level.groupBy("host").applyInArrow(_fold, "host string, wrapper string")
        wide = level.join(F.broadcast(sizes.filter("_parts > 1")), "host", "left")
        part = F.pmod(F.xxhash64("wrapper"), F.coalesce("_parts", F.lit(1)))
        level = materialise(
            wide.withColumn("_part", part).groupBy("host", "_part").applyInArrow(_fold, "host string, wrapper string"),
            "wrappers",
        )


_SLOT = pa.schema(
    [
        ("host", pa.string()), ("item", pa.int32()), ("place", pa.int32()), ("least", pa.string()),
        ("most", pa.string()), ("texts", pa.list_(pa.string())), ("pages", pa.int64()), ("path", pa.string()),
        ("chars", pa.int64())
    ]
)


def _slots(batches):
    """A row for each place of each structure: the wrapper's slot that it matches, and what and how much its pages have
    there."""
    matchers: dict[str, Matcher] = {}
    for batch in batches:
        rows: list[tuple] = []
        names = "host stream least most texts pages masses wrapper".split()
        for h, stream, least, most, texts, n, masses, wrapper in zip(
            *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names),
            strict=True,
        ):
            if wrapper not in matchers:
                if len(matchers) > 1000:
                    matchers.clear()
                matchers[wrapper] = Matcher(json.loads(wrapper))
            common: dict[tuple, list] = {}
            for x in texts or []:
                i, k, d = x.split(":")
                common.setdefault((int(i), int(k)), []).append(d)
            of: dict[tuple, tuple] = {}
            for x in masses or []:  # of several paths of a place, the one with most text
                path, chars = of.get(at := (x["i"], x["k"]), ("", 0))
                of[at] = x["path"] if x["chars"] > chars else path, chars + x["chars"]
            items = json.loads(stream)
            for i, j in enumerate(matchers[wrapper].match(items) or []):
                rows += [
                    (h, j, k, least, most, common.get((i, k), []), n, *of.get((i, k), ("", 0)))
                    for k in range(len(items[i][0]))
                ]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SLOT.types, strict=True)], schema=_SLOT,
            )


#: A text is template from so many pages of its slot on.
EVIDENCE = 5


def _constants(slots: DataFrame) -> DataFrame:
    """host, constant: JSON of (item, place, digest) of the texts that all pages with a slot have there, if these are EVIDENCE
    pages or more and the content of two of them differs: copies of one page tell nothing about its template. A slot has no
    more of them than its page with the fewest blocks there."""
    key = ["host", "item", "place"]
    whole = slots.groupBy(*key).agg(
        F.min("least").alias("_l"), F.max("most").alias("_m"), F.count(F.lit(1)).alias("_n"), F.sum("pages").alias("_p"),
    ).filter(f"_l <> _m and _p >= {EVIDENCE}")
    having = slots.select(
        *key, F.explode(F.array_distinct("texts")).alias("digest"),
    ).groupBy(*key, "digest").agg(F.count(F.lit(1)).alias("_having"))
    always = having.join(whole.select(*key, "_n"), key).filter("_having = _n")
    return always.groupBy("host").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("item", "place", "digest")))).alias("constant")
    )


def _masses(slots: DataFrame) -> DataFrame:
    """host, slots: JSON of (item, place, path, chars): the text in each slot of the host's wrapper."""
    sums = slots.groupBy("host", "item", "place").agg(
        F.max_by("path", F.struct("chars", "path")).alias("path"), F.sum("chars").alias("chars"),
    )
    return sums.groupBy("host").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("item", "place", "path", "chars")))).alias("slots")
    )


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON items), constant (JSON of the texts that belong to the template, by slot), slots (JSON of the text in
    each slot), n_pages: one row for each host.

    Pages of equal block structure are counted before anything of a host meets, so that what is aligned is each
    distinct structure once; so are the texts that all pages of a structure share. Structures are folded into a wrapper
    FOLD at a time, and matched against it where they are.
    """
    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    streams = materialise(
        rows.mapInArrow(
            _streams,
            "host string, stream string, main string, weight long, n long, least string, most string, texts array<string>, masses array<struct<i: int, k: int, path: string, chars: long>>",
        ).withColumn("sid", F.md5("stream")),
        "streams",
    )
    shapes = streams.groupBy("host", "sid").agg(
        F.min("stream").alias("stream"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("pages"),
    )
    masses = streams.select("host", "sid", F.inline("masses")).groupBy("host", "sid", "i", "k", "path").agg(
        F.sum("chars").alias("chars"),
    ).groupBy("host", "sid").agg(F.collect_list(F.struct("i", "k", "path", "chars")).alias("masses"))
    having = streams.select(
        "host", "sid", F.explode("texts").alias("text"),
    ).groupBy("host", "sid", "text").agg(F.count(F.lit(1)).alias("_having"))
    common = having.join(
        shapes.select("host", "sid", "_rows"), ["host", "sid"],
    ).filter("_having = _rows").groupBy("host", "sid").agg(F.collect_list("text").alias("texts"))
    shapes = materialise(
        shapes.join(common, ["host", "sid"], "left").join(masses, ["host", "sid"], "left"), "shapes",
    )
    sizes = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("_structures"))
    wrapped = materialise(
        _folded(shapes.select("host", F.col("stream").alias("wrapper"))).join(sizes, "host"), "wrapped",
    )
    met = join_groups(
        shapes.select("host", "stream", "least", "most", "texts", "pages", "masses"),
        wrapped.select("host", "wrapper", "_structures"), "host", "_structures", shapes.count(),
    )
    slots = materialise(
        met.mapInArrow(
            _slots,
            "host string, item int, place int, least string, most string, texts array<string>, pages long, path string, chars long",
        ), "slots",
    )
    n_pages = streams.groupBy("host").agg(F.sum("n").alias("n_pages"))
    return materialise(
        wrapped.select("host", "wrapper").join(_constants(slots), "host", "left").join(
            _masses(slots), "host", "left",
        ).join(n_pages, "host"), "wrappers",
    )


def host(url):
    return F.coalesce(
        F.lower(
            F.regexp_extract(
                F.col("url") if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1,
            )
        ),
        F.lit(""),
    )


class _Template:
    """What a wrapper says of a page's blocks; the match of a structure is remembered.

    The content is what the wrapper's statistics show: the slots of the element that holds most of the host's text. There, texts
    that are constant in a slot go, but for the slots of the path with the most text: what a site repeats in its prose is
    its own. Tags and names (the "!" of a path) only take away what such an element holds besides.
    """

    def __init__(self, wrapper: str | None, constant: str | None, slots: str | None):
        self.matcher, self.known = Matcher(json.loads(wrapper or "[]")), {}
        held = json.loads(slots or "[]")
        lens: dict[str, int] = {}
        for x in held:
            lens[x["path"]] = lens.get(x["path"], 0) + x["chars"]
        main = main_element(lens)
        content = [x for x in held if is_content(x["path"], main)]
        self.content = {(x["item"], x["place"]) for x in content}
        prose = max(sorted({x["path"] for x in content}), key=lambda p: lens[p], default=None)
        fixed = self.content - {(x["item"], x["place"]) for x in content if x["path"] == prose}
        self.constant: dict[tuple[int, int], set] = {}
        for c in json.loads(constant or "[]"):
            if (at := (c["item"], c["place"])) in fixed:
                self.constant.setdefault(at, set()).add(c["digest"])

    def kept(self, found: list[tuple[str, str, str]]) -> list[str] | None:
        """The texts of a page's blocks that are content; None if the page has none of the content slots."""
        items, places = folded([x for _, x, _ in found])
        if (at := self.known.get(key := json.dumps(items))) is None:
            if len(self.known) > 1000:
                self.known.clear()
            at = self.known[key] = self.matcher.match(items) or []
        slots = [(at[i], k) if at else None for i, k in places]
        if self.content.isdisjoint(slots):
            return None
        return [
            t for x, (_, _, t) in zip(slots, found, strict=True)
            if x in self.content and _digest(t) not in self.constant.get(x, ())
        ]


def _extract(schema: pa.Schema):
    names = schema.names[:-2]

    def run(batches):
        templates: dict[tuple, _Template] = {}
        for *rest, page, wrapper, constant, slots in chunks(
            batches, [*names, "html", "wrapper", "constant", "slots"], "html",
        ):
            texts = []
            for p, *key in zip(page, wrapper, constant, slots, strict=True):
                if (template := templates.get(tuple(key))) is None:
                    if len(templates) > 1000:
                        templates.clear()
                    template = templates[tuple(key)] = _Template(*key)
                found = marked_blocks(p)
                if (kept := template.kept(found)) is None:  # judged by itself
                    lens: dict[str, int] = {}
                    for path, _, t in found:
                        lens[path] = lens.get(path, 0) + len(t)
                    main = main_element(lens)
                    kept = [t for path, _, t in found if main and is_content(path, main)]
                texts.append("\n".join(kept))
            cols = [*rest, texts, [len(t) for t in texts]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema,
            )

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: page_id, url, text, n_chars (its code points).

    The blocks that match content slots of the host's wrapper, without what is constant there, in page order, one a line:
    character references decoded, white space turned into single spaces, ends trimmed. A page that has none of these
    slots is judged by itself. A null or empty page, and one without main text, has an empty text. A null url
    belongs to a host of its own. Repeated rows give repeated results; other columns are ignored; an empty table
    gives an empty result. A host with very many pages meets its wrapper by a broadcast of the largest hosts.
    """
    modest_batches(pages.sparkSession)
    wrappers = infer_wrappers(pages, url_col, html_col)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"), host(F.col(url_col)).alias("host"),
    )
    n = wrappers.agg(F.sum("n_pages")).first()[0] or 0
    met = join_groups(
        rows, wrappers.select("host", "wrapper", "constant", "slots", "n_pages"), "host", "n_pages", n, "left",
    )
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return met.mapInArrow(_extract(schema), "page_id long, url string, text string, n_chars long")
