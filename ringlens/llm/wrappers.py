"""HTML extraction by inferring a union-free regular expression per host.

A page is read as a stream of tags and texts. Its expression is a sequence of elements
with a quantifier each (once, ``?`` optional, ``+`` repeated) and text slots. Pages
of a host are aligned one after the other with the wrapper so far:

- elements that both have are aligned further inside;
- a run of like siblings, or of like groups of siblings, becomes a repeated group;
- an element that only one side has becomes optional;
- texts that differ turn a fixed text into a slot; equal ones stay fixed.

Aligning is done per batch first, then partial wrappers of a host are aligned in salted
groups, so a host with very many pages is never one task's work. The finished wrapper marks
the elements that hold the main text, and each page is read with its host's marks. Containers that have
the same text on most pages of a host with enough pages are fixed groups of its wrapper and are not
read, unless they are most of a page's main text (copies of one page), hold a heading, or stand in
an article and are not lists of links. Names of tags and classes
drop what is beside the article on hosts of any size.

Defined cases: a null page has an empty text; a page without a main part in its host's
wrapper is read by the same rules as a host of its own; a null or odd url is the host '';
truncated and badly nested markup is closed where HTML would close it; repeated rows each
give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.llm.common import Scratch, prepare

#: Partial wrappers of a host that one task aligns, and the interpreter's limit of nested calls.
FAN_IN, DEEP = 64, 100_000_000
# Element names of HTML by their role in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "menclose",
          "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "annotation", "annotation-xml"}
TEXT_BLOCKS = {"p", "pre", "blockquote", "address", "figcaption", "caption", "summary", "dt", "dd", "td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "option", "input", "dialog", "menu", "object", "canvas", "audio", "video", "head"} | RAW
# Words in class and role of containers that name parts beside the article.
BESIDE = {"nav", "navbar", "navigation", "menu", "footer", "sidebar", "side", "ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo",
          "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "share", "sharing",
          "social", "related", "recommended", "comment", "comments", "respond", "reply", "replies", "disqus", "breadcrumb", "breadcrumbs", "pagination", "pager",
          "toolbar", "widget", "login", "search", "contentinfo", "complementary", "masthead", "skip"}
MAIN_WORDS = {"content", "main", "article", "post", "entry", "story", "body", "text"}
BLOCK_STOP = {"p": {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
                    "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"},
              "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Containers that may be fixed groups; pages a host needs for them, and the share of its pages that have them.
GROUPS = {"div", "section", "ul", "ol", "dl", "table", "center", "figure", "details", "fieldset"}
ENOUGH_PAGES, MOST_PAGES = 10, 0.8
STOPPED_BY = {tag: [t for t, stops in BLOCK_STOP.items() if tag in stops] for tag in set().union(*BLOCK_STOP.values())}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>=][^\s\"'>]*/\Z")
_NAME = re.compile(r"[^a-z]+")


#: Mark of a label's words that come from the id alone.
ID = "="


class Element:
    __slots__ = ("tag", "names", "hidden", "kids", "label")

    def __init__(self, tag: str, names: frozenset = frozenset(), hidden: bool = False, ids: frozenset = frozenset()):
        self.tag, self.names, self.hidden, self.kids = tag, names, hidden, []
        self.label = tag + "".join("." + n for n in sorted(names)) + "".join("." + ID + n for n in sorted(ids - names))


def _element(tag: str, attrs: str) -> Element:
    if "=" not in attrs and "hidden" not in attrs:
        return Element(tag)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    words, ids = (frozenset(w for a in kind for w in _NAME.split(found.get(a, "").lower()) if w) for kind in (("class", "role"), ("id",)))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return Element(tag, words, hidden, ids)


def parse(page: str | None) -> Element:
    """Element tree of a page; kids are elements and decoded texts."""
    root = Element("#root")
    stack, at, page = [root], 0, page or ""
    low, opened = None, Counter()  # the open elements by tag

    def close() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            if stack[-1].kids and isinstance(stack[-1].kids[-1], str):
                stack[-1].kids[-1] += html_lib.unescape(m[4])
            else:
                stack[-1].kids.append(html_lib.unescape(m[4]))
        elif m[2]:
            tag = m[2].lower()
            if m[1]:
                if opened[tag]:
                    while close() != tag:
                        pass
                continue
            # an element that HTML closes by itself ends with what is open inside it
            if any(opened[t] for t in STOPPED_BY.get(tag, ())):
                for i in range(len(stack) - 1, 0, -1):
                    if tag in BLOCK_STOP.get(stack[i].tag, ()):
                        while len(stack) > i:
                            close()
                        break
                    if stack[i].tag not in INLINE and stack[i].tag != "p":
                        break
            e = _element(tag, m[3])
            stack[-1].kids.append(e)
            if tag in RAW:
                if low is None:
                    low = page.lower()
                end = low.find(f"</{tag}", at)
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            elif tag not in VOID and (not m[3].endswith("/") or _UNQUOTED_END.search(m[3])):
                stack.append(e)
                opened[tag] += 1
    return root


def digests(root: Element) -> dict[int, str]:
    """Digest of label and whole text by element, for the containers of blocks that hold text."""
    order, out, full = [root], {}, {}
    for e in order:
        order.extend(k for k in e.kids if not isinstance(k, str))
    for e in reversed(order):
        parts = [t for k in e.kids if (t := " ".join(k.split()) if isinstance(k, str) else full[id(k)])]
        full[id(e)] = hashlib.blake2b("\0".join([e.label, *parts]).encode("utf-8", "replace"), digest_size=8).hexdigest() if parts else ""
        if parts and e.tag in GROUPS:
            out[id(e)] = full[id(e)]
    return out


# --- expressions: dict(l=label, q="1"|"?"|"+"|"*", c=[items], n=text length, a=length inside links, x=fixed text or None,
#     d={digest: pages} of the texts that the element has wherever it is seen); the root has the number of pages as p ---

def _slot(text: str) -> dict:
    return {"l": "#", "q": "1", "c": [], "n": len(text), "a": 0, "x": text if len(text) <= 80 else None, "d": {}}


def expression(e: Element) -> dict:
    top: list[dict] = []
    digest = digests(e)
    # open elements: (element, its kids still to come, items so far, whether inside a link); pages nest without limit
    stack = [(e, iter(e.kids), [], e.tag == "a")]
    while stack:
        own, kids, items, inside_link = stack[-1]
        for k in kids:
            if not isinstance(k, str):
                stack.append((k, iter(k.kids), [], inside_link or k.tag == "a"))
                break
            if t := " ".join(k.split()):
                items.append(_slot(t))
        else:
            stack.pop()
            n = sum(i["n"] for i in items)
            item = {"l": own.label, "q": "1", "c": fold(items), "n": n, "a": n if inside_link else sum(i["a"] for i in items), "x": None,
                    "d": {digest[id(own)]: 1} if id(own) in digest else {}}
            (stack[-1][2] if stack else top).append(item)
    return top[0]


def _dump(item: dict) -> str:
    """JSON of the items in pre-order with their numbers of kids, so that nesting has no limit."""
    flat, stack = [], [item]
    while stack:
        i = stack.pop()
        flat.append([i["l"], i["q"], len(i["c"]), i["n"], i["a"], i["x"], i["d"]])
        stack.extend(reversed(i["c"]))
    return json.dumps([item.get("p", 1), flat])


def _nested(item: dict) -> str:
    """JSON of the items as they are nested."""
    out, stack = [], [item]
    while stack:
        i = stack.pop()
        if isinstance(i, str):
            out.append(i)
            continue
        out.append(json.dumps({k: v for k, v in i.items() if k != "c"})[:-1] + ', "c": [')
        stack.append("]}")
        for n, k in enumerate(reversed(i["c"])):
            stack.extend([","] * (n > 0) + [k])
    return "".join(out)


def _load(text: str) -> dict:
    top: dict = {"c": []}
    stack = [(top, 1)]
    pages, flat = json.loads(text)
    for label, q, kids, n, a, x, d in flat:
        while len(stack[-1][0]["c"]) == stack[-1][1]:
            stack.pop()
        item = {"l": label, "q": q, "c": [], "n": n, "a": a, "x": x, "d": d}
        stack[-1][0]["c"].append(item)
        stack.append((item, kids))
    return top["c"][0] | {"p": pages}


def _wider(a: str, b: str) -> str:
    """Quantifier that allows what both allow."""
    many, none = "+" in (a, b) or "*" in (a, b), a in "?*" or b in "?*"
    return "*" if many and none else "+" if many else "?" if none else "1"


def merge(a: dict, b: dict, one_page: bool = False) -> dict:
    """Align two items of one label, of different pages or side by side on the same."""
    sys.setrecursionlimit(DEEP)  # calls of Python functions take no C stack
    return {"l": a["l"], "q": _wider(a["q"], b["q"]), "c": align(a["c"], b["c"], one_page), "n": a["n"] + b["n"], "a": a["a"] + b["a"], "x": a["x"] if a["x"] == b["x"] else None,
            "d": {t: max(a["d"].get(t, 0), b["d"].get(t, 0)) for t in a["d"] | b["d"]} if one_page else {t: k + b["d"][t] for t, k in a["d"].items() if t in b["d"]}}


def _shape(item: dict) -> str:
    return item["l"]


def fold(items: list[dict]) -> list[dict]:
    """Resolve squares: like neighbours, and like groups of up to four neighbours, become one repeated item."""
    out: list[dict] = []
    for item in items:
        if out and _shape(out[-1]) == _shape(item):
            out[-1] = merge(out[-1], item, True) | {"q": _wider("+", item["q"] if item["q"] in "?*" and out[-1]["q"] in "?*" else "1")}
            continue
        out.append(item)
        for width in (2, 3, 4):
            if len(out) >= 2 * width and [_shape(i) for i in out[-width:]] == [_shape(i) for i in out[-2 * width:-width]]:
                group = [merge(p, q, True) for p, q in zip(out[-2 * width:-width], out[-width:])]
                out[-2 * width:] = [_group(group)]
                break
            if len(out) > width and out[-width - 1]["l"].startswith("(") and out[-width - 1]["l"] == _group(out[-width:])["l"]:
                old = out[-width - 1]
                out[-width - 1:] = [merge(old, _group(out[-width:]), True) | {"q": "+"}]
                break
    return out


def _group(items: list[dict]) -> dict:
    return {"l": "(" + " ".join(_shape(i) for i in items) + ")", "q": "+", "c": items, "n": sum(i["n"] for i in items), "a": sum(i["a"] for i in items), "x": None, "d": {}}


def align(a: list[dict], b: list[dict], one_page: bool = False) -> list[dict]:
    """Longest common subsequence of labels; what only one side has becomes optional."""
    n, m = len(a), len(b)
    if [i["l"] for i in a] == [i["l"] for i in b]:
        return [merge(p, q, one_page) for p, q in zip(a, b)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["l"] == b[j]["l"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    maybe = lambda x: x | {"q": _wider(x["q"], "?")}
    while i < n or j < m:
        if i < n and j < m and a[i]["l"] == b[j]["l"]:
            out.append(merge(a[i], b[j], one_page))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(maybe(a[i]))
            i += 1
        else:
            out.append(maybe(b[j]))
            j += 1
    return fold(out)


def regular_expression(item: dict) -> str:
    """The wrapper as text."""
    if item["l"] == "#":
        body = item["x"] if item["x"] is not None else "#"
    else:
        inner = "".join(regular_expression(i) for i in item["c"])
        body = inner if item["l"].startswith("(") else f"<{item['l']}>{inner}"
    return body if item["q"] == "1" else f"({body}){item['q']}"


# --- main parts ---

def fixed_groups(wrapper: dict) -> set[str]:
    """Digests of the containers that have the same text on most pages of a host with enough pages."""
    pages, out, stack = wrapper.get("p", 1), set(), [wrapper]
    while stack and pages >= ENOUGH_PAGES:
        item = stack.pop()
        out.update(t for t, k in item["d"].items() if k >= MOST_PAGES * pages)
        stack.extend(item["c"])
    return out


def _parts(label: str) -> tuple[str, set]:
    """Tag and words of class and role."""
    tag, *names = label.split(".")
    return tag, {n for n in names if n[0] != ID}


def _words(label: str) -> set:
    """Words of class, role and id."""
    return {n.removeprefix(ID) for n in label.split(".")[1:]}


def beside(tag: str, names) -> bool:
    """Whether an element is a part beside the article: by its tag, or a container of blocks by its class or role."""
    if tag in OUTSIDE:
        return True
    if tag in INLINE or tag in HEADINGS or tag in TEXT_BLOCKS:
        return False
    own = BESIDE & set(names)
    return bool(own) and (tag not in ("article", "main", "body", "html") or bool(own & {"comment", "comments", "reply"}))


def main_paths(wrapper: dict) -> list[list[str]]:
    """Paths of the elements that hold the main text, by the whole host's evidence."""
    # the elements that are not beside the article, by path; groups add no step to a path
    paths: list[tuple[int, str, int]] = [(-1, "", 0)]  # (path above, label, length)
    outer: set[int] = set()  # paths in containers whose whole id names a part beside the article
    ids: dict[tuple[int, str], int] = {}
    found: list[tuple[int, dict]] = []
    stack = [(k, 0) for k in reversed(wrapper["c"])]
    while stack:
        k, above = stack.pop()
        if k["l"] == "#" or not k["l"].startswith("(") and beside(*_parts(k["l"])):
            continue
        if not k["l"].startswith("("):
            here = ids.setdefault((above, k["l"]), len(paths))
            if here == len(paths):
                paths.append((above, k["l"], paths[above][2] + 1))
            found.append((here, k))
            ids_of = {n[1:] for n in k["l"].split(".")[1:] if n[0] == ID}
            if above in outer or ids_of and ids_of <= BESIDE and k["l"].split(".")[0] in ("div", "section", "td", "ul"):
                outer.add(here)
            above = here
        stack.extend((i, above) for i in reversed(k["c"]))

    def spell(path: int) -> list[str]:
        out = []
        while path:
            out.append(paths[path][1])
            path = paths[path][0]
        return out[::-1]

    kinds = (lambda t, w: t == "article", lambda t, w: t == "main" or "main" in w and t in ("div", "section", "td"),
             lambda t, w: bool(w & MAIN_WORDS) and t in ("div", "section", "td"))
    for rule in kinds:
        picked = dict.fromkeys(p for p, k in found if k["n"] > 0 and rule(_parts(k["l"])[0], _words(k["l"])))
        if rule is not kinds[0]:  # a name decides between containers; it drops nothing where there is no other
            picked = {p: None for p in picked if p not in outer} or picked
        if picked:
            within = [False] * len(paths)  # a path's own number is above that of the path it continues
            for p in range(1, len(paths)):
                within[p] = within[paths[p][0]] or paths[p][0] in picked
            return [spell(p) for p in picked if not within[p]]
    # the innermost element with most of the text that is not in links
    plain = _plain(wrapper, fixed_groups(wrapper))
    own = {p: plain[id(k)] for p, k in found}
    total = max(own.values(), default=0)
    deep = [p for p, v in own.items() if total and v >= 0.6 * total and paths[p][1].split(".")[0] not in INLINE | HEADINGS | {"p", "ul", "ol", "li"}]
    return [spell(max(deep, key=lambda p: paths[p][2]))] if deep else []


def _plain(wrapper: dict, fixed: set[str]) -> dict[int, int]:
    """Length of text outside links, outside parts beside the article and outside fixed groups, by item."""
    order = [wrapper]
    for item in order:
        order.extend(item["c"])
    out: dict[int, int] = {}
    for item in reversed(order):
        if item["l"] == "#":
            out[id(item)] = item["n"]
        elif not item["l"].startswith("(") and beside(*_parts(item["l"])) or item["q"] in "1?" and fixed & item["d"].keys():
            out[id(item)] = 0
        else:
            out[id(item)] = max(0, sum(out[id(k)] for k in item["c"]) - item["a"])
    return out


def _prose(root: Element) -> set[int]:
    """Elements that are read even if their text is fixed on a host: those with a heading, and all in an article but lists of links."""
    order, inside = [(root, False)], {}
    for e, article in order:
        inside[id(e)] = article
        order.extend((k, article or e.tag == "article") for k in e.kids if not isinstance(k, str))
    text, links, headed, out = {}, {}, {}, set()
    for e, _ in reversed(order):
        kids = [k for k in e.kids if not isinstance(k, str)]
        text[id(e)] = sum(len(k.strip()) for k in e.kids if isinstance(k, str)) + sum(text[id(k)] for k in kids)
        links[id(e)] = text[id(e)] if e.tag == "a" else sum(links[id(k)] for k in kids)
        headed[id(e)] = e.tag in HEADINGS or any(headed[id(k)] for k in kids)
        if headed[id(e)] or inside[id(e)] and 2 * links[id(e)] <= text[id(e)]:
            out.add(id(e))
    return out


def main_text(root: Element, paths: list[list[str]], fixed: set[str] = frozenset()) -> str:
    """Blocks of the marked elements in page order, without the host's fixed groups, joined by newlines."""
    if fixed:
        whole, digest = main_text(root, paths), digests(root)
        page = {k for k, t in digest.items() if t in fixed} - _prose(root)
        if not page:
            return whole
        # a page that is mostly fixed is a copy of others, not their frame
        text = _blocks(root, paths, page)
        return text if 2 * len(text) >= len(whole) else whole
    return _blocks(root, paths, set())


def _blocks(root: Element, paths: list[list[str]], drop: set[int]) -> str:
    wanted: dict = {}  # the paths as nested tables of labels; the key None ends one
    for path in paths:
        at = wanted
        for label in path:
            at = at.setdefault(label, {})
        at[None] = True
    blocks, now = [], []

    def flush():
        if t := " ".join("".join(now).split()):
            blocks.append(t)
        now.clear()

    def read(top: Element):
        # open elements: (element, its kids still to come, whether inside a header)
        stack = [(top, iter(top.kids), False)]
        while stack:
            e, kids, in_header = stack[-1]
            for k in kids:
                if isinstance(k, str):
                    if not in_header:
                        now.append(k)
                elif k.tag in ("br", "img"):
                    now.append(" ")
                elif not k.hidden and id(k) not in drop and not beside(k.tag, k.names):
                    if k.tag not in INLINE:
                        flush()
                    stack.append((k, iter(k.kids), (in_header or k.tag == "header" or "header" in k.names) and k.tag not in HEADINGS))
                    break
            else:
                stack.pop()
                if stack and e.tag not in INLINE:
                    flush()

    hit = False
    stack = [(root, wanted)]
    while stack:
        e, at = stack.pop()
        if None in at:
            flush()
            read(e)
            flush()
            hit = True
        else:
            stack.extend((k, at[k.label]) for k in reversed(e.kids) if not isinstance(k, str) and not k.hidden and k.label in at)
    if not hit:
        own = main_paths(expression(root))
        if own and own != paths:
            return _blocks(root, own, drop)
        if not own:
            read(root)
            flush()
    return "\n".join(blocks)


# --- Spark ---

def joined(a: dict | None, b: dict) -> dict:
    """Wrapper of the pages of both."""
    return merge(a, b) | {"p": a.get("p", 1) + b.get("p", 1)} if a else b


def infer_wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper, marks) from (host, html); marks holds the main paths and the fixed groups."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            hosts: dict[str, dict] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hosts[host] = joined(hosts.get(host), expression(parse(page)))
            yield pa.record_batch([pa.array(list(hosts), pa.string()), pa.array([_dump(w) for w in hosts.values()], pa.string())], ["host", "wrapper"])

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(pdf["wrapper"])  # a fixed order: a task that is run again gives the same wrapper
        whole = _load(parts[0])
        for p in parts[1:]:
            whole = joined(whole, _load(p))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [_dump(whole)]})

    parts = scratch.table(pages.select("host", "html").mapInArrow(partial, "host string, wrapper string"))
    while True:
        most = parts.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        salts = -(-most // FAN_IN)
        merged = scratch.table(parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
                               .groupBy("host", "salt").applyInPandas(join_up, "host string, wrapper string"))
        scratch.drop(parts)
        parts = merged

    @F.pandas_udf("string")
    def marks(ws: pd.Series) -> pd.Series:
        return pd.Series([json.dumps([main_paths(w), sorted(fixed_groups(w))]) for w in map(_load, ws)], dtype=object)

    @F.pandas_udf("string")
    def nested(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: _nested(_load(w)))

    return scratch.table(parts.select("host", nested("wrapper").alias("wrapper"), marks("wrapper").alias("marks")))


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    spark = prepare(df.sparkSession)
    scratch = Scratch(spark, "wrappers")
    pages = df.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).withColumn(
        "host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    wrappers = infer_wrappers(pages.where("html is not null"), scratch).select("host", "marks")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = {p: (paths, set(fixed)) for p in set(batch.column(3).to_pylist()) for paths, fixed in [json.loads(p) if p else ([], [])]}
            texts = [main_text(parse(h), *known[p]) if h else "" for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  ["page_id", "url", "text", "n_chars"])

    return pages.join(wrappers, "host", "left").select("page_id", "url", "html", "marks").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
