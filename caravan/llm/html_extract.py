"""Operator 4, HTML extraction by union-free regular-expression inference.

Every page becomes a tree of tags and text slots. Its union-free expression has
runs of like siblings (or like groups of up to three siblings) folded into
repeated groups. The expressions of a host's pages are aligned one after the
other: items of the same tag are matched and merged into each other, an item
without a partner becomes optional, a match beside a like item becomes a
repeated group, and a text that differs becomes a slot (a text that is the same
on all pages stays a template's literal). The result is the host's wrapper.

Wrappers align with wrappers in the same way, so the work is a tree: each task
aligns its pages per host (pages of one skeleton are one alignment), then up to
``FAN_IN`` partial wrappers per task group are aligned, then the groups'. Every
page takes part, and the pages of a hot host never meet in one task; its partial
wrappers do, which are bounded by the template: a key (tag with its class, id and
role) that less than ``KEY_SHARE`` of the host's pages use is aligned by its first
class, id or role that reaches this share, else as the bare tag. So a host has at most
1 / ``KEY_SHARE`` times as many keys as a page, besides tags with one name.

The wrapper says where a host keeps its article: the <article> or <main> (or
what has main as its class, id or role) whose slots hold most text, if that is
``MAIN_SHARE`` of the text outside boilerplate, else the smallest container that holds most of the text
outside boilerplate elements. Each page is then read along that path, block by
block. A page that lacks the path is read by an expression of its own.

<html>, <body>, <main> and <article> are never boilerplate; a class, id or role
names it by a listed word alone or as its last part (post-comments), or first with
nothing but words of layout after it (comments-area, but not share-prices). If
next to nothing of a page is left so, the marked elements around its article or
most of its text (a form around the whole page) are read after all.

Blocks are block elements and <br>; character references are decoded, white
space inside a block becomes one space, empty blocks go, the rest is joined by
\\n in page order.

Literals of the host are dropped last: a block that more than ``LITERAL_SHARE`` of
the host's distinct texts hold beside other text, beyond chance (operator 1's
rule, at every number of pages). A text that consists of such blocks for more than half of its
characters does not count, so hosts whose pages are copies or near copies of each
other keep all.

Defined results: null or empty html gives the empty text; so does a page of
boilerplate alone; a null or odd url belongs to the host ''; repeated rows are
pages of their own; broken markup is read as far as it goes (an unknown end tag
is ignored, an unclosed element ends with its parent, an unclosed script, style
or comment ends the page, <svg/> is empty, a quoted value without its end is not
quoted); elements nested deeper than ``MAX_DEPTH`` are read as children of the last
one, blocks still as blocks; an empty table gives no rows; other columns are not read.

Reading a page takes time in proportion to its length: no pattern looks at a
character more often than a fixed number of times, open elements are counted.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import sys
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN_IN = 64        # task groups whose wrappers are aligned at the last level
TASK_HOSTS = 2000  # hosts whose wrappers a task keeps before it hands them on
TASK_KEYS = 200_000  # (host, key) counts a task keeps before it hands them on
KEY_SHARE = 0.05   # share of its host's pages that a key or name needs
LITERAL_SHARE = 0.5
MAX_DEPTH = 150    # levels of a page's tree
MAIN_SHARE = 0.6   # a container holds the article if it has this share of the text

# HTML elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style"       # not read, to the end of the page if unclosed
CLOSED_RAW = "title|textarea|iframe"  # text up to the end tag, if there is one
FOREIGN = {"svg", "math"}
SKIP = set("template noscript iframe svg math object canvas textarea select title".split())  # not read
BREAKS_OUT = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "pre", "br",
              "hr", "blockquote", "center", "body"}  # ends an open foreign element
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td "
            "tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
           "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
LIKE = [{"dt", "dd"}, {"td", "th"}]  # each ends the other
BOILERPLATE_TAGS = set("nav footer aside form head button dialog menu input label".split())
# Words of class, id and role that name boilerplate.
BOILERPLATE_WORDS = set("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment "
                        "comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr "
                        "login masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
                        "popup promo promotion related replies reply respond search share sharing sidebar signup "
                        "social sponsor sponsored subscribe toolbar topbar widget widgets".split())

# Words of layout that may follow such a word, and words that only say whether it is there.
LAYOUT_WORDS = set("area bar block body bottom box button buttons col column container content form group head header "
                   "holder icon icons inner item items left link links list outer panel right row section slot space "
                   "title toggle top unit wrap wrapper zone articles posts stories".split())
STATE_WORDS = set("has hide is no not show with without".split())

# Text of readers and links, which is no article however long it is.
READERS = set("comment comments disqus related replies reply respond".split())
SIDE = READERS | set("breadcrumb breadcrumbs consent cookie cookies footer gdpr menu nav navbar navigation pager "
                     "pagination sidebar toolbar topbar".split())
SIDE_TAGS = BOILERPLATE_TAGS - {"form"} | {"header"}
WHOLE = {"html", "body", "main", "article"}  # never boilerplate
REST_SHARE = 0.2   # with less of its text outside boilerplate a page is marked too far

# attributes up to the end of a tag; quotes hold a value only after =, and a new tag or declaration ends a broken one
_ATTRS = r"""(?:[^>=<]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|<(?![a-zA-Z/!?]))*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)|<[!?](?:[^<>]|<(?![!?]))*+>"
                    rf"|<(?P<text_raw>{CLOSED_RAW})\b{_ATTRS}>(?:(?!</?(?P=text_raw)\b).)*+</(?P=text_raw)\s*+>"
                    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>{_ATTRS})>"
                    r"|(?P<text>[^<]+|<)", re.S | re.I)
_NAMED = re.compile(rf"<([a-zA-Z][^\s/<>]*+)({_ATTRS})>")
_ATTR = re.compile(r"""\b(class|id|role)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


# ---------------------------------------------------------------- pages as trees
def names_of(attrs: str) -> list[str]:
    if not attrs.strip():
        return []
    return [w for _, v in _ATTR.findall(attrs) for w in v.strip("\"'").lower().split()]


def is_boilerplate(tag: str, names: list[str], inside: bool) -> bool:
    """``inside``: below an <article> or <main>, where <header> is its own."""
    return tag not in WHOLE and (tag in BOILERPLATE_TAGS or tag == "header" and not inside
                                 or _named(names, BOILERPLATE_WORDS))


def _named(names: list[str], words: set[str]) -> bool:
    """Whether a name is one of the words, by its last part, or by its first with layout after it."""
    for n in names:
        parts = _PART.findall(n)
        if parts and parts[0] not in STATE_WORDS and (
                parts[-1] in words or parts[0] in words and LAYOUT_WORDS.issuperset(parts[1:])):
            return True
    return False


def unmark(tree: list) -> None:
    """Takes the mark from elements that hold the page's <main> or <article>, or
    most of its text, if next to nothing of the page is outside boilerplate."""
    while True:
        marked, total, clear = [], 0, 0

        def look(x: list, outer: list | None) -> tuple[int, int]:
            """Characters below x, and whether an article (1) or <main> (2) is there."""
            nonlocal total, clear
            chars, holds = 0, 0
            for c in x[3]:
                if isinstance(c, str):
                    n = len(c.strip())
                    chars += n
                    total += n
                    clear += 0 if outer else n
                else:
                    n, h = look(c, outer or (c if c[1] else None))  # noqa: B023
                    if c[2] == "main" and n:
                        h = 2
                    elif c[2] == "article" and n and not _named(c[4], READERS):
                        h = max(h, 1)
                    if c[1] and not outer:
                        marked.append((h, n, c))  # noqa: B023
                    chars, holds = chars + n, max(holds, h)
            return chars, holds

        look(tree, None)
        if clear >= REST_SHARE * total:
            return
        best = max((m for m in marked if m[0] or 2 * m[1] > total and m[2][2] not in SIDE_TAGS
                    and not any(n in SIDE for n in m[2][4]) and not _named(m[2][4], READERS)),
                   key=lambda m: m[:2], default=None)
        if best is None:
            return
        best[2][1] = False


def key_of(tag: str, names: list[str], common: frozenset | None) -> str:
    """``common``: keys and names that enough of the host's pages use, None for all."""
    folded = [re.sub(r"\d+", "0", n) for n in names]
    key = ".".join([tag, *folded])
    if common is None or not names or key in common:
        return key
    known = [n for n in folded if f".{n}" in common]
    return f"{tag}.{'main' if 'main' in known else known[0]}" if known else tag


def keys_in(page: str) -> set[str]:
    """Keys of a page's elements with names, and the names (with a leading dot)."""
    out = set()
    for tag, attrs in set(_NAMED.findall(page)):
        if names := names_of(attrs):
            folded = [re.sub(r"\d+", "0", n) for n in names]
            out.add(".".join([tag.lower(), *folded]))
            out.update("." + n for n in folded)
    return out


class _Open:
    """The open elements of a page, and how many there are of each tag. A node
    deeper than ``MAX_DEPTH`` shares the children of the last one above; a
    node without children of its own marks where a block starts and ends."""

    def __init__(self, root: list):
        self.stack, self.count, self.flat = [root], Counter(), 0

    def push(self, node: list) -> None:
        inside = self.stack[-1]
        if len(self.stack) - self.flat < MAX_DEPTH or node[1] and not inside[1]:
            inside[3].append(node)
            self.stack.append(node)
        else:  # read as part of the last one
            if node[2] in BLOCK:
                inside[3].append(["", False, "div", [], []])
            self.stack.append(["", inside[1], node[2], inside[3], node[4]])
            self.flat += 1
        self.count[node[2]] += 1

    def cut(self, k: int) -> None:
        """Ends the elements from place k on."""
        for node in self.stack[k:]:
            self.count[node[2]] -= 1
            if node[0] == "":
                self.flat -= 1
                if node[2] in BLOCK:
                    node[3].append(["", False, "div", [], []])
        del self.stack[k:]

    def any_of(self, tags) -> bool:
        return any(self.count[t] for t in tags)

    def close(self, tags: set[str], scope: set[str]) -> None:
        """Ends the innermost open one of ``tags`` unless an element of ``scope``
        is open inside."""
        if not self.any_of(tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][2] in tags:
                self.cut(k)
                return
            if self.stack[k][2] in scope:
                return


def parse(page: str | None, common: frozenset | None = None) -> list:
    """Tree of [key, boilerplate, tag, children, names]; a text is a plain string.
    The key is the tag with its class, id and role, numbers written as 0."""
    root = ["", False, "", [], []]
    open_ = _Open(root)
    ends: dict[str, int] = {}  # the next end tag of a kind, from the last look on
    for m in _TOKEN.finditer(page or ""):
        text = m["text"]
        if text is not None:
            open_.stack[-1][3].append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if open_.count[tag]:
                open_.cut(next(k for k in range(len(open_.stack) - 1, 0, -1) if open_.stack[k][2] == tag))
            continue
        if tag == "body":  # ends what is open in <head>
            open_.close({"head"}, {"body"})
        if tag in BREAKS_OUT:
            open_.close(FOREIGN, {"foreignobject"})
        if tag in CLOSES_P:
            open_.close({"p"}, CLOSES_P - {"p"} | SKIP - FOREIGN)
        if tag in SIBLING:
            open_.close(next((g for g in LIKE if tag in g), {tag}), SIBLING[tag] | SKIP - FOREIGN)
        names = names_of(m["attrs"])
        node = [key_of(tag, names, common), is_boilerplate(tag, names, open_.any_of(("article", "main"))), tag, [], names]
        if tag in SKIP:
            node[1] = True
            if tag not in FOREIGN:  # without an end tag it ends with its parent, or where that one ends
                if ends.get(tag, -1) < m.end():
                    found = re.compile(f"</{tag}\\b", re.I).search(page, m.end())
                    ends[tag] = found.start() if found else len(page) + 1
                if ends[tag] > len(page):
                    node[2] = ""
        if tag in VOID or m["attrs"].rstrip().endswith("/"):
            if tag not in SKIP:
                open_.stack[-1][3].append(node)
        elif tag in SKIP:  # not read: open, but in no tree
            open_.stack.append(node)
            open_.count[node[2]] += 1
        else:
            open_.push(node)
    unmark(root)
    return root


# ---------------------------------------------------------------- expressions
# An item is {"k": key, "b": boilerplate, "r": repeated, "o": optional, "c": items,
# "n": characters of text seen in it, "t": literal text or None}; a text slot has
# key "#", a repeated group of several items the key "(...)".
def item(key: str, boilerplate: bool = False, kids: list | None = None, chars: int = 0, text: str | None = None) -> dict:
    return {"k": key, "b": boilerplate, "r": False, "o": False, "c": kids or [], "n": chars, "t": text}


def expression(tree: list) -> dict:
    kids = []
    for x in tree[3]:
        if isinstance(x, str):
            if t := x.strip():
                kids.append(item("#", chars=len(t), text=t if len(t) <= 200 else hashlib.md5(t.encode()).hexdigest()))
        else:
            kids.append(expression(x))
    return item(tree[0], tree[1], fold(kids))


def merge(a: dict, b: dict) -> dict:
    return {"k": a["k"], "b": a["b"] and b["b"], "r": a["r"] or b["r"], "o": a["o"] or b["o"], "n": a["n"] + b["n"],
            "t": a["t"] if a["t"] == b["t"] else None, "c": align(a["c"], b["c"])}


def fold(items: list[dict]) -> list[dict]:
    """Runs of like items, or of like groups of up to three, as one repeated item."""
    for period in (1, 2, 3):
        out, i = [], 0
        while i < len(items):
            group, j = items[i:i + period], i + period
            while len(group) == period and [x["k"] for x in items[j:j + period]] == [x["k"] for x in group]:
                group = [merge(a, b) for a, b in zip(group, items[j:j + period], strict=True)]
                j += period
            if j > i + period:
                if period > 1:
                    group = [item("(" + " ".join(x["k"] for x in group) + ")", kids=group)]
                group[0]["r"] = True
                out.append(group[0])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """Both lists as one: longest common subsequence by key, the rest optional."""
    if [x["k"] for x in a] == [x["k"] for x in b]:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["k"] == b[j]["k"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i]["k"] == b[j]["k"]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i] | {"o": True})
            i += 1
        else:
            out.append(b[j] | {"o": True})
            j += 1
    return fold(out)


def show(x: dict) -> str:
    """The wrapper as a regular expression, for people."""
    inner = " ".join(show(c) for c in x["c"])
    if x["k"] == "#":
        body = "#TEXT" if x["t"] is None else repr(x["t"])
    else:
        body = inner if x["k"].startswith("(") else f"<{x['k']}> {inner} </>".replace("  ", " ")
    return body if not (x["r"] or x["o"]) else f"({body})" + ("*" if x["r"] and x["o"] else "+" if x["r"] else "?")


# ---------------------------------------------------------------- where the article is
def _weights(x: dict) -> int:
    """Sets "w": characters below an item outside boilerplate."""
    x["w"] = 0 if x["b"] else x["n"] + sum(_weights(c) for c in x["c"])
    return x["w"]


def article_path(wrapper: dict) -> list[str]:
    """Keys from the page down to the container of the article; [] if there is
    no text outside boilerplate."""
    if not _weights(wrapper):
        return []
    found: list[tuple[int, list[str]]] = []

    def look(x: dict, path: list[str]) -> None:
        for c in x["c"]:
            if c["b"]:
                continue
            below = path if c["k"].startswith("(") else [*path, c["k"]]
            tag, *names = c["k"].split(".")
            if tag in ("article", "main") or "main" in names and tag not in ("html", "body"):
                found.append((c["w"], below))
            look(c, below)

    look(wrapper, [])
    best = max(found, key=lambda f: (f[0], len(f[1])), default=(0, []))
    if best[0] >= MAIN_SHARE * wrapper["w"]:
        return best[1]
    path, x = [], wrapper
    while True:
        kid = max((c for c in x["c"] if c["k"] != "#"), key=lambda c: c["w"], default=None)
        # a paragraph is text of the article, not its container
        if kid is None or kid["w"] < MAIN_SHARE * wrapper["w"] or kid["r"] or not any(
                c["k"].split(".")[0] in BLOCK or c["k"].startswith("(") for c in kid["c"]):
            return path
        if not kid["k"].startswith("("):
            path.append(kid["k"])
        x = kid


def places(tree: list, path: list[str]) -> list[list]:
    """The page's elements at a wrapper's path."""
    now = [tree]
    for key in path:
        now = [c for x in now for c in x[3] if not isinstance(c, str) and c[0] == key]
    return now


def text_of(tree: list) -> str:
    """Blocks of an element without the boilerplate in it."""
    blocks, run = [], []

    def end() -> None:
        if run:
            line = " ".join(html_lib.unescape("".join(run)).split())
            if line:
                blocks.append(line)
            run.clear()

    def walk(x: list) -> None:
        for c in x[3]:
            if isinstance(c, str):
                run.append(c)
            elif c[1]:
                end()
            else:
                if block := c[2] in BLOCK:
                    end()
                walk(c)
                if block:
                    end()

    walk(tree)
    end()
    return "\n".join(blocks)


def extract(page: str | None, path: list[str] | None, common: frozenset | None = None) -> str:
    tree = parse(page, common)
    at = places(tree, path) if path else []
    if not at:
        own = article_path(expression(tree))
        at = places(tree, own) if own else [tree]
    return "\n".join(t for t in map(text_of, at) if t)


# ---------------------------------------------------------------- Spark
def host_of(url: str | Column) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _skeleton(x: dict) -> str:
    return x["k"] + ("+" if x["r"] else "") + "[" + ",".join(_skeleton(c) for c in x["c"]) + "]" if x["c"] else x["k"]


def _add(a: dict, b: dict) -> None:
    """Adds b's texts to a; both have one skeleton."""
    a["n"] += b["n"]
    a["b"] = a["b"] and b["b"]
    if a["t"] != b["t"]:
        a["t"] = None
    for x, y in zip(a["c"], b["c"], strict=True):
        _add(x, y)


def _task_keys(batches):
    """Counts of this task's pages by host and key; the key '' counts all."""
    counts: dict[tuple[str, str], int] = {}

    def hand_on():
        rows = [(h, k, n) for (h, k), n in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                           enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "key", "n"])

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k in ("", *keys_in(page)):
                counts[host, k] = counts.get((host, k), 0) + 1
            if len(counts) > TASK_KEYS:
                yield hand_on()
    yield hand_on()


def common_keys(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key_host, common): the keys and names that at least ``KEY_SHARE`` of a
    host's pages use, a line each; hosts without any are left out."""
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).where("html is not null")
    counts = rows.mapInArrow(_task_keys, "host string, key string, n long").groupBy("host", "key").agg(F.sum("n").alias("n"))
    from caravan.llm.common import scratch_table
    counts = scratch_table(counts, "html-keys")
    total = counts.where("key = ''").select(F.col("host").alias("key_host"), F.col("n").alias("pages"))
    many = counts.where("key <> ''").join(total, F.col("host") == F.col("key_host"))
    many = many.where(F.col("n") >= F.col("pages") * F.lit(KEY_SHARE))
    return scratch_table(many.groupBy("key_host").agg(F.array_join(F.sort_array(F.collect_list("key")), "\n").alias("common")),
                         "html-common-keys")


def _commons():
    """Text of common keys -> set, kept for the hosts met last."""
    kept: dict[str | None, frozenset] = {}

    def of(text: str | None) -> frozenset:
        if text not in kept:
            if len(kept) >= 1000:
                kept.clear()
            kept[text] = frozenset((text or "").split("\n"))
        return kept[text]
    return of


def _task_wrappers(batches):
    common = _commons()
    part, kept = TaskContext.get().partitionId(), {}

    def hand_on():
        rows = [(h, json.dumps(aligned([s[k] for k in sorted(s)]))) for h, s in sorted(kept.items())]
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()),
                                           pa.array([part] * len(rows), pa.int32()),
                                           pa.array([w for _, w in rows], pa.string())], names=["host", "part", "wrapper"])

    for b in batches:
        for host, page, keys in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            x = expression(parse(page, common(keys)))
            of_host = kept.setdefault(host, {})
            key = _skeleton(x)
            if key in of_host:
                _add(of_host[key], x)
            else:
                of_host[key] = x
            if len(of_host) > 256:  # many skeletons: align what there is
                kept[host] = {"": aligned([of_host[k] for k in sorted(of_host)])}
        if len(kept) > TASK_HOSTS:
            yield hand_on()
    yield hand_on()


def aligned(wrappers: list[dict]) -> dict:
    out = wrappers[0]
    for w in wrappers[1:]:
        out = merge(out, w)
    return out


def _align_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "wrapper"])
    out = aligned([json.loads(w) for w in rows["wrapper"]])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [int(rows["part"].iloc[0])], "wrapper": [json.dumps(out)]})


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", common: DataFrame | None = None) -> DataFrame:
    """(host, wrapper): each host's inferred expression, as JSON."""
    common = common_keys(pages, url_col, html_col) if common is None else common
    kind = "host string, part int, wrapper string"
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).where("html is not null")
    rows = rows.join(common, F.col("host") == F.col("key_host"), "left").select("host", "html", "common")
    parts = rows.mapInArrow(_task_wrappers, kind)
    some = parts.groupBy("host", (F.col("part") % FAN_IN).alias("group")).applyInPandas(_align_group, kind)
    return some.groupBy("host").applyInPandas(_align_group, kind).select("host", "wrapper")


def _paths(batches):
    for b in batches:
        paths = [article_path(json.loads(w)) for w in b.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(paths, pa.list_(pa.string()))],
                                         names=["host", "path"])


def _extract(batches):
    common = _commons()
    for b in batches:
        texts = [extract(h, p, common(k)) for h, p, k in
                 zip(*(b.column(c).to_pylist() for c in ("html", "path", "common")), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    from caravan.llm.common import scratch_table
    common = common_keys(pages, url_col, html_col)
    found = scratch_table(wrappers(pages, url_col, html_col, common), "wrappers")
    paths = found.mapInArrow(_paths, "host string, path array<string>")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"), host_of(url_col).alias("page_host"))
    # one after the other: each is small enough to broadcast, their join looks too large
    joined = rows.join(paths, F.col("page_host") == F.col("host"), "left")
    joined = joined.join(common, F.col("page_host") == F.col("key_host"), "left").select("page_id", "url", "html", "path", "common")
    texts = joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
    return without_literals(scratch_table(texts, "html-texts"))


def without_literals(texts: DataFrame) -> DataFrame:
    """``texts`` without the blocks that are literals of their hosts."""
    from caravan.llm.line_dedup import drop_boilerplate_lines
    out = drop_boilerplate_lines(texts, host_of("url"), max_ratio=LITERAL_SHARE, counts=False)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
