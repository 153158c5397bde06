"""Main text of web pages by wrapper induction.

Pages of one host are dealt into groups of bounded size.  In a group every
page becomes a light DOM tree; runs of like siblings (same tag and class) are
one repeated node.  A page of middling size is the seed, and every other tree
is aligned with it by simple tree matching: the largest order-preserving
matching of equal nodes, top down.  A text that stands at the same aligned
node in all different pages of the group is template; what varies is content.

Where a page marks its articles (article, main, or the like) content is taken
from all of them in page order, else from the body; menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are dropped by element,
role, class or id.  A form, or an element known by its class or id only, is
searched for a marked article if there is none elsewhere, and without one
stays if it holds most of the body's text.  Inside a marked article a constant text counts as
template only if constants are a small part of the article, so a host that
repeats one article keeps it.

Text: character references decoded, white space of a block turned into one
blank and trimmed, blocks in page order joined by a line feed.

Defined results: null or empty html gives ""; a null URL is the host ""; a
page alone in its group has no template texts; markup may be cut off or badly
nested; repeated pages count once for the induction and all come back; equal
ids are kept apart; elements below ``ALIGN_DEPTH`` levels are not aligned.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import stored

BROADCAST_HOSTS = 100_000
GROUP_PAGES = 96            # pages aligned with one seed, on average at most
SUPPORT = 8                 # different pages a template text must stand in
ALIGN_DEPTH = 64
ARTICLE_CONSTANT = 0.3      # share of an article that template texts may take

# fixed values: HTML's element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html option tbody td tfoot th thead tr caption legend dd dt li".split()) | {"li", "dd", "dt"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "aside button canvas datalist dialog footer form head iframe input menu nav noembed noframes noscript "
    "object script select style svg template textarea title audio video".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar "
                          "navigation search toolbar".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
            "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}}

# names of page parts around an article: a class or id that ends with one, but for states (has-sidebar, comments-open)
PARTS = re.compile(
    r"(?:^|\s)(?!(?:has|have|no|not|with|without|is|show|hide|hides)[_-])(?:[^\s_-]+[_-]+)*(?:ads?|advert\w*|adsense|sponsor\w*|banner|promo\w*|pop-?up|modal|cookies?|consent|gdpr|notice|"
    r"alert|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|comments?|comment-?list|"
    r"disqus\w*|replies|respond|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|"
    r"subscription|widgets?|toolbar|pagination|pager|login|signup|search-?form)"
    r"(?:[_-]+(?:left|right|top|bottom|main|primary|secondary|wrap|wrapper|container|inner|outer|box|bar|area|block|"
    r"section|list|links?|items?|content|text|form|buttons?|icons?|title|widgets?|\d+))*(?=$|\s)", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "sig", "kids", "drop", "article", "soft")

    def __init__(self, tag, sig="", drop=False, article=False, soft=False):
        self.tag, self.sig, self.kids, self.drop, self.article, self.soft = tag, sig, [], drop, article, soft


def _element(tag: str, attributes: str) -> Node:
    if not attributes.strip(" /\t\r\n"):
        return Node(tag, tag, tag in DROPPED, tag in ("article", "main"), tag == "form")
    a = {}
    for name, x, y, z in ATTRIBUTE.findall(attributes):
        a.setdefault(name.lower(), html_lib.unescape(x or y or z))
    names = f"{a.get('class', '')} {a.get('id', '')}".strip()
    role = a.get("role", "").lower()
    article = tag in ("article", "main") or role in ("main", "article") or "articlebody" in a.get("itemprop", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(
        r"display\s*:\s*none", a.get("style", ""), re.I)
    part = tag not in ("html", "body") and not article and names and PARTS.search(names)
    hard = tag in DROPPED and tag != "form" or role in DROPPED_ROLES or bool(hidden)
    soft = not hard and (tag == "form" or bool(part))
    return Node(tag, f"{tag}.{a.get('class', '')}", hard or soft, article and not (hard or soft), soft)


def parse(text: str) -> Node:
    root = Node("#root", "#root")
    stack, at, position = [root], 0, 0
    find = TOKEN.search
    while True:
        m = find(text, position)
        if m is None:
            break
        if m.start() > at:
            stack[-1].kids.append(text[at:m.start()])
        at = position = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "table") and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK or stack[i].tag == "button":
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    del stack[i:]
                elif stack[i].tag in LIMITS.get(tag, ("table", "tbody", "thead", "tfoot")) or stack[i].tag in (
                        "article", "main", "section", "div", "body"):
                    break
        node = _element(tag, m.group(3))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(text, at)
            if end is None and tag == "title":
                continue
            at = position = len(text) if end is None else end.end()
        elif tag not in VOID and not m.group(3).endswith("/") or tag in BLOCK and tag not in VOID:
            stack.append(node)
    if at < len(text):
        stack[-1].kids.append(text[at:])
    return root


def blocks(node: Node, skipped=frozenset(), inside: bool = False) -> list[str]:
    """Clean text blocks below ``node``, without dropped or skipped parts."""
    out, words = [], []

    def close():
        text = SPACES.sub(" ", html_lib.unescape("".join(words))).strip()
        words.clear()
        if text:
            out.append(text)

    todo = [(node, False, False)]
    while todo:
        x, done, heading_only = todo.pop()
        if isinstance(x, str):
            if not heading_only:
                words.append(x)
        elif done:
            close()
        elif x is not node and (x.drop and not (x.tag == "header") or id(x) in skipped):
            if x.tag in BLOCK:
                close()
            else:
                words.append(" ") if x.tag in ("iframe", "object", "svg", "video", "audio", "canvas") else None
        elif x.tag == "br":
            words.append(" ")
        else:
            if x.tag == "header" and x is not node:     # of an article: its headings stay
                if not inside:
                    close()
                    continue
                heading_only = True
            elif x.tag in HEADINGS:
                heading_only = False
            block = x.tag in BLOCK
            if block:
                close()
                todo.append((x, True, heading_only))
            todo.extend((k, False, heading_only) for k in reversed(x.kids))
    close()
    return out


def _articles(root: Node, soft: bool) -> tuple[list[Node], Node]:
    """Marked articles that are not inside others, in page order, and the body;
    with ``soft`` also those below parts known by name only."""
    found, body, todo = [], root, [root]
    while todo:
        x = todo.pop()
        if x.article:
            found.append(x)
            continue
        if x.tag == "body":
            body = x
        if not x.drop or soft and x.soft:
            todo.extend(k for k in reversed(x.kids) if not isinstance(k, str))
    return found, body


def _size(node: Node) -> int:
    """Length of the text below ``node``, with that of parts known by name."""
    size, todo = 0, [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            size += len(x.strip())
        elif x is node or not x.drop or x.soft:
            todo.extend(x.kids)
    return size


def content_root(root: Node) -> tuple[Node, bool]:
    """The marked articles, below one node, or the body."""
    found, body = _articles(root, False)
    if not found:
        found, _ = _articles(root, True)
    if len(found) == 1:
        return found[0], True
    if found:
        whole = Node("#articles", "#articles")
        whole.kids = found
        return whole, True
    whole, x = _size(body), body
    while x is not None:            # down the elements that hold most of the text
        x = next((k for k in x.kids if not isinstance(k, str) and (not k.drop or k.soft) and 2 * _size(k) > whole), None)
        if x is not None:
            x.drop = False
    return body, False


def runs(node: Node) -> list[tuple[str, list[Node]]]:
    out: list = []
    for k in node.kids:
        if not isinstance(k, str):
            if out and out[-1][0] == k.sig:
                out[-1][1].append(k)
            else:
                out.append((k.sig, [k]))
    return out


def match(a: Node, b: Node, depth: int = 0) -> tuple[int, list]:
    """Simple tree matching of the runs below two equal nodes: its size, and
    the matched (run of a, run of b) pairs, in both whole subtrees."""
    if depth >= ALIGN_DEPTH:
        return 1, []
    ra, rb = runs(a), runs(b)
    if not ra or not rb:
        return 1, []
    best = [[(0, None)] * (len(rb) + 1) for _ in range(len(ra) + 1)]
    for i, (sa, xs) in enumerate(ra, 1):
        row, above = best[i], best[i - 1]
        for j, (sb, ys) in enumerate(rb, 1):
            pick = above[j] if above[j][0] >= row[j - 1][0] else row[j - 1]
            if sa == sb:
                size, below = match(xs[0], ys[0], depth + 1) if len(xs) == len(ys) == 1 else (1, [])
                if above[j - 1][0] + size > pick[0]:
                    pick = (above[j - 1][0] + size, (above[j - 1][1], xs, ys, below))
            row[j] = pick
    size, link = best[-1][-1]
    pairs = []
    while link is not None:
        link, xs, ys, below = link
        pairs.append((xs, ys))
        pairs.extend(below)
    return size + 1, pairs


def _leaf_text(x: Node) -> str | None:
    """Text of a block without blocks below it, else None."""
    words, todo = [], list(reversed(x.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            words.append(k)
        elif k.tag in BLOCK:
            return None
        else:
            todo.extend(reversed(k.kids))
    return SPACES.sub(" ", "".join(words)).strip()


def extract_group(pages: list[str]) -> list[str]:
    """Main texts of pages of one host."""
    trees = [parse(p) for p in pages]
    spots = [content_root(t) for t in trees]
    firsts: dict[str, int] = {}
    for i, p in enumerate(pages):
        firsts.setdefault(p, i)
    different = sorted(firsts.values(), key=lambda i: (len(pages[i]), pages[i]))
    skipped: list[set] = [set() for _ in pages]
    if len(different) >= SUPPORT:
        seed = trees[different[len(different) // 2]]
        seen: dict[int, Counter] = {}
        aligned = []
        distinct = set(different)
        for i, t in enumerate(trees):
            pairs = [(id(xs[0]), [(y, _leaf_text(y)) for y in ys]) for xs, ys in match(seed, t)[1]]
            aligned.append(pairs)
            if i in distinct:
                for slot, ys in pairs:
                    seen.setdefault(slot, Counter()).update({x for _, x in ys if x})
        constant = {slot: {x for x, n in c.items() if n == len(different)} for slot, c in seen.items()}
        for i, pairs in enumerate(aligned):
            same = [(y, x) for slot, ys in pairs for y, x in ys if x and x in constant.get(slot, ())]
            if same:
                spot, marked = spots[i]
                if marked:
                    whole = sum(map(len, blocks(spot, inside=True)))
                    kept = sum(map(len, blocks(spot, {id(y) for y, _ in same}, inside=True)))
                    if whole - kept > ARTICLE_CONSTANT * whole:
                        continue
                skipped[i] = {id(y) for y, _ in same}
    return ["\n".join(blocks(spot, skipped[i], marked)) for i, (spot, marked) in enumerate(spots)]


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *,
              group_pages: int = GROUP_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    large = rows.groupBy("host").count().where(F.col("count") > group_pages).select(
        "host", F.ceil(F.col("count") / group_pages).cast("int").alias("parts"))
    # one row per large host, so that pages are not dealt by host to be counted
    large = stored(large, "large-hosts")
    rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large, "host", "left")
    part = F.coalesce(F.pmod(F.xxhash64("page_id", F.xxhash64("html")), F.col("parts")), F.lit(0))
    # one key of both: a dealing by host alone would serve a group of two columns
    group = F.concat_ws("\u0001", part.cast("string"), "host")

    def extract(t: pa.Table) -> pa.Table:
        texts = extract_group(t.column("html").to_pylist())
        return pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array(texts, pa.string())})

    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.select(group.alias("group"), "page_id", "url", "html").groupBy("group").applyInArrow(
        extract, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
