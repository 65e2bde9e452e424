"""Main-text extraction by wrapper induction.

Pages of one host are aligned with reference pages of that host by simple tree matching:
two trees match if their roots do, and the matching of their child sequences is the best
order-preserving one.  A reference node whose text is the same in most of the aligned
pages that differ in content is template; slots whose text varies are content.  Support is
counted over all pages of a host, by distinct content, so copies of one page never turn
its article into template.

What HTML itself says goes first: scripts, styles, navigation, footers, forms and the like
are no content on any page, and a main or article element bounds it where there is one.
Words of a class or id only vote: a subtree with such a word is left out while the page has
other text that varies, and a region named by its class alone counts only if it holds most
of the text that varies.

References are ``references`` pages of distinct contents of each host and of each layout of a
host: pages with the same layout tags and class names, where they have ``least_pages`` contents.
A page is aligned with the most similar one of its layout and of its host, and where that has the page's own
content, whose agreement tells nothing, with another one too.  Pages are joined to them by host and layout; nothing else
is grouped by host, so a host with a third of all pages is only a larger part of every task.
"""

from __future__ import annotations

import html as _html
import marshal
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<",
    re.S,
)
#: Tags with their class, of what lays out a page.
_LAYOUT = r"(?i)<((?:body|main|article|section|aside|header|footer|nav|form|div)(?=[\s/>])(?:[^>]*?\sclass\s*=\s*(?:\"[^\">]*\"|'[^'>]*'|[^\s\"'>]+))?)"
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_TOKENS = re.compile(r"[a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr img br".split()
)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "noframes", "xmp")}
#: Never content, wherever they stand.
_DROP = frozenset("nav footer aside form script style noscript template iframe svg math object embed canvas audio video select button textarea dialog menu head title".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that vote against a subtree, anywhere.
_DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar comment comments disqus reply replies respond share sharing social related recommended recommendations subscribe subscription newsletter signup login popup modal pagination pager".split()
)
#: The same outside an article only: inside one they often name its own parts.
_OUTER_WORDS = frozenset("header footer banner masthead search widget toolbar topbar skip alert tags copyright".split())
_REGION_WORDS = frozenset("article post entry story content main".split())
#: A name with one of these tells a state of the page ("no-ad", "comments-closed") and has no vote.
_STATE_WORDS = frozenset("no not non without has with closed open enabled disabled".split())
_VOTING = _DROP_WORDS | _OUTER_WORDS
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}


@dataclass(frozen=True)
class WrapperConfig:
    """references: of distinct contents, for each host and for each layout of at least least_pages contents.

    match_cells: longest child lists, as a product, whose subtrees are all weighed exactly.
    least_pages, share: distinct contents, and their part, in which a template node's text is the same.
    """

    references: int = 4
    least_pages: int = 5
    share: float = 0.8
    match_cells: int = 200_000
    broadcast_bytes: int = 32_000_000


@dataclass
class Tree:
    """Block elements in document order, and the text blocks in reading order."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    words: list[frozenset[str]] = field(default_factory=list)
    votes: list[tuple[int, int]] = field(default_factory=list)  # by _DROP_WORDS and by _OUTER_WORDS: 2 a whole name, 1 a part of one, 0 none
    role: list[str] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    kids: list[list[int]] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # (node, text, characters in links)

    def add(self, tag: str, parent: int, attrs: str) -> int:
        words: frozenset[str] = frozenset()
        role, hidden, votes = "", False, (0, 0)
        if attrs and "=" in attrs or "hidden" in attrs:
            named = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
            names = [_TOKENS.findall(x) for x in f"{named.get('class', '')} {named.get('id', '')} {named.get('itemprop', '')}".split()]
            words = frozenset(w for x in names for w in x)
            if words & _VOTING:
                told = [x for x in names if not _STATE_WORDS.intersection(x)]
                votes = tuple(max((2 if len(x) == 1 else 1 for x in told if listed.intersection(x)), default=0) for listed in (_DROP_WORDS, _OUTER_WORDS))
            role = named.get("role", "")
            style = named.get("style", "").replace(" ", "")
            hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        for column, value in zip((self.tag, self.parent, self.words, self.votes, self.role, self.hidden, self.kids), (tag, parent, words, votes, role, hidden, []), strict=True):
            column.append(value)
        n = len(self.tag) - 1
        if parent >= 0:
            self.kids[parent].append(n)
        return n


def parse(source: str) -> Tree:
    """The block tree of any string; markup errors are repaired as browsers mostly do."""
    tree = Tree()
    stack = [tree.add("#root", -1, "")]
    links, piece, in_link, at, end = 0, [], 0, 0, len(source)

    def flush() -> None:
        nonlocal links
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                tree.blocks.append((stack[-1], text, links))
            piece.clear()
        links = 0

    match = _TOKEN.match
    while at < end:
        m = match(source, at)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            s = m[0]
            if s[0] == "<" and len(s) > 1:
                continue
            s = _html.unescape(s) if "&" in s else s
            piece.append(s)
            if in_link:
                links += len(s)
            continue
        tag, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in _RAW and not closing:
            # what these hold is not markup and never content
            stop = _RAW[tag].search(source, at)
            if tag not in ("title",):
                piece.append(" ")
            at = stop.start() if stop else end
            continue
        if tag in _RAW:
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                piece.append(" ")
            continue
        flush()
        in_link = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[k]] == tag:
                    del stack[k:]
                    break
            continue
        if tree.tag[stack[-1]] == "p":
            stack.pop()  # a block ends an open paragraph
        if tag in _CLOSES:
            ends, fences = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                t = tree.tag[stack[k]]
                if t in fences:
                    break
                if t in ends:
                    del stack[k:]
                    if tag not in ("tbody", "thead", "tfoot", "tr"):
                        break
        n = tree.add(tag, stack[-1], attrs)
        if tag not in _VOID and not attrs.endswith("/"):
            stack.append(n)
    flush()
    return tree


def _is_article(tree: Tree, i: int) -> bool:
    return tree.tag[i] == "article" or tree.role[i] == "article" or "articlebody" in tree.words[i]


def _is_main(tree: Tree, i: int) -> bool:
    return tree.tag[i] == "main" or tree.role[i] == "main"


def _marks(tree: Tree) -> list[int]:
    """What HTML and the word lists say of each node and its ancestors.

    0: no content.  1, 2: doubtful, by a whole name or a part of one.  3: open.  The page
    itself, its main and its articles are never doubtful by their own names, nor is what
    holds the main, or the first-order heading with half of the text.
    """
    n = len(tree.tag)
    dead, article, chars, top, core, inner = [False] * n, [False] * n, [0] * n, [False] * n, [False] * n, [False] * n
    for i in range(n):
        up = tree.parent[i]
        inside = up >= 0 and article[up]
        inner[i] = inside
        dead[i] = up >= 0 and dead[up] or tree.tag[i] in _DROP or tree.hidden[i] or tree.role[i] in _DROP_ROLES or not inside and tree.tag[i] == "header"
        article[i] = inside or not dead[i] and (_is_article(tree, i) or _is_main(tree, i))
    for node, text, links in tree.blocks:
        if not dead[node]:
            chars[node] += len(text) - links
    for i in range(n - 1, 0, -1):
        if not dead[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            top[up] |= top[i] or tree.tag[i] == "h1"
            core[i] |= _is_main(tree, i) or "articlebody" in tree.words[i]
            core[up] |= core[i]
    headed = any(top[i] and _is_article(tree, i) and not inner[i] for i in range(n))
    out = [0] * n
    for i in range(n):
        if dead[i]:
            continue
        up, (drop, outer), tag = tree.parent[i], tree.votes[i], tree.tag[i]
        vote = drop if inner[i] or tree.words[i] & _REGION_WORDS else max(drop, outer)
        if vote and (tag in ("html", "body") or core[i] or top[i] and 2 * chars[i] >= chars[0]):
            vote = 0
        elif vote and not inner[i] and _is_article(tree, i) and (top[i] or not headed or vote < 2):
            vote = 0
        out[i] = min(out[up] if up >= 0 else 3, 3 - vote)
    return out


def _below(tree: Tree, roots: list[int], open_: list[bool]) -> list[bool]:
    live = [False] * len(open_)
    for i in roots:
        live[i] = True
    for i, up in enumerate(tree.parent):
        live[i] = (live[i] or up >= 0 and live[up]) and open_[i]
    return live


def _region(tree: Tree, open_: list[bool], template: set[int]) -> list[bool]:
    """Of the open nodes those inside the region of the content.

    A main goes before articles, and is narrowed to those inside it only if they hold half
    of its text and all of its first-order headings.  Articles without a main need such a
    heading, or half of the text; a region named by class words needs half of the text.
    Text in links, and text of template nodes, has no weight.
    """
    n = len(open_)
    size, told = [0] * n, [False] * n
    for node, text, links in tree.blocks:
        told[node] = True
        if open_[node] and node not in template:
            size[node] += len(text) - links
    weight = lambda live: sum(s for s, x in zip(size, live, strict=True) if x)
    holds = lambda live: any(t and x for t, x in zip(told, live, strict=True))
    top = [i for i in range(n) if open_[i] and tree.tag[i] == "h1"]
    main = _below(tree, [i for i in range(n) if open_[i] and _is_main(tree, i)], open_)
    inside = holds(main)
    article = _below(tree, [i for i in range(n) if open_[i] and _is_article(tree, i) and (main[i] or not inside)], open_)
    if inside:
        narrow = holds(article) and 2 * weight(article) >= weight(main) and all(article[i] for i in top if main[i])
        return article if narrow else main
    whole = weight(open_)
    if holds(article) and (2 * weight(article) >= whole or any(article[i] for i in top)):
        return article
    roots = [i for i in range(n) if open_[i] and tree.words[i] & _REGION_WORDS and tree.tag[i] not in ("html", "body") and tree.tag[i] not in _HEADINGS]
    named = _below(tree, [*roots, *top], open_)
    if roots and holds(named) and 2 * weight(_below(tree, roots, open_)) >= max(whole, 1):
        return named
    # no region is named: lists of links are menus
    own: dict[int, list[int]] = {}
    for node, text, links in tree.blocks:
        up = node
        while up >= 0:
            if tree.tag[up] in ("ul", "ol", "table"):
                pair = own.setdefault(up, [0, 0])
                pair[0] += len(text)
                pair[1] += links
            up = tree.parent[up]
    menus = {k for k, (chars, links) in own.items() if links >= 0.8 * chars}
    live = list(open_)
    for i in range(n):
        up = tree.parent[i]
        live[i] = live[i] and i not in menus and (up < 0 or live[up])
    return live


def _verdicts(tree: Tree, marks: list[int], template: set[int] = frozenset()) -> list[bool]:
    """Whether each node can hold content.  Doubtful nodes can where nothing else does but headings and template."""
    first = None
    for least in (3, 2, 1):
        live = _region(tree, [m >= least for m in marks], template)
        first = first or live
        if any(live[node] and node not in template and tree.tag[node] not in _HEADINGS and len(text) > links for node, text, links in tree.blocks):
            return live
        if min((m for m in marks if m), default=3) >= least:
            break
    return first


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def skeleton(tree: Tree, marks: list[int], live: list[bool]) -> tuple[list[str], list[int], list[int], list[int], bytes]:
    """Tags, parents and hashes of own text (0: none) of the nodes, those texts that are no content beyond doubt, and which nodes could be content."""
    told: list[list[str]] = [[] for _ in tree.tag]
    for node, text, _ in tree.blocks:
        told[node].append(text)
    texts = [_hash("\n".join(t)) if t else 0 for t in told]
    return tree.tag, tree.parent, texts, sorted({t for t, m, alive in zip(texts, marks, live, strict=True) if t and not alive and m not in (1, 2)}), bytes(m > 0 for m in marks)


def tree_match(a: tuple, b: tuple, cells: int) -> dict[int, int]:
    """Simple tree matching: node of a -> node of b.  Equal own texts weigh half a node more."""
    tag_a, up_a, text_a = a[:3]
    tag_b, up_b, text_b = b[:3]

    def children(up: list[int]) -> list[list[int]]:
        kids: list[list[int]] = [[] for _ in up]
        for i, p in enumerate(up):
            if p >= 0:
                kids[p].append(i)
        return kids

    def shapes(tag: list[str], text: list[int], kids: list[list[int]]) -> list[int]:
        out = [0] * len(tag)
        for i in range(len(tag) - 1, -1, -1):
            out[i] = hash((tag[i], text[i], *(out[k] for k in kids[i])))
        return out

    kids_a, kids_b = children(up_a), children(up_b)
    same_a, same_b = shapes(tag_a, text_a, kids_a), shapes(tag_b, text_b, kids_b)
    size_a = [1.5] * len(tag_a)
    for i in range(len(tag_a) - 1, 0, -1):
        size_a[up_a[i]] += size_a[i]
    memo: dict[tuple[int, int], tuple[float, list[tuple[int, int]]]] = {}

    def known(x: int, y: int) -> float | None:
        """The weight of a pair, None while it has to be computed from its children."""
        if tag_a[x] != tag_b[y]:
            return 0.0
        if same_a[x] == same_b[y]:
            return size_a[x]  # equal subtrees match node by node
        if not kids_a[x] or not kids_b[y]:
            return 1.5 if text_a[x] == text_b[y] else 1.0
        got = memo.get((x, y))
        return got[0] if got else None

    def plan(x: int, y: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        """Pairs of children that are sure, and those left to the table; wide lists are paired here."""
        m, n = kids_a[x], kids_b[y]
        head = 0
        while head < min(len(m), len(n)) and same_a[m[head]] == same_b[n[head]]:
            head += 1
        tail = 0
        while tail < min(len(m), len(n)) - head and same_a[m[-1 - tail]] == same_b[n[-1 - tail]]:
            tail += 1
        pairs = [(m[k], n[k]) for k in range(head)] + [(m[len(m) - 1 - k], n[len(n) - 1 - k]) for k in range(tail)]
        p, q = m[head : len(m) - tail], n[head : len(n) - tail]
        if len(p) * len(q) <= cells:
            return pairs, p, q
        lists = []
        for nodes, tag, text, same, kids in ((p, tag_a, text_a, same_a, kids_a), (q, tag_b, text_b, same_b, kids_b)):
            lists.append((np.array([hash(tag[i]) for i in nodes]), np.array([text[i] for i in nodes]), np.array([same[i] for i in nodes]), np.array([hash(tuple(sorted({tag[k] for k in kids[i]}))) if kids[i] else 0 for i in nodes])))
        return pairs + [(p[i], q[j]) for i, j in _wide(*lists, np.array([size_a[i] for i in p]))], [], []

    def weigh(root: tuple[int, int]) -> None:
        todo = [(root, None)]
        while todo:
            (x, y), made = todo.pop()
            if (x, y) in memo:
                continue
            if made is None:
                made = plan(x, y)
                pairs, p, q = made
                lacking = [(i, j) for i in p for j in q if known(i, j) is None]
                lacking += [(i, j) for i, j in pairs if known(i, j) is None]
                if lacking:
                    todo.append(((x, y), made))
                    todo += [(pair, None) for pair in lacking]
                    continue
            pairs, p, q = made
            if p and q:
                best = [[0.0] * (len(q) + 1)]
                cost = []
                for i in p:
                    row, last = [0.0], best[-1]
                    ws = [known(i, j) for j in q]
                    for k, v in enumerate(ws):
                        row.append(max(row[k], last[k + 1], last[k] + v))
                    best.append(row)
                    cost.append(ws)
                i, j = len(p), len(q)
                while i and j:
                    v = cost[i - 1][j - 1]
                    if v and best[i][j] == best[i - 1][j - 1] + v:
                        pairs.append((p[i - 1], q[j - 1]))
                        i, j = i - 1, j - 1
                    elif best[i][j] == best[i - 1][j]:
                        i -= 1
                    else:
                        j -= 1
            memo[x, y] = ((1.5 if text_a[x] == text_b[y] else 1.0) + sum(known(i, j) for i, j in pairs), pairs)

    if not len(tag_a) or not len(tag_b) or tag_a[0] != tag_b[0]:
        return {}
    if known(0, 0) is None:
        weigh((0, 0))
    found: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        found[x] = y
        if same_a[x] == same_b[y]:
            todo += zip(kids_a[x], kids_b[y], strict=True)
        elif (x, y) in memo:
            todo += memo[x, y][1]
    return found


def _wide(a: tuple, b: tuple, sizes: np.ndarray) -> list[tuple[int, int]]:
    """The best order-preserving pairs of two long child lists, by a table of which only rows are held (Hirschberg).

    Lists of leaves get the exact weights.  Subtrees that are not equal weigh by their
    roots and by whether their children have the same tags, before they are matched.
    """
    tag_a, text_a, same_a, under_a = a
    tag_b, text_b, same_b, under_b = b

    def row(i: int, lo: int, hi: int) -> np.ndarray:
        v = np.where(text_b[lo:hi] == text_a[i], 1.5, 1.0) + (0.25 * (under_b[lo:hi] == under_a[i]) if under_a[i] else 0.0)
        return np.where(same_b[lo:hi] == same_a[i], sizes[i], np.where(tag_b[lo:hi] == tag_a[i], v, 0.0))

    def scores(order: range, lo: int, hi: int, back: bool) -> np.ndarray:
        """Best weights of these rows with every prefix, or with back every suffix, of the columns."""
        best = np.zeros(hi - lo + 1)
        for i in order:
            v = row(i, lo, hi)[::-1] if back else row(i, lo, hi)
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + v))
        return best[::-1] if back else best

    out: list[tuple[int, int]] = []
    todo = [(0, len(tag_a), 0, len(tag_b))]
    while todo:
        top, end, lo, hi = todo.pop()
        if top == end or lo == hi:
            continue
        if end - top == 1:
            v = row(top, lo, hi)
            if v.max() > 0:
                out.append((top, lo + int(v.argmax())))
            continue
        mid = (top + end) // 2
        cut = lo + int((scores(range(top, mid), lo, hi, False) + scores(range(end - 1, mid - 1, -1), lo, hi, True)).argmax())
        todo += [(top, mid, lo, cut), (mid, end, cut, hi)]
    return out


def _choose(own: tuple, content: int, refs: list[_Ref]) -> list[_Ref]:
    """The reference that shares most of what is no content, then most tags.

    Texts that could be content have no say, so support for them is not biased.  Where that reference is a copy
    of the page, whose agreement tells nothing, the best one of another content comes with it.
    """
    mine, tags = set(own[3]), set(own[0])
    ranked = sorted(refs, key=lambda r: (-len(mine & r.sure), -len(tags & r.tags), r.ref))
    other = next((r for r in ranked if r.content != content), None)
    return [r for r in (ranked[:1] + [other] if ranked and ranked[0] is not other else ranked[:1]) if r]


def _content(tree: Tree, live: list[bool], template: set[int] = frozenset()) -> str:
    return "\n".join(text for node, text, _ in tree.blocks if live[node] and node not in template)


def host_of(url):
    """Host of a URL column, lower case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def layout_of(html):
    """A number for the layout of an HTML column: its layout tags with their class names, without digits."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(_LAYOUT), F.lit(1))))
    bare = F.transform(names, lambda x: F.regexp_replace(F.lower(F.concat(F.regexp_extract(x, r"^\w+", 0), F.lit(" "), F.regexp_extract(x, r"(?i)\sclass\s*=\s*(.*)$", 1))), r"[\"'\d]", ""))
    return F.xxhash64(F.array_sort(F.array_distinct(bare)))


@dataclass
class _Page:
    """A parsed page: its tree, marks, verdicts, skeleton, and the hash of its content."""

    tree: Tree
    marks: list[int]
    live: list[bool]
    own: tuple
    content: int


def _page(source: str | None) -> _Page:
    tree = parse(source or "")
    marks = _marks(tree)
    live = _verdicts(tree, marks)
    # without a main or an article, what is doubtful tells pages apart too
    bounded = any(x and (_is_main(tree, i) or _is_article(tree, i)) for i, x in enumerate(live))
    return _Page(tree, marks, live, skeleton(tree, marks, live), _hash(_content(tree, live if bounded else [m > 0 for m in marks])))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [_page(h) for h in batch.column(3).to_pylist()]
        blobs = [marshal.dumps(p.own) for p in pages]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([p.content for p in pages], pa.int64()), pa.array(blobs, pa.binary())], ["host", "layout", "ref", "content", "blob"])


@dataclass
class _Ref:
    """A reference: its number, content, skeleton, template nodes, sure texts and tags."""

    ref: int
    content: int
    shape: tuple
    nodes: set[int]
    sure: set[int]
    tags: set[str]


class _Refs:
    """Unpacked references, those of the last layouts and hosts seen."""

    def __init__(self) -> None:
        self.held: dict[tuple, list[_Ref]] = {}

    def __call__(self, key: tuple, refs: pa.ListScalar) -> list[_Ref]:
        if key not in self.held:
            if len(self.held) >= 256:
                self.held.clear()
            made = [(r, marshal.loads(r["blob"])) for r in refs.as_py() or []]
            self.held[key] = [_Ref(r["ref"], r["content"], b, set(r.get("nodes") or ()), set(b[3]), set(b[0])) for r, b in made]
        return self.held[key]

    def near(self, host: str, layout: int, refs: pa.ListScalar, wide: pa.ListScalar, own: tuple, content: int) -> list[_Ref]:
        """The references to align a page with, of its layout and of its host."""
        both = _choose(own, content, self((host, layout), refs)) + _choose(own, content, self((host, None), wide))
        return list({r.ref: r for r in both}.values())


def _support(cfg: WrapperConfig):
    """(host, ref, node, same, content) of every aligned node with text that could be content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Refs()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for host, layout, content, blob, refs, wide in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5), strict=True):
                own = marshal.loads(blob)
                for r in known.near(host, layout, refs, wide, own, content):
                    for x, y in tree_match(own, r.shape, cfg.match_cells).items():
                        if own[4][x] and own[2][x] and r.shape[2][y]:
                            for c, v in zip(rows, (host, r.ref, y, own[2][x] == r.shape[2][y], content), strict=True):
                                c.append(v)
            types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["host", "ref", "node", "same", "content"])

    return run


def _extract(cfg: WrapperConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Refs()
        for batch in batches:
            texts = []
            for host, layout, source, refs, wide in zip(*(batch.column(k).to_pylist() for k in range(2, 5)), batch.column(5), batch.column(6), strict=True):
                p = _page(source)
                live, gone = p.live, set()
                if refs.is_valid or wide.is_valid:
                    for r in known.near(host, layout, refs, wide, p.own, p.content):
                        if r.nodes:
                            gone |= {x for x, y in tree_match(p.own, r.shape, cfg.match_cells).items() if y in r.nodes and p.own[2][x] == r.shape[2][y]}
                    live = _verdicts(p.tree, p.marks, gone) if gone else live
                texts.append(_content(p.tree, live, gone))
            text = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main(pages: DataFrame, cfg: WrapperConfig = WrapperConfig(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Blocks are joined by one line feed, white space inside a block is one space, and
    character references are decoded.  Null HTML, or a page without content, gives an
    empty text.  Pages without a host form one host of their own.  Repeated rows, and pages
    without an id, are kept as they are; copies of a page count once as support.  Pages of
    any length, depth and width are aligned.  An empty table gives an empty result, and
    extra columns of pages are not read.
    """
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    some = rows.where("html is not null").select("host", layout_of(F.col("html")).alias("layout"), F.xxhash64("html").alias("ref"), "html")
    # parsed once for all that alignment needs; written, and small beside the pages
    shape = "host string, layout long, ref long, content long, blob binary"
    pages_seen = scratch.table(some.mapInArrow(_skeletons, shape), "skeletons")
    # Layouts with too few contents for support of their own, or that are all their host has, need no references of their own.
    groups = scratch.table(pages_seen.groupBy("host", "layout").agg(F.count_distinct("content").alias("n")), "layouts")
    whole = groups.groupBy("host").agg(F.count(F.lit(1)).alias("layouts"))
    several = groups.where(F.col("n") >= cfg.least_pages).join(whole.where("layouts > 1").select("host"), "host", "left_semi")
    several = scratch.table(several.select("host", "layout"), "several")
    # A slot's reference is its least content: references of a host or layout differ in content.
    slot = F.pmod("content", F.lit(cfg.references)).cast("int").alias("slot")
    first = F.min_by(F.struct("ref", "content", "blob"), F.struct("content", "ref")).alias("r")
    few = (lambda d: F.broadcast(d)) if 100 * several.count() <= cfg.broadcast_bytes else (lambda d: d)
    wide = pages_seen.groupBy("host", slot).agg(first).select("host", F.lit(None).cast("long").alias("layout"), "r.*")
    deep = pages_seen.join(few(several), ["host", "layout"]).groupBy("host", "layout", slot).agg(first).select("host", "layout", "r.*")
    shapes = scratch.table(wide.unionByName(deep), "shapes")
    size = shapes.agg(F.sum(F.length("blob"))).head()[0] or 0
    near = (lambda d: F.broadcast(d)) if size <= cfg.broadcast_bytes else (lambda d: d)

    def joined(frame: DataFrame, shapes: DataFrame) -> DataFrame:
        """frame with the references of a page's layout and of its host."""
        listed = F.sort_array(F.collect_list(F.struct(*(c for c in shapes.columns if c not in ("host", "layout")))))
        own = scratch.table(shapes.where("layout is not null").groupBy("host", "layout").agg(listed.alias("refs")), "own")
        wide = scratch.table(shapes.where("layout is null").groupBy("host").agg(listed.alias("wide")), "wide")
        return frame.join(near(own), ["host", "layout"], "left").join(near(wide), "host", "left")

    votes = joined(pages_seen.select("host", "layout", "content", "blob"), shapes).select("host", "layout", "content", "blob", "refs", "wide")
    votes = votes.mapInArrow(_support(cfg), "host string, ref long, node int, same boolean, content long")
    # each content once: whether any page with it had the node's text
    once = votes.groupBy("host", "ref", "node", "content").agg(F.max("same").alias("same"))
    counted = once.groupBy("host", "ref", "node").agg(F.count_if("same").alias("same"), F.count(F.lit(1)).alias("all"))
    fixed = counted.where((F.col("same") >= cfg.least_pages) & (F.col("same") >= cfg.share * F.col("all")))
    fixed = scratch.table(fixed.groupBy("host", "ref").agg(F.collect_list("node").alias("nodes")), "wrappers")
    # hosts with template nodes only; what a page is aligned with must be chosen among all references
    known = shapes.join(fixed.select("host").distinct(), "host", "left_semi").join(fixed, ["host", "ref"], "left")
    out = joined(rows.withColumn("layout", layout_of(F.col("html"))), known).select("page_id", "url", "host", "layout", "html", "refs", "wide")
    return out.mapInArrow(_extract(cfg), "page_id long, url string, text string, n_chars long")
