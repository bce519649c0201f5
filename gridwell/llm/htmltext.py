"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with the path of tags from the
root. Text length and punctuation per node are summed up by path: the paragraphs
of an article share a path, so a short one is judged with the long ones. Both
ratios are smoothed over neighbouring paths and fused, and paths above a share
of the greatest are content nodes.

Tags, roles and words in a class or id by which a part says of itself that it
isn't the article are a prior: each divides the ratio of what stands in it.
Where all of a page stands in such an element, or most of its fused text does,
that tells nothing apart, and the ratios alone decide.

The article is the deepest element that holds nearly all of the content nodes,
weighed by their ratios, with the headline in front of it. Its headings, lists, tables and other
short blocks are its text too, but for marked parts that aren't content nodes.
Where only the body holds it, it reaches from the headline to the end of the
last content node.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<([/!?]?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*)>?|<[/!?][^>]*>?""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAMED = re.compile(r"(?:class|id|role|hidden|aria-hidden|itemprop|style)", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var nobr wbr br img ruby rb rt rp".split())
#: Their content isn't markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: What stands in them isn't shown as text, or belongs to a form's controls.
UNSEEN = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math canvas object audio video button select option input datalist label".split())
#: Elements for parts beside an article.
BESIDE = frozenset("nav footer aside menu dialog form fieldset".split())
#: Words in a role, class or id that tell a part which isn't the article.
OTHER = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr
    notice notices notification alert disclaimer sidebar aside menu menus nav navbar navigation navigational breadcrumb breadcrumbs footer foot header masthead
    comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe
    subscription signup login popup modal overlay widget widgets toolbar pagination pager search form complementary contentinfo
    dialog tags skip""".split()
)
#: What they say of themselves may hold for parts of a page only, as words in a class or id do.
MILD = frozenset("form fieldset".split())
#: Elements that may stand in a head; any other one ends it.
HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
#: Before such a word, in "has-sidebar", it tells nothing of this element.
ABOUT = frozenset("has with no without not is".split())
ROOTS = frozenset("html body main article".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("html body main article section div table ul ol dl td th blockquote".split())
#: What an element's mark leaves of the ratios in it.
PRIOR = 0.02
#: Share of the greatest fused ratio that makes a path content: above what smoothing lends a neighbour.
LEAST = 0.3
#: Share of the content nodes' ratios that the article's element holds.
SHARE = 0.75
#: How far the greatest fused ratio of an element without a headline must stand above the rest's.
ABOVE = 3
#: A page whose content is all marked has an article only if that reads like one: mean letters, and punctuation marks.
LETTERS, MARKS = 40, 3
#: Marks by a word or as a form that are looked at above a block, outermost first.
MOST_WORDS = 8
NOT, BY_WORD, BY_TAG, HIDDEN = range(4)
HEADINGS = ("h1", "h2", "h3")
#: Elements that only text is divided by: they don't part the page.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address hr".split())


def is_other(name: str, attributes: str) -> int:
    """Whether an element says of itself that it isn't part of the article: NOT;
    BY_WORD or as a form; BY_TAG or role; HIDDEN: nothing in it is shown as text."""
    found = HIDDEN if name in UNSEEN else NOT if name not in BESIDE else BY_WORD if name in MILD else BY_TAG
    if not attributes or name in ROOTS or not NAMED.search(attributes):
        return found
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return HIDDEN
        if key in ("class", "id", "role"):
            words = re.split(r"[^a-z]+", value)
            if any(w in OTHER and not (k and words[k - 1] in ABOUT) for k, w in enumerate(words)):
                found = max(found, BY_TAG if key == "role" and value not in MILD else BY_WORD)
    return found


class Page:
    """The elements of a page, numbered in order from 1 on (0: the page itself),
    and its blocks of text.

    Of each element: its name, parent, depth, path (a number for each different
    row of tags and classes from the root), the last element in it, whether it's
    hidden, the heading that it stands in, how many marks by tag and which by word
    are around it. Nothing is held for each block and ancestor, so depth costs no
    more than length does.
    """

    def __init__(self):
        self.name, self.parent, self.depth, self.path, self.last = [""], [0], [0], [0], [0]
        self.hidden, self.tags, self.words, self.heading = [False], [0], [()], [""]
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[int] = []
        self.texts: list[str] = []

    def add(self, name: str, label: str, parent: int, mark: int) -> int:
        number = len(self.name)
        self.name.append(name)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        self.last.append(number)
        self.hidden.append(self.hidden[parent] or mark == HIDDEN)
        self.heading.append(name if name in HEADINGS else self.heading[parent] if name in TEXT or name in INLINE else "")
        self.tags.append(self.tags[parent] + (mark == BY_TAG))
        words = self.words[parent]
        self.words.append((*words, number) if mark == BY_WORD and len(words) < MOST_WORDS else words)
        return number

    def holds(self, element: int, node: int) -> bool:
        return element <= node <= self.last[element]

    def above(self, node: int):
        """node and its ancestors, innermost first."""
        while node:
            yield node
            node = self.parent[node]

    def within(self, node: int, element: int):
        """node and its ancestors below element, innermost first."""
        while node > element:
            yield node
            node = self.parent[node]

    def common(self, a: int, b: int) -> int:
        """The deepest element that holds both."""
        while not self.holds(a, b):
            a = self.parent[a]
        return a


def read_page(page: str) -> Page:
    """Runs of text between block elements, in page order, with white space made one.

    Text of a marked inline element is a block of its own, after the run
    that it stands in; the run goes on behind it.
    """
    out = Page()
    #: name, number, the block elements' part of the stack up to here, whether an inline element behind that is marked
    stack: list[tuple[str, int, int, bool]] = []
    there: dict[str, int] = {}  # open elements of a name
    parts: list[str] = []
    aside: list[str] = []  # text of the marked inline elements that are open now
    asides: list[tuple[int, str]] = []
    at = 0

    def text_of(texts: list[str]) -> str:
        text = " ".join(entities.unescape("".join(texts)).split())
        texts.clear()
        return text

    def run() -> int:
        """Where the inline elements at the end of the stack begin."""
        return stack[-1][2] if stack else 0

    def set_aside() -> None:
        if aside and (text := text_of(aside)):
            asides.append((stack[-1][1] if stack else 0, text))

    def flush() -> None:
        set_aside()
        if parts and (text := text_of(parts)):
            k = run()
            out.nodes.append(stack[k - 1][1] if k else 0)
            out.texts.append(text)
        for node, text in asides:
            out.nodes.append(node)
            out.texts.append(text)
        asides.clear()

    def close(k: int) -> None:
        for name, number, _, _ in stack[k:]:
            out.last[number] = len(out.name) - 1
            there[name] -= 1
        del stack[k:]

    def leave_head() -> None:
        if there.get("head"):
            flush()
            close(next(k for k, x in enumerate(stack) if x[0] == "head"))

    def add(text: str) -> None:
        if stack and stack[-1][0] == "head" and not text.isspace():
            leave_head()
        (aside if stack and stack[-1][3] else parts).append(text)

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        kind, name = m[1], m[2]
        if name is None or kind in ("!", "?"):
            continue
        name = name.lower()
        if kind == "/":
            if not there.get(name):
                if name not in INLINE:
                    flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if k < run():
                        flush()
                    else:
                        set_aside()
                    close(k)
                    break
                if name in INLINE and stack[k][0] in FENCES:
                    break
            continue
        if name == "body" or (stack and stack[-1][0] == "head" and name not in HEAD):
            leave_head()
        if name == "br":
            add(" ")
            continue
        mark = is_other(name, m[3])
        # an inline element counts if it is marked, or for its end tag in a marked one of its name
        if name in INLINE and not mark and (name in VOID or not there.get(name)):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
            if end and (shut := page.find(">", at)) >= 0:
                at = shut + 1
            elif end:
                at = size
            if name not in ("script", "style"):
                flush()
            continue
        if name not in INLINE:
            flush()
        elif name not in VOID:
            set_aside()
        if name in VOID:
            continue
        if name not in INLINE:
            shut = CLOSES.get(name, ())
            if there.get("p") or any(there.get(x) for x in shut):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] in shut:
                        close(k)
                        break
                    if stack[k][0] in FENCES and stack[k][0] not in shut:
                        break
        label = re.search(r"""class\s*=\s*["']?([^"'>]*)""", m[3]) if m[3] else None
        # a marked element's path is its own
        label = f"{name}.{label[1].strip() if label else ''}{'!' * mark}" if label or mark else name
        number = out.add(name, label, stack[-1][1] if stack else 0, mark)
        there[name] = there.get(name, 0) + 1
        if name in INLINE:
            stack.append((name, number, run(), bool(mark) or bool(stack and stack[-1][3])))
        else:
            stack.append((name, number, len(stack) + 1, False))
    flush()
    close(0)
    out.last[0] = len(out.name) - 1
    return out


def smoothed(x: np.ndarray) -> np.ndarray:
    """Each path's value with a quarter of its neighbours'."""
    wide = np.concatenate([x[:1], x, x[-1:]])
    return (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4


def ratios(page: Page, seen: list[int]) -> np.ndarray:
    """The fused ratio of the path of each of these blocks."""
    number: dict[int, int] = {}
    at = np.array([number.setdefault(page.path[page.nodes[i]], len(number)) for i in seen])
    nodes, letters = np.bincount(at), np.array([len(page.texts[i]) for i in seen])
    total = np.bincount(at, letters)
    points = np.bincount(at, [len(PUNCTUATION.findall(page.texts[i])) for i in seen]) / nodes
    # text that has sentences counts for more than text that has none
    return (smoothed(total / nodes) * (1 + smoothed(points)) * np.log2(1 + total))[at]


def cleared(page: Page, seen: list[int], weight: np.ndarray) -> set[int]:
    """The elements marked by a word, or forms, whose word isn't taken: those that
    hold most of the page's fused text.

    An element is judged against what stands outside of it and isn't marked. It
    must hold more, and either a first heading or, where no other article or main
    element has text, by far the greatest ratio: comments under a short article
    stay comments. Those with a first heading come first, then the largest.
    """
    inside: dict[int, list[int]] = {}
    titled: set[int] = set()
    free: list[int] = []  # blocks without a mark by tag
    for i, block in enumerate(seen):
        node = page.nodes[block]
        if not page.tags[node]:
            free.append(i)
            for e in page.words[node]:
                inside.setdefault(e, []).append(i)
            if page.words[node] and page.heading[node] == "h1":
                titled.update(page.words[node])
    if not inside:
        return set()
    texts = np.unique([page.nodes[seen[i]] for i in free])
    articles = [e for e, n in enumerate(page.name) if n in ("article", "main") and np.searchsorted(texts, e) < np.searchsorted(texts, page.last[e], side="right")]
    holds = {e: weight[of].sum() for e, of in inside.items()}
    done: set[int] = set()
    waiting = sorted(inside, key=lambda e: (e not in titled, -holds[e], e))[: 4 * MOST_WORDS]
    outside = [i for i in free if not page.words[page.nodes[seen[i]]]]
    rest = weight[outside].sum()
    k = 0
    while k < len(waiting):
        e = waiting[k]
        k += 1
        around = page.words[page.parent[e]]
        if holds[e] <= rest or not done.issuperset(around):
            continue  # not the most, or an element around it is marked
        article = any(not page.holds(a, e) and not page.holds(e, a) for a in articles)
        if e in titled or (not article and weight[inside[e]].max() >= ABOVE * weight[outside].max(initial=0)):
            done.add(e)
            waiting.remove(e)
            outside = [i for i in free if done.issuperset(page.words[page.nodes[seen[i]]])]
            rest = weight[outside].sum()
            k = 0  # what stands in it is judged next
    return done


def place(page: Page, seen: list[int], picked: np.ndarray, value: np.ndarray) -> int:
    """The element that holds nearly all of the content nodes, each weighed by its ratio."""
    own, heavy = np.zeros(len(page.name)), np.zeros(len(page.name), np.int64)
    for i in np.flatnonzero(picked):
        own[page.nodes[seen[i]]] += value[i]
    own = own.tolist()
    heavy = heavy.tolist()
    for n in range(len(own) - 1, 0, -1):  # an element's number is above its parent's
        p = page.parent[n]
        own[p] += own[n]
        if own[n] and (not heavy[p] or own[n] >= own[heavy[p]]):
            heavy[p] = n
    title = next((page.nodes[i] for i in seen if page.heading[page.nodes[i]] == "h1"), 0)
    at = 0
    while n := heavy[at]:
        if own[n] < SHARE * own[at]:
            # the part with the headline, if its ratios are the greatest and what is
            # content elsewhere doesn't stand in such elements as its own does
            n = next((x for x in page.within(title, at) if page.parent[x] == at), 0) if page.holds(at, title) else 0
            if not n or not own[n] or page.name[n] in TEXT:
                break
            rest = [k for k in np.flatnonzero(picked) if page.holds(at, page.nodes[seen[k]]) and not page.heading[page.nodes[seen[k]]]]
            inner = [k for k in rest if page.holds(n, page.nodes[seen[k]])]
            outer = [k for k in rest if not page.holds(n, page.nodes[seen[k]])]
            names = {page.name[page.nodes[seen[k]]] for k in inner}
            if not inner or value[inner].max() <= value[outer].max(initial=0) or any(page.name[page.nodes[seen[k]]] in names for k in outer):
                break
        if page.name[n] in TEXT or page.name[n] in INLINE:
            break
        at = n
    # an article or main element among those above is the article
    return next((x for x in page.above(at) if page.name[x] in ("article", "main")), at)


def head(page: Page, blocks: list[int], first: int, root: int, whole: bool) -> int:
    """Where the headline of an article is that is found from blocks[first] on.

    That is the last h1 in front of it or, without one, the last h2 or h3 that
    stands beside it, alone or in a header. An article that begins with a heading
    takes a greater one only from what surrounds both of them.
    """
    node = lambda i: page.nodes[blocks[i]]
    if any(page.heading[node(i)] == "h1" for i in range(first, len(blocks)) if whole or page.holds(root, node(i))):
        return first
    begins, lower = page.heading[node(first)], None
    for i in range(first - 1, -1, -1):
        if not (h := page.heading[node(i)]):
            continue
        n = page.common(root, node(i))
        near = page.name[n] not in ("", "html", "body")
        if h == "h1" and (near or not begins or (whole and all(page.name[x] != "header" for x in page.above(node(i))))):
            return i
        if lower is None and h != "h1" and (not begins or (near and h < begins)):
            around = [page.name[x] for x in page.within(node(i), n)][::-1]
            top = next((x for x in page.within(node(i), n) if page.parent[x] == n), node(i))
            if all(x in ("header", "hgroup") for x in around[: around.index(h)]) or all(page.heading[node(j)] for j in range(len(blocks)) if page.holds(top, node(j))):
                lower = i
    return first if lower is None else lower


def tail(page: Page, blocks: list[int], last: int) -> int:
    """The last block of the text that goes on, not parted off, after blocks[last]."""
    above, end = page.nodes[blocks[last]], last
    for i in range(last + 1, len(blocks)):
        node = page.nodes[blocks[i]]
        n = page.common(above, node)
        if not all(page.name[x] in TEXT or page.name[x] in INLINE for x in page.within(node, n)):
            break
        end = i
    return end


def content(page: Page) -> list[int]:
    """The blocks of the article."""
    seen = [i for i, n in enumerate(page.nodes) if not page.hidden[n]]
    if not seen:
        return []
    fused = ratios(page, seen)
    done = cleared(page, seen, fused)
    marks = np.array([page.tags[n] + sum(e not in done for e in page.words[n]) for n in (page.nodes[i] for i in seen)])
    value = fused * PRIOR ** (marks - marks.min())
    picked = value >= LEAST * value.max()
    if marks[picked].min():  # all of it is marked
        chosen = [page.texts[i] for i, k in zip(seen, picked, strict=True) if k]
        if sum(map(len, chosen)) < LETTERS * len(chosen) or sum(len(PUNCTUATION.findall(t)) for t in chosen) < MARKS:
            return []
    root = place(page, seen, picked, value)
    whole = page.name[root] in ("", "html", "body")
    least = marks[[k for k, i in enumerate(seen) if page.holds(root, page.nodes[i])]].min()
    kept = [k for k in range(len(seen)) if picked[k] or marks[k] <= least]
    blocks, chosen = [seen[k] for k in kept], picked[kept]
    inside = [k for k, i in enumerate(blocks) if (chosen[k] if whole else page.holds(root, page.nodes[i]))]
    end = tail(page, blocks, inside[-1]) if whole else inside[-1]
    first = inside[0] if page.name[root] in ("article", "main") else head(page, blocks, inside[0], root, whole)
    # where the article is the body's, other headings of the page are kept too
    return [
        i for k, i in enumerate(blocks)
        if (first <= k <= end and (whole or k < inside[0] or page.holds(root, page.nodes[i]))) or (whole and page.heading[page.nodes[i]])
    ]


def main_text(page: str) -> str:
    """The article's blocks with an empty line between them; empty if there is none."""
    read = read_page(page)
    return "\n\n".join(read.texts[i] for i in content(read))


def extracted(pages: DataFrame, carry: list[str], page: str = "html") -> DataFrame:
    """Columns carry with text and n_chars.

    A null, empty or markup-free page is handled like any other: without text the
    result is empty, plain text is one block. Broken and unfinished markup is
    read as far as it goes. A page's time grows with its length, however deep its
    elements are. Rows are independent; repeated ones stay, an empty table stays
    empty, and columns other than carry and the page are left out.
    """

    def make():
        def of(t: str):
            text = main_text(t)
            return text, len(text)

        return of

    return per_text(pages, carry, page, "text string, n_chars long", make)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), ["page_id", "url"])
