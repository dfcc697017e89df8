"""Main text of web pages by tree scoring.

A page is read into a light tree. What is never article text (scripts, styles, controls, hidden elements, reader comments, adverts, notices about
cookies and the like) is left out; elements whose tag, role, class or id says menu, header, footer, sidebar, form or such are suspects. A suspect is left out
too, unless it holds most of the page's prose while no article stands elsewhere: a form around the whole page, a layout named after its sidebar. Where the
names leave next to nothing of the prose, weak ones (widget, banner, ...) don't count.

Every block of text passes points for its length and its commas to its ancestors, less with each step up, and an element's points are discounted by the share of its
text that is links. ``article`` and ``main`` are containers by intent: they get the points of all blocks in them undiminished and some more (``main`` half of what
lies in articles of its own), so the title beside the paragraphs' own container isn't lost; they win by points alone, and lose where the text is elsewhere. The best
container is kept, with siblings that score a fifth of it or read like prose. Lists of links in it are kept, but where they follow a heading like "Related",
lead to places on the page, or stand at an end of the container without words that lead to them.

The result is the container's blocks in page order: character references decoded, white space inside a block
turned into one space, trimmed, joined by a blank line. Defined cases: a null or empty page, or one without text
blocks, gives an empty text; unclosed and stray tags are tolerated as browsers do; nothing is cut off or capped;
further columns are ignored by ``extract`` but for those named in ``keys``. Each page is worked on alone, in time that grows with its length whatever its depth, so memory
is bounded by the longest page; ties between containers go to the first in page order, and repeated pages give repeated rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = set("script style textarea title noscript noembed noframes xmp iframe template".split())
NEVER = set("head object embed applet canvas svg math audio video button select option optgroup input label datalist map".split())
ASIDE = set("nav menu header footer aside dialog".split())
IN_HEAD = set("base link meta title script style noscript template".split())
PARAGRAPH = set("p pre li td blockquote dd h1 h2 h3 h4 h5 h6".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
LIST = set("ul ol table dl".split())
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
P_SCOPE = {"table", "td", "th", "li", "caption", "button", "div", "section", "article", "main", "blockquote"}
# Roles and words of class and id that mark what is not the article.
ROLES = set("navigation banner contentinfo complementary dialog alertdialog alert menu menubar toolbar status tooltip".split())
FORM_ROLES = {"search", "form"}
MARKS = set(
    "nav navbar navigation menu header masthead footer sidebar aside widget ad ads advert adverts advertisement adsense sponsor sponsored promo"
    " promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup"
    " login share sharing social related recommended comment comments disqus respond reply replies breadcrumb breadcrumbs pagination pager"
    " toolbar skip dropdown toc".split()
)
STRONG = set("comment comments cookie cookies sidebar sidenav advert adverts advertisement adsbygoogle newsletter breadcrumb breadcrumbs disqus sponsored pagination footer navbar".split())
STRONG_STARTS = ("commentlist", "commentform", "commentbody", "commentarea", "sidebar", "cookiebar", "cookiebanner", "cookienotice", "advertis", "adslot", "adbanner", "navbar", "sharebuttons", "relatedposts", "newsletter")
# Words that also name layouts around an article; of these, words that also name parts of one.
LAYOUT = set("nav navbar navigation menu header masthead footer sidebar sidenav aside widget promo promotion banner notice notification alert popup modal overlay toolbar skip dropdown toc".split())
WEAK = set("header masthead widget promo promotion banner notice notification alert modal overlay toolbar".split())
NEGATED = {"has", "with", "no", "without", "is", "not", "hide", "show"}
NEVER_BY_CLASS = {"html", "body", "main"}
RELATED = re.compile(r"(?:related|more (?:from|in|on|stories|articles|news)|read (?:more|next|also)|recommended|popular|most read|trending|latest|you (?:may|might)|share|tags?|categories|contents|table of contents|menu|navigation)\b", re.I)

#: Whether an element is left out: not, by its class or as a form or an aside unless it holds the article, by a class that says so, always.
FREE, CLASS, FORM, TAG, HARD, GONE = range(6)
#: Characters of a run of text from which on it is prose, and of prose that make an article.
RUN, ARTICLE = 25, 140
#: Steps up that a block's points reach.
STEPS = 6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^<>])*+)>|<[!?/][^<>]*+>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "kids", "order", "link", "mark", "weak", "by_class", "anchor", "prose", "links", "places", "dead", "points", "total", "nested", "chars", "linked", "kept", "cut")

    def __init__(self, tag: str, parent: Node | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.kids: list[Node | str] = []
        self.link = tag == "a" or parent is not None and parent.link
        self.mark, self.weak, self.by_class = FREE, False, False
        self.anchor = tag in ("article", "main")
        self.prose = self.links = self.places = self.chars = self.linked = 0  # of the whole element, once summed up
        self.points = self.total = self.nested = 0.0
        self.dead = self.kept = self.cut = False

    def score(self) -> float:
        return self.points * (1 - self.linked / self.chars) if self.chars else 0.0


def _class_mark(words: str) -> tuple[int, bool]:
    """What a class or id says, and whether it says so by weak words only: a strong mark in one of its names, or another mark that begins or ends it."""
    found: set[str] = set()
    for name in words.split():
        parts = [p.lower() for p in _PART.findall(name)]
        cut = next((i for i, p in enumerate(parts) if p in NEGATED), len(parts))
        found |= {p for p in parts[:cut] if p in STRONG or p.startswith(STRONG_STARTS)}
        if cut == len(parts) and parts:
            found |= {p for p in (parts[0], parts[-1]) if p in MARKS}
    if not found:
        return FREE, False
    return (CLASS if all(w in LAYOUT or w.startswith(("sidebar", "navbar")) for w in found) else HARD), found <= WEAK


def _mark(node: Node, attrs: str) -> None:
    tag = node.tag
    node.mark = GONE if tag in NEVER else TAG if tag in ASIDE else FORM if tag == "form" else FREE
    if node.mark == GONE or not attrs.strip():
        return
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
    if tag == "a":
        node.links, node.places = 1, int(found.get("href", "").startswith("#"))
    if tag in ("html", "body"):
        return
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        node.mark = GONE
        return
    roles = set(found.get("role", "").lower().split())
    node.anchor |= "main" in roles
    if roles & ROLES:
        node.mark = max(node.mark, TAG)
    elif roles & FORM_ROLES:
        node.mark = max(node.mark, FORM)
    if tag in NEVER_BY_CLASS:
        return
    words = f"{found.get('class', '')} {found.get('id', '')}"
    if tag == "article":
        own, weak = (HARD, False) if "comment" in words.lower() else (FREE, False)
    else:
        own, weak = _class_mark(words)
    if own > node.mark:
        node.by_class = node.mark == FREE
        node.mark, node.weak = own, weak


def parse(page: str) -> list[Node]:
    """The page's elements in page order, the root first."""
    root = Node("#root", None, 0)
    nodes, stack, open_tags, at = [root], [root], Counter(), 0

    def close(tags: set[str], scope: set[str]) -> None:
        """Closes the innermost open element of these tags, unless one of scope stands above it."""
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for n in stack[i:]:
                    open_tags[n.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            top = stack[-1]
            top.kids.append(text)
            size = len(text.strip())
            if size >= RUN and not top.link:
                top.prose += size
        if not m:
            return nodes
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag}, {"table"} - {tag} if tag not in BLOCK else set())
            continue
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            if end:
                at = end.end()
            elif tag != "title" and tag != "noscript":
                at = len(page)
            continue
        if open_tags["head"] and tag not in IN_HEAD:
            close({"head"}, set())
        if tag in BLOCK:
            close({"p"}, P_SCOPE)
        if tag in CLOSED_BY_SAME:
            close(CLOSED_BY_SAME[tag], SCOPE[tag])
        if tag in VOID:
            stack[-1].kids.append("\x00" if tag == "hr" else " ")
            continue
        node = Node(tag, stack[-1], len(nodes))
        _mark(node, m[3])
        nodes.append(node)
        stack[-1].kids.append(node)
        if not m[3].endswith("/") or tag in BLOCK or tag == "a":
            stack.append(node)
            open_tags[tag] += 1


def leave_out(nodes: list[Node]) -> None:
    """Says of each element whether it is left out."""
    own = [n.prose for n in nodes]
    holds = [0] * len(nodes)  # articles in each element
    for n in reversed(nodes):
        n.anchor &= n.mark < HARD and n.prose >= ARTICLE
        if n.parent is not None:
            n.parent.links += n.links
            n.parent.places += n.places
            if n.mark < HARD:
                n.parent.prose += n.prose
                holds[n.parent.order] += holds[n.order] + n.anchor
    total = nodes[0].prose
    suspect, above = [False] * len(nodes), [0] * len(nodes)  # whether in or at a suspect; articles in no suspect that it lies in
    for n in nodes[1:]:
        suspect[n.order] = suspect[n.parent.order] or n.mark != FREE
        above[n.order] = above[n.parent.order] + (n.parent.anchor and not suspect[n.parent.order])
    free = sum(n.anchor and not s for n, s in zip(nodes, suspect))
    for n in nodes[1:]:
        n.dead = n.parent.dead or n.mark != FREE
        if not n.parent.dead and FREE < n.mark < HARD and free == above[n.order] and n.prose >= ARTICLE:
            most = 2 * n.prose >= total
            n.dead = not (most if n.mark == CLASS else most or holds[n.order] > 0 if n.mark == FORM else most and holds[n.order] > 0)
    left = [x * (not n.dead) for n, x in zip(nodes, own)]
    for n in reversed(nodes[1:]):
        left[n.parent.order] += left[n.order]
    if 4 * left[0] < total and not any(n.anchor and left[n.order] >= ARTICLE for n in nodes):
        revived: set[int] = set()
        for n in nodes[1:]:  # names that leave nothing are not to be trusted
            if n.dead and (n.parent.order in revived and n.mark == FREE or not n.parent.dead and n.mark == CLASS and n.weak and n.prose >= RUN):
                n.dead = False
                revived.add(n.order)


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(owner, text, linked characters) of each run of text between block boundaries, in page order."""
    found: list[tuple[Node, str, int]] = []
    run: list[str] = []
    linked = 0
    owner = root

    def flush() -> None:
        nonlocal run, linked
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            found.append((owner, text, min(linked, len(text))))
        run, linked = [], 0

    holders = [root]  # open blocks
    todo: list = [(root, 0)]  # element, next child
    while todo:
        node, k = todo.pop()
        block = node.tag in BLOCK or node is root
        if k == 0 and block:
            flush()
            owner = node
            if node is not root:
                holders.append(node)
        ended = True
        for k in range(k, len(node.kids)):
            kid = node.kids[k]
            if isinstance(kid, str):
                if kid == "\x00":
                    flush()
                else:
                    run.append(kid)
                    linked += len(kid.strip()) * node.link
            elif kid.dead:
                if kid.tag in BLOCK:
                    flush()
            else:
                todo += [(node, k + 1), (kid, 0)]
                ended = False
                break
        if ended and block:
            flush()
            if node is not root:
                holders.pop()
            owner = holders[-1]
    return found


def _container(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> Node:
    """The best container, with points, characters and links of all elements summed up."""
    for owner, text, linked in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= RUN else 0.0
        owner.chars += len(text)
        owner.linked += linked
        owner.total += points
        node, step = (owner.parent or owner) if owner.tag in PARAGRAPH else owner, 0
        while node is not None and step < STEPS:
            node.points += points / (1, 2)[step] if step < 2 else points / (3 * step)
            node, step = node.parent, step + 1
    best = None
    for n in reversed(nodes):
        if n.tag == "article":
            n.points = max(n.points, 1.25 * n.total + 25 * (n.total > 0))
        elif n.anchor or n.tag == "main":
            n.points = max(n.points, 1.1 * (n.total - n.nested) + n.nested / 2 + 10 * (n.total > n.nested))
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.total += n.total
            n.parent.nested += n.total if n.tag == "article" else n.nested
        if n.chars and not n.dead and (best is None or n.score() >= best.score()):
            best = n
    return best


def _keep(nodes: list[Node], top: Node) -> None:
    """Marks the container, its siblings that belong to it, and all in them."""
    tops = {top.order}
    if top.parent is not None:
        least = max(10.0, top.total * (1 - top.linked / top.chars) / 5)
        named = top.tag in ("article", "main")
        for kid in top.parent.kids:
            if isinstance(kid, Node) and kid is not top and kid.tag in BLOCK and kid.chars and not kid.dead:
                share = kid.linked / kid.chars
                prose = kid.tag == "p" and (kid.chars > 80 and share < 0.25 or share == 0 and not named)
                if min(kid.points, kid.total) * (1 - share) >= least or prose or kid.tag in ("h1", "h2") and kid.order < top.order and not named and not share:
                    tops.add(kid.order)
    for n in nodes:
        n.kept = n.order in tops or n.parent is not None and n.parent.kept


def _cut_lists(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> set[int]:
    """Marks lists of links that are navigation, and gives the blocks that head them."""
    lists = [n for n in nodes if n.kept and not n.dead and n.tag in LIST and n.chars and n.linked >= 0.7 * n.chars]
    if not lists:
        return set()
    inner = {n.order for n in lists}
    inside: dict[int, Node] = {}  # the outermost such list that each element lies in
    for n in nodes:
        if n.parent is not None and n.parent.order in inside:
            inside[n.order] = inside[n.parent.order]
        elif n.order in inner:
            inside[n.order] = n
    span: dict[int, list[int]] = {}
    for i, (owner, _, _) in enumerate(blocks):
        if owner.order in inside:
            span.setdefault(inside[owner.order].order, [i, i])[1] = i
    prose = [i for i, (owner, text, linked) in enumerate(blocks) if owner.order not in inside and len(text) >= RUN and 2 * linked < len(text) and owner.tag not in HEADING]
    heads: set[int] = set()
    if not prose:
        return heads
    for order, (first, last) in span.items():
        n = nodes[order]
        before = blocks[first - 1] if first and blocks[first - 1][0].order not in inside else None
        related = before is not None and len(before[1]) < 80 and (before[0].tag in HEADING or before[1].endswith(":")) and RELATED.match(before[1])
        led = before is not None and (before[0].tag in HEADING or before[1].endswith(":"))
        if related or 2 * n.places > n.links or last > prose[-1] and not led or first < prose[0] and not led:
            n.cut = True
            if related and before[0].tag in HEADING:
                heads.add(first - 1)
    for n in nodes:
        n.cut |= n.parent is not None and n.parent.cut
    return heads


def main_text(page: str | None) -> str:
    """The page's main text, or an empty string."""
    if not page:
        return ""
    nodes = parse(page.replace("\x00", ""))
    leave_out(nodes)
    blocks = _blocks(nodes[0])
    if not blocks:  # some layouts name the article's own element after what stands beside it
        for n in nodes[1:]:
            n.dead = n.parent.dead or n.mark != FREE and not n.by_class
        blocks = _blocks(nodes[0])
    if not blocks:
        return ""
    _keep(nodes, _container(nodes, blocks))
    blocks = [b for b in blocks if b[0].kept]
    heads = _cut_lists(nodes, blocks)
    return "\n\n".join(text for i, (owner, text, _) in enumerate(blocks) if not owner.cut and i not in heads)


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keys, text and n_chars of every page."""
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

    return pages.select(*keys, html).mapInArrow(work, schema)
