"""Helpers for pages: HTML to marked lines of text, and the longest common subsequence."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

ARTICLE, MAIN, OPEN, BOILERPLATE = range(4)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
# Elements whose text is never the main text.
SKIPPED = set(
    "applet aside audio button canvas datalist dialog embed footer head iframe menu nav "
    "noscript object script search select style svg template textarea title video".split()
)
SKIPPED_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)
# Words in classes and ids that name what is no main text, and those that only go along with them.
# A name counts if all its words are among these and one is of the first kind: "social-share" does,
# "share-price" or "related-work" doesn't.
SKIPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner banners promo promos promotion "
    "sponsor sponsored sponsors sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay "
    "newsletter subscribe subscription signup login comment comments commentlist disqus replies respond "
    "share sharing social related recommended footer masthead toolbar pagination pager widget widgets "
    "copyright disclaimer skiplink".split()
)
COMPANION_WORDS = set(
    "a area bar block bottom box btn button buttons col column container content form global group header "
    "icons inner item items js left link links list main message outer page panel post posts primary right "
    "row secondary section site skip slot small stories sub thread top unit up wrap wrapper".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus replies respond".split())
CONTENT_WORDS = set(
    "content main article entry post story body page wrap wrapper container layout column columns".split()
)
# Blocks that are text themselves, whatever they are called.
TEXT_BLOCKS = set("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
# Names that say what a layout has or lacks, not what it is.
LAYOUT_NAMES = re.compile(r"(?:^|(?<=\s))(?:no|not|without|has|with|hide)-\S+", re.IGNORECASE)
WORDS = re.compile(r"[a-z0-9]+")
COMMENT_END = re.compile(r"--!?>")
NAME = re.compile(r"/?\s*([a-zA-Z][^\s/>]*)")
TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")

# What comes next in a tag: its end, or an attribute up to a quote that opens its value.
TAG_PART = re.compile(r"[\s/]*(?:(>)|(?:=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*(?:([\"'])|[^\s>\"'][^\s>]*)?)?)")


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """Place of the > that ends a tag whose name ends before ``at``, whatever its quoted values hold;
    -1 if a quote or the tag never closes. ``failed`` keeps the places from which there is no end,
    so that none is passed twice."""
    passed = []
    while at not in failed:
        passed.append(at)
        part = TAG_PART.match(page, at)
        if not part:
            break
        if part[1]:
            return part.end() - 1
        at = part.end()
        if part[2]:
            at = page.find(part[2], at) + 1
            if not at:
                break
    failed.update(passed)
    return -1


def _attributes(tag: str) -> dict[str, str]:
    return {
        name.lower(): a or b or c for name, a, b, c in reversed(ATTRIBUTE.findall(tag))
    }


# What marks an element as no main text: nothing; a form, or names of which one is for content; other
# names; names of comments.
UNMARKED, DOUBTFUL, NAMED, COMMENTS = range(4)


def _mark(names: str, headers: bool) -> int:
    mark, content = UNMARKED, False
    for name in LAYOUT_NAMES.sub("", names).lower().split():
        words = set(WORDS.findall(name))
        content |= bool(words & CONTENT_WORDS)
        skipped = words & SKIPPED_WORDS or (headers and "header" in words)
        if not skipped or words - SKIPPED_WORDS - COMPANION_WORDS:
            continue
        if words & COMMENT_WORDS:
            return COMMENTS
        mark = NAMED
    return DOUBTFUL if mark and content else mark


def _kind(name: str, tag: str, inside: int) -> tuple[int, int]:
    """What text in this element is, given what its parent's is, and how the element is marked."""
    if inside == BOILERPLATE or name in SKIPPED:
        return BOILERPLATE, UNMARKED
    if name == "header" and inside != ARTICLE:
        return BOILERPLATE, UNMARKED
    mark = DOUBTFUL if name == "form" else UNMARKED
    if "=" in tag or "hidden" in tag:
        found = _attributes(tag[len(name) :])
        role, style = found.get("role", "").lower(), found.get("style", "").replace(" ", "")
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if name not in ("html", "body", "article", "main") or inside == ARTICLE:
            if (
                role in SKIPPED_ROLES
                or "hidden" in found
                or found.get("aria-hidden") == "true"
                or "display:none" in style
            ):
                return BOILERPLATE, UNMARKED
            if name not in TEXT_BLOCKS:
                mark = max(mark, _mark(names, headers=inside != ARTICLE))
        elif name == "article":
            mark = _mark(names, headers=False)
        if role == "article" or found.get("itemprop") == "articleBody":
            return ARTICLE, mark
        if role == "main":
            return min(inside, MAIN), mark
    if name == "article":
        return ARTICLE, mark
    return min(inside, MAIN) if name == "main" else inside, mark


# A stretch of text in one element: what it is, and the innermost marked element around it.
State = tuple[int, int]


def _without_marked(
    lines: list[tuple[list[tuple[str, State]], State]], wrappers: list[tuple[int, int, bool]]
) -> list[tuple[str, int]]:
    """Blocks as lines with their kinds, without what stands in marked elements inside them; blocks
    in marked elements are boilerplate.

    The mark of an element that holds more than half of the page's text is passed over where no
    article or main part stands outside marked elements, if the element holds one or the mark is
    doubtful: it is the layout. In an article, the same goes for an element with a doubtful mark
    and more than half of the article's text. ``wrappers`` has the element around each (-1 for
    none), its mark and whether it is in an article.
    """
    text, article = 0, 0
    held, parts = [0] * len(wrappers), [False] * len(wrappers)
    for pieces, _ in lines:
        for piece, (kind, at) in pieces:
            if kind == BOILERPLATE:
                continue
            text += len(piece)
            article += len(piece) if kind == ARTICLE else 0
            while at >= 0:
                held[at] += len(piece)
                parts[at] |= kind in (ARTICLE, MAIN)
                at = wrappers[at][0]
    states = [state for pieces, _ in lines for _, state in pieces]
    outer = any(at < 0 and kind in (ARTICLE, MAIN) for kind, at in states)
    passed = {-1}
    for at, (around, mark, in_article) in enumerate(wrappers):
        if around not in passed or 2 * held[at] <= (article if in_article else text):
            continue
        if mark == DOUBTFUL if in_article else not outer and (mark == DOUBTFUL or (mark == NAMED and parts[at])):
            passed.add(at)
            outer |= any(inner == at and kind in (ARTICLE, MAIN) for kind, inner in states)
    out = []
    for pieces, (kind, at) in lines:
        kind = kind if at in passed else BOILERPLATE
        if kind != BOILERPLATE:
            pieces = [(piece, of) for piece, of in pieces if of[0] != BOILERPLATE and of[1] in passed]
        line = " ".join("".join(piece for piece, _ in pieces).split())
        if line:
            out.append((line, kind))
    return out


def marked_lines(page: str) -> list[tuple[str, int]]:
    """(text, kind) of every block of a page in order: character references decoded, white space
    runs made one space, empty blocks left out. Time grows with the page's length."""
    lines: list[tuple[list[tuple[str, State]], State]] = []
    parts: list[tuple[str, State]] = []
    wrappers: list[tuple[int, int, bool]] = []
    outside = (OPEN, -1)
    stack: list[tuple[str, State, State]] = []  # open elements with their state and their block's
    state, block, at = outside, outside, 0  # a block's text is what the block is
    failed: set[int] = set()

    def end_block() -> None:
        if parts:
            lines.append((parts.copy(), block))
            parts.clear()

    def close(depth: int) -> None:
        nonlocal state, block
        if (stack[depth - 1][2] if depth else outside) != block:
            end_block()
        del stack[depth:]
        _, state, block = stack[-1] if stack else ("", outside, outside)

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            parts.append((html.unescape(page[at:start]), state))
        if start == len(page):
            break
        if page.startswith("<!--", start):
            # "<!-->" and "<!--->" are whole comments.
            short = next((mark for mark in ("<!-->", "<!--->") if page.startswith(mark, start)), "")
            finish = None if short else COMMENT_END.search(page, start + 4)
            at = start + len(short) if short else finish.end() if finish else len(page)
            continue
        follows = page[start + 1 : start + 2]
        if not (follows.isalpha() or follows in ("/", "!", "?")) or not follows:
            parts.append(("<", state))
            at = start + 1
            continue
        end = page.find(">", start)
        if end < 0:  # an unfinished tag ends the page
            break
        opening = TAG_NAME.match(page, start + 1)
        if opening:
            far = _tag_end(page, opening.end(), failed)
            end = far if far >= 0 else end
        tag = page[start + 1 : end]
        at = end + 1
        found = NAME.match(tag)
        if not found:
            continue
        name = found[1].lower()
        if tag[0] == "/":
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), -1)
            if name in BLOCKS:
                end_block()
            if depth >= 0:
                # What the element leaves open inside ends with it.
                if name not in BLOCKS and any(n in BLOCKS for n, *_ in stack[depth + 1 :]):
                    continue
                close(depth)
            continue
        if name == "br":
            parts.append(("\n", state))
            continue
        if name in BLOCKS:
            end_block()
            # A block ends an open paragraph; a list item ends the item before it.
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or (stack[depth][0] == name and name in ("li", "dd", "dt")):
                    close(depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
        if name in VOID:
            continue
        if name in RAW:
            finish = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
            at = finish.start() if finish else len(page)
            if finish:
                at = page.find(">", finish.start()) + 1 or len(page)
            continue
        if tag.endswith("/") and name not in BLOCKS:
            continue
        kind, mark = _kind(name, tag, state[0])
        new = (kind, state[1])
        if mark != UNMARKED:
            wrappers.append((state[1], mark, state[0] == ARTICLE))
            new = (kind, len(wrappers) - 1)
        if new[0] < state[0]:  # an article begins, in whatever element
            end_block()
        if name in BLOCKS or new[0] < state[0]:
            block = new
        stack.append((name, new, block))
        state = new
    end_block()
    return _without_marked(lines, wrappers)


# How many bits of table an alignment may keep at once; longer pages are halved.
TABLE_BITS = 1 << 28


def _rows(a: Sequence, b: Sequence):
    """Bit rows of the alignment of growing prefixes of ``a`` with ``b``: a zero at place j means
    that b[:j+1] matches one more line than b[:j]."""
    places: dict = {}
    for j, value in enumerate(b):
        places[value] = places.get(value, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for value in a:
        match = row & places.get(value, 0)
        row = ((row + match) | (row - match)) & full
        yield row


def _lengths(a: Sequence, b: Sequence) -> list[int]:
    """Longest common subsequence of ``a`` with every prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    lengths = [0]
    for bit in format(row, f"0{len(b)}b")[::-1] if b else "":
        lengths.append(lengths[-1] + (bit == "0"))
    return lengths


def shared_places(a: Sequence, b: Sequence) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``."""
    shared: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            shared.add(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            shared.add(a1)
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > TABLE_BITS and a1 - a0 > 1:
            middle = (a0 + a1) // 2
            left = _lengths(a[a0:middle], b[b0:b1])
            right = _lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
            cut = max(range(len(left)), key=lambda j: left[j] + right[j])
            todo += [(a0, middle, b0, b0 + cut), (middle, a1, b0 + cut, b1)]
            continue
        rows = list(_rows(a[a0:a1], b[b0:b1]))
        i, j = a1 - a0 - 1, b1 - b0 - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:  # b's line j adds nothing
                j -= 1
            elif i and not rows[i - 1] >> j & 1:  # it did so without a's line i
                i -= 1
            else:
                shared.add(a0 + i)
                i, j = i - 1, j - 1
    return shared
