"""HTML extraction: structure, and differencing with the nearest page of the same host.

A page becomes lines of text (blocks) marked by where they stand: in an article, in a main part, in
the open, or in an element that never holds main text. Pages of a host are put in the order of
their URL paths, and every page meets the nearest other pages on each side. Without an article, these
are two, and the lines outside articles are aligned with theirs by a longest common subsequence. A line
is frame and deleted if two of them share it; only where a host offers a single other page does that one
decide. An article is marked as the main text, and articles quote each other, so more is asked for: they
meet eight on each side, and are aligned from both ends, where what a layout wraps around a text stands.
First and last lines are frame if all of those share them, at least eight witnesses.

Copies and near copies are no witnesses against each other, and several near copies are one
witness. Skipped on the way are pages with the same longest line, but for digits; if fewer than two
others are left, pages with other lines come in. Among the pages that met, two are near copies if
they share more than half of what they don't share with most pages around; without two pages of
another longest line around, if they share four fifths of their characters. A host whose frame is
more than that keeps it: in doubt a line stays.

Every page is parsed once, into a written table of lines. Pages are put in order by ranges of (host,
path) whose number follows from their text and whose bounds come from a sample of keys of bounded size,
so a host with a third of all pages spans many tasks. A first pass over digests of the pages finds which
pages a range needs from the ones before and after it; they also go there as context, and the result
doesn't depend on the bounds. Lines are shuffled once, as digests; back come the places of the frame,
which the written lines are joined with if there are any.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow import map_slices
from kindred.llm.html_lines import ARTICLE, BOILERPLATE, MAIN, OPEN, marked_lines, shared_places
from kindred.llm.words import lower_ascii, written

RANGE_CHARS = 1 << 23  # of lines
RANGES_PER_PARTITION = 4
KEYS_PER_RANGE = 16  # sampled for the bounds
MARKS = ("gist", "copy")
WITNESSES = 2  # nearest pages of each side
ARTICLE_WITNESSES = 8  # the same for a page with an article; also, how many there must be at least
CARRIED = ARTICLE_WITNESSES + 1  # one may be a page's own copy
DIGEST = 16
PLACE = "struct<key:string,gist:binary,copy:binary>"
EDGES = f"part int, first string, last string, heads array<{PLACE}>, tails array<{PLACE}>"
LINES = (
    "key string, host string, page_id bigint, url string, gist binary, copy binary, "
    "lines array<string>, kinds array<int>, n_chars bigint"
)
PLACED = (
    "part int, own boolean, key string, host string, gist binary, copy binary, "
    "digests binary, sizes array<int>, kinds array<int>"
)
GONE = "key string, copy binary, gone array<int>"
TEXTS = "page_id bigint, url string, text string"
SLICE = 64
RUNS = 64  # that wait before their texts are made
KNOWN_PAIRS = 4096
DIGITS = re.compile(r"\d+")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def keyed(pages: DataFrame, *columns: str) -> DataFrame:
    """Pages with host, path and the key of their order."""
    url = F.coalesce("url", F.lit(""))
    page = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        *columns,
    ).withColumn("key", F.concat_ws("\x01", "host", "path", url, page))


def range_bounds(parsed: DataFrame, count: int, rows: int) -> list[str]:
    """Bounds of up to ``count`` ranges of the keys of so many rows."""
    wanted = count * KEYS_PER_RANGE
    share = min(1.0, 2 * wanted / max(1, rows))
    by_hash = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = parsed.select("key").filter(by_hash).limit(4 * wanted).collect()
    sample = sorted(row["key"] for row in drawn)
    return sorted({sample[i * len(sample) // count] for i in range(1, count)}) if sample else []


def digest(text: str) -> bytes:
    return blake2b(text.encode(), digest_size=DIGEST).digest()


def marks(marked: list[tuple[str, int]]) -> dict[str, bytes]:
    """What pages with the same lines have in common, and what most near copies have: the longest
    line, without digits."""
    lines = [DIGITS.sub("", text) for text, kind in marked if kind != BOILERPLATE]
    values = {"gist": max(lines, key=lambda line: (len(line), line), default=""), "copy": repr(marked)}
    return {mark: digest(values[mark]) for mark in MARKS}


def apart(pages: Iterable[dict]) -> list[dict]:
    """Of pages on one host, the nearest first, those that are the first with one of the first
    ``CARRIED`` values of a mark. The pages put before this list give the same as put before all."""
    seen: dict[str, set] = {mark: set() for mark in MARKS}
    kept = []
    for page in pages:
        new = [m for m in MARKS if page[m] not in seen[m] and len(seen[m]) < CARRIED]
        for mark in new:
            seen[mark].add(page[mark])
        if new:
            kept.append(page)
    return kept


def edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every range, from its sketched pages in order: its first and last host, and the pages on
    them that other ranges may need, the outermost first."""
    places = pa.list_(pa.struct([("key", pa.string()), *((mark, pa.binary()) for mark in MARKS)]))
    names = [("part", pa.int32()), ("first", pa.string()), ("last", pa.string())]
    schema = pa.schema([*names, ("heads", places), ("tails", places)])
    edge: dict | None = None

    def done() -> list[pa.RecordBatch]:
        return [pa.RecordBatch.from_pylist([edge], schema)] if edge else []

    for batch in batches:
        for page in batch.to_pylist():
            if edge is None or edge["part"] != page["part"]:
                yield from done()
                edge = {"part": page["part"], "first": page["host"], "last": page["host"], "heads": [], "tails": []}
            if page["host"] != edge["last"]:
                edge["last"], edge["tails"] = page["host"], []
            place = {name: page[name] for name in ("key", *MARKS)}
            if page["host"] == edge["first"]:
                edge["heads"] = apart([*edge["heads"], place])
            edge["tails"] = apart([place, *edge["tails"]])
    yield from done()


def contexts(edges: list[dict]) -> dict[tuple[str, bytes], list[int]]:
    """The other ranges that need a page, by key and digest, from the edges of ranges in order."""
    needed: dict[tuple, list[int]] = defaultdict(list)

    def walk(edges: Iterable[dict], start: str, end: str, far: str) -> None:
        host, carried = "", []
        for edge in edges:
            if edge[start] != host:
                carried = []
            for page in carried:
                needed[page["key"], page["copy"]].append(edge["part"])
            through = carried if edge[start] == edge[end] else []
            host, carried = edge[end], apart([*edge[far], *through]) if edge[end] else []

    walk(edges, "first", "last", "tails")
    walk(reversed(edges), "last", "first", "heads")
    return dict(needed)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """The lines of every page with its marks."""

    def make():
        def parse(batch: pa.RecordBatch) -> dict:
            rows = batch.to_pylist()
            found = [marked_lines(row["html"] or "") for row in rows]
            marked = [marks(one) for one in found]
            return {
                **{name: [row[name] for row in rows] for name in ("key", "host", "page_id", "url")},
                **{mark: [one[mark] for one in marked] for mark in MARKS},
                "lines": [[text for text, _ in one] for one in found],
                "kinds": [[kind for _, kind in one] for one in found],
                "n_chars": [sum(len(text) for text, _ in one) for one in found],
            }

        return parse

    return written(map_slices(keyed(pages, "html"), make, LINES, SLICE), "html-lines", "zstd")


def in_ranges(parsed: DataFrame, bounds: list[str]) -> DataFrame:
    """Range, key, host and marks of every page."""

    def make():
        def place(batch: pa.RecordBatch) -> dict:
            keys = batch["key"].to_pylist()
            return {"part": [bisect_right(bounds, key) for key in keys]} | {
                name: batch[name] for name in ("key", "host", *MARKS)
            }

        return place

    columns = parsed.select("key", "host", *MARKS)
    return map_slices(columns, make, "part int, key string, host string, gist binary, copy binary", 4096)


def placed_lines(parsed: DataFrame, bounds: list[str], needed: dict[tuple, list[int]]) -> DataFrame:
    """Digests and sizes of the lines of every page, in its own range and as context in others."""
    kept = ("key", "host", *MARKS, "kinds")

    def make():
        def lines(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in ("part", "own", *kept, "digests", "sizes")}
            for row in batch.to_pylist():
                own = bisect_right(bounds, row["key"])
                digests = b"".join(digest(line) for line in row["lines"])
                sizes = [len(line) for line in row["lines"]]
                for number in [own, *needed.get((row["key"], row["copy"]), [])]:
                    out["part"].append(number)
                    out["own"].append(number == own)
                    out["digests"].append(digests)
                    out["sizes"].append(sizes)
                    for name in kept:
                        out[name].append(row[name])
            return out

        return lines

    return map_slices(parsed.select(*kept, "lines"), make, PLACED, SLICE)


def text_kind(kinds: list[int]) -> int:
    """Where a page's main text stands: in an article, else in a main part, else in the open."""
    return next((kind for kind in (ARTICLE, MAIN) if kind in kinds), OPEN)


def inside_article(page: dict) -> bool:
    """Whether the page's article is aligned, not what stands outside articles."""
    return ARTICLE in page["kinds"]


def aligned_places(page: dict, inside: bool) -> list[int]:
    return [at for at, kind in enumerate(page["kinds"]) if (kind == ARTICLE) == inside]


def aligned_lines(page: dict, inside: bool) -> list:
    """Lines, or digests of them."""
    return [page["lines"][at] for at in aligned_places(page, inside)]


def sizes_of(page: dict) -> list[int]:
    return page["sizes"] if "sizes" in page else [len(line) for line in page["lines"]]


def size(page: dict, inside: bool) -> int:
    """Characters that may be main text."""
    return sum(
        chars
        for chars, kind in zip(sizes_of(page), page["kinds"])
        if (kind == ARTICLE if inside else kind != BOILERPLATE)
    )


class Pairs(dict):
    """How many characters that may be main text two pages share, inside or outside articles; of
    recent pairs of pages."""

    def of(self, one: dict, other: dict, inside: bool) -> int:
        one, other = sorted((one, other), key=lambda page: page["copy"])
        key = one["copy"], other["copy"], inside
        if key not in self:
            if len(self) >= KNOWN_PAIRS:
                self.clear()
            places, sizes = aligned_places(one, inside), sizes_of(one)
            shared = shared_places(aligned_lines(one, inside), aligned_lines(other, inside))
            self[key] = sum(sizes[places[at]] for at in shared if one["kinds"][places[at]] != BOILERPLATE)
        return self[key]


def reach(page: dict) -> int:
    """How many pages a page meets on each side."""
    return ARTICLE_WITNESSES if inside_article(page) else WITNESSES


def different(page: dict, side: list[dict], mark: str) -> dict[bytes, dict]:
    """The nearest pages of a side that differ from the page and each other in a mark."""
    found: dict[bytes, dict] = {}
    for other in side:
        if other[mark] != page[mark]:
            found.setdefault(other[mark], other)
    return dict(list(found.items())[: reach(page)])


def pages_around(page: dict, before: list[dict], after: list[dict]) -> tuple[list[dict], bool]:
    """The pages that a page meets, and whether two of them have another longest line."""
    found = different(page, after, "gist") | different(page, before, "gist")
    wide = len(found) > 1
    others = {other["copy"]: other for other in found.values()}
    if not wide:
        others |= different(page, after, "copy") | different(page, before, "copy")
    return [other for other in others.values() if not inside_article(page) or inside_article(other)], wide


def witness_groups(page: dict, others: list[dict], wide: bool, pairs: Pairs) -> list[list[dict]]:
    """The pages that tell about a page's frame, near copies of each other together."""
    inside = inside_article(page)
    around = [page, *others]
    sizes = [size(one, inside) for one in around]
    shared = [[pairs.of(one, other, inside) if one is not other else 0 for other in around] for one in around]
    usual = [sorted(row[:i] + row[i + 1 :])[(len(row) - 2) // 2] if wide else 0 for i, row in enumerate(shared)]

    def near(i: int, j: int) -> bool:
        if wide:
            base = min(usual[i], usual[j])
            return 2 * (shared[i][j] - base) > max(sizes[i], sizes[j]) - base
        return 5 * shared[i][j] >= 4 * (sizes[i] + sizes[j] - shared[i][j])

    group = list(range(len(around)))
    for i in range(len(around)):
        for j in range(i):
            if group[i] != group[j] and near(i, j):
                group = [group[j] if number == group[i] else number for number in group]
    return [
        [one for one, of in zip(around, group) if of == number] for number in sorted({*group} - {group[0]})
    ]


def common_start(one: list, other: list) -> int:
    return next((at for at, (a, b) in enumerate(zip(one, other)) if a != b), min(len(one), len(other)))


def article_frame(page: dict, others: list[dict], wide: bool, pairs: Pairs) -> set[int]:
    """Numbers of the article's first and last lines that all witnesses share, if these are enough.
    An article that is nothing else keeps them."""
    lines = aligned_lines(page, True)
    ends = {other["copy"]: (common_start(lines, theirs), common_start(lines[::-1], theirs[::-1]))
            for other in others for theirs in [aligned_lines(other, True)]}
    # Fewer than the witnesses share a line: there is no need to tell who they are.
    if all(sum(own[end] > 0 for own in ends.values()) < ARTICLE_WITNESSES for end in (0, 1)):
        return set()
    groups = witness_groups(page, others, wide, pairs)
    if len(groups) < ARTICLE_WITNESSES:
        return set()
    first, last = (min(max(ends[one["copy"]][end] for one in group) for group in groups) for end in (0, 1))
    return {*range(first), *range(len(lines) - last, len(lines))} if first + last < len(lines) else set()


def open_frame(page: dict, others: list[dict], wide: bool, pairs: Pairs) -> set[int]:
    """Numbers of the lines outside articles that two witnesses share, or the only one."""
    lines, seen = aligned_lines(page, False), Counter()
    groups = witness_groups(page, others, wide, pairs)
    for group in groups:
        seen.update(set().union(*(shared_places(lines, aligned_lines(other, False)) for other in group)))
    return {at for at, number in seen.items() if number >= min(2, len(groups))}


def frame_places(page: dict, before: list[dict], after: list[dict], pairs: Pairs) -> set[int]:
    """Places of a page's frame: in its article if there is one, else outside articles."""
    others, wide = pages_around(page, before, after)
    inside = inside_article(page)
    places = aligned_places(page, inside)
    return {places[at] for at in (article_frame if inside else open_frame)(page, others, wide, pairs)}


def text_without(page: dict, frame: Iterable[int]) -> str:
    """The page's article; else its main part, else its open lines, without the frame."""
    wanted, frame = text_kind(page["kinds"]), set(frame)
    return "\n\n".join(
        text
        for at, (text, kind) in enumerate(zip(page["lines"], page["kinds"]))
        if kind == wanted and at not in frame
    )


def main_text(page: dict, before: list[dict], after: list[dict], pairs: Pairs) -> str:
    """The main text of a page between others of its host, the nearest first."""
    return text_without(page, frame_places(page, before, after, pairs))


def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the frame in the main text of pages that arrive in order, where there are any.

    Runs of equal pages wait until the pages after them are known. In memory are the digests of the
    runs that wait, which are those of near copies and a few others, and the keys of their pages; at
    most those of one range.
    """
    schema = pa.schema([("key", pa.string()), ("copy", pa.binary()), ("gone", pa.list_(pa.int32()))])
    runs: list[dict] = []  # page, the pages before it, keys of the equal ones
    place, before, limit, pairs = None, [], RUNS, Pairs()

    def finish(last: bool) -> Iterator[pa.RecordBatch]:
        """Frames of the runs that no later page can change."""
        after: list[dict] = []
        for run in reversed(runs):
            run["after"] = after
            after = apart([run["page"], *after])
        open_from = next((i for i, run in enumerate(runs) if not last and not settled(run)), len(runs))
        for run in runs[:open_from]:
            page = run["page"]
            wanted = text_kind(page["kinds"])
            frame = frame_places(page, run["before"], run["after"], pairs) if run["keys"] else ()
            gone = [at for at in sorted(frame) if page["kinds"][at] == wanted]
            for start in range(0, len(run["keys"]) if gone else 0, SLICE):
                keys = run["keys"][start : start + SLICE]
                rows = [{"key": key, "copy": page["copy"], "gone": gone} for key in keys]
                yield pa.RecordBatch.from_pylist(rows, schema)
        del runs[:open_from]

    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            for page in batch.slice(start, SLICE).to_pylist():
                digests = page.pop("digests")
                page["lines"] = [digests[at : at + DIGEST] for at in range(0, len(digests), DIGEST)]
                here = (page["part"], page["host"])
                if here != place:
                    yield from finish(True)
                    place, before, limit = here, [], RUNS
                if not runs or runs[-1]["page"]["copy"] != page["copy"]:
                    runs.append({"page": page, "before": before, "keys": []})
                    before = apart([page, *before])
                # Equal rows stand together.
                if page["own"] and runs[-1]["keys"][-1:] != [page["key"]]:
                    runs[-1]["keys"].append(page["key"])
                if len(runs) >= limit:
                    yield from finish(False)
                    limit = max(RUNS, 2 * len(runs))
    yield from finish(True)


def settled(run: dict) -> bool:
    """Whether what stands after a run is known, or doesn't matter."""
    if not run["keys"]:
        return True
    page, wanted = run["page"], reach(run["page"])
    return all(len({other[m] for other in run["after"]} - {page[m]}) >= wanted for m in MARKS)


def texts_of(parsed: DataFrame) -> DataFrame:
    """Texts of pages without their frames (places in ``gone``, NULL for none)."""

    def make():
        def texts(batch: pa.RecordBatch) -> dict:
            found = [text_without(page, page["gone"] or ()) for page in batch.to_pylist()]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": found}

        return texts

    return map_slices(parsed.select("page_id", "url", "lines", "kinds", "gone"), make, TEXTS, SLICE)


def among_neighbours(parsed: DataFrame) -> DataFrame:
    """Frames of pages that are aligned with the nearest ones of their host."""
    rows, chars = parsed.agg(F.count("*"), F.sum("n_chars")).first()
    partitions = -(-(chars or 0) // RANGE_CHARS) or 1
    bounds = range_bounds(parsed, RANGES_PER_PARTITION * partitions, rows)
    edges = (
        in_ranges(parsed, bounds)
        .repartition(partitions, "part")
        .sortWithinPartitions("part", "key", "copy")
        .mapInArrow(edges_of, EDGES)
        .collect()
    )
    needed = contexts(sorted((edge.asDict(recursive=True) for edge in edges), key=lambda e: e["part"]))
    ordered = (
        placed_lines(parsed, bounds, needed)
        .repartition(partitions, "part")
        .sortWithinPartitions("part", "key", "copy", "own")
    )
    return ordered.mapInArrow(difference, GONE)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every row of ``pages`` (page_id, url, html).

    Blocks are joined by an empty line; the text is empty if there is none. NULL html is empty. A
    NULL id or URL stays NULL; pages without a host have no neighbour. Repeated rows each give a
    row with the same text. An empty table gives an empty result. Other columns are not read.
    """
    parsed = parsed_pages(pages)
    # Not compressed, so that its size tells Spark what a broadcast would take.
    gone = written(among_neighbours(parsed.filter("host <> ''")), "html-frames", "uncompressed")
    if gone.isEmpty():
        return texts_of(parsed.withColumn("gone", F.lit(None).cast("array<int>")))
    return texts_of(parsed.join(gone, ["key", "copy"], "left"))
