"""URL filter: a trie over reversed host labels and, below each host, over path prefixes.

The trie is built on the driver from a rule list that the caller passes in, so its size is the
caller's; ``TRIE_RULES`` keeps it well inside a broadcast, and longer lists are held in several tries,
of whose answers the longest match counts. URLs are judged by a map without any shuffle: every label
and path segment is one step down the trie, and the last, unfinished segment of a rule is looked up
by the lengths that such segments have there, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIE_RULES = 500_000
RESULT = "host string, path string, rule string, verdict string"
PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
TO_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Rule:
    """One entry. It fits ``host`` and its subdomains where the URL's path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


class Trie:
    """Longest match: more host labels win, then the longer path.

    A host node is ``[children by label, path node or None]``; a path node is
    ``[children by segment, {unfinished last segment: rule}, lengths of these, longest first]``. Of
    two rules for the same host and path, block wins.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: list = [{}, None]
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.translate(TO_LOWER).split(".")) if rule.host else ():
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}, []]
            *whole, last = rule.path.split("/")
            place = node[1]
            for segment in whole:
                place = place[0].setdefault(segment, [{}, {}, []])
            old = place[1].get(last)
            if old is None or rule.verdict == "block":
                place[1][last] = rule
            if len(last) not in place[2]:
                place[2] = sorted((*place[2], len(last)), reverse=True)

    @staticmethod
    def _path(place: list, path: str) -> Rule | None:
        """The rule with the longest path that starts ``path``."""
        found = None
        for segment in path.split("/"):
            for length in place[2]:
                rule = place[1].get(segment[:length]) if length <= len(segment) else None
                if rule is not None:
                    found = rule
                    break
            place = place[0].get(segment)
            if place is None:
                break
        return found

    def find(self, host: str, path: str) -> Rule | None:
        node, found = self.root, None
        labels = reversed(host.split(".")) if host else ()
        if node[1] is not None:
            found = self._path(node[1], path)
        for label in labels:
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                found = self._path(node[1], path) or found
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    parts = PARTS.search(url) if isinstance(url, str) else None
    return (parts[1].translate(TO_LOWER), parts[2]) if parts else ("", "")


def rank(rule: Rule) -> tuple[int, int, bool]:
    """Of two rules that fit a URL, the one with the higher rank counts."""
    return (rule.host.count(".") + 1 if rule.host else 0, len(rule.path), rule.verdict == "block")


def judge(
    spark: SparkSession, url: Column, rules: Iterable[Rule], default: str, trie_rules: int = TRIE_RULES
) -> Column:
    """A struct of host, path, the deciding rule's name and its verdict for each URL."""
    rules = list(rules)
    tries = [
        spark.sparkContext.broadcast(Trie(rules[start : start + trie_rules]))
        for start in range(0, max(1, len(rules)), trie_rules)
    ]

    @F.pandas_udf(RESULT)
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = [trie.value for trie in tries]
        for urls in batches:
            rows = []
            for text in urls:
                host, path = split_url(text)
                found = [rule for trie in ready if (rule := trie.find(host, path))]
                rule = max(found, key=rank, default=None)
                rows.append((host, path, rule and rule.name, rule.verdict if rule else default))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return verdicts(url)


def filter_urls(
    pages: DataFrame,
    rules: Iterable[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
    trie_rules: int = TRIE_RULES,
) -> DataFrame:
    """One row per row of ``pages``: its id, host, path, rule (NULL if none fits) and verdict.

    NULL and empty URLs and those without ``://`` have an empty host and path; no rule with a
    host fits them, so they get ``default``. Repeated rows are judged alike, an empty table gives
    an empty result, and other columns of ``pages`` are not read.
    """
    judged = judge(pages.sparkSession, F.col(url_column), rules, default, trie_rules)
    return pages.select(F.col(id_column).alias("page_id"), judged.alias("judged")).select(
        "page_id", "judged.*"
    )
