"""The audit of sources against a plain version over dense counts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, source string, text string"


def plain(docs, least, top):
    groups, holders = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lower = {upper: upper + 32 for upper in range(65, 91)}
        terms = TERM.findall((text or "").translate(lower))
        groups[lang or "", source or ""].update(terms)
        holders[lang or ""].update(set(terms))
    kept = {lang: [t for t, n in held.items() if n >= least] for lang, held in holders.items()}
    whole = defaultdict(Counter)
    for (lang, _), counts in groups.items():
        whole[lang].update(counts)

    def shares(lang, counts):
        total = sum(counts[t] for t in kept[lang]) + 2 * len(kept[lang])
        return {t: 1 + 1_000_000_000 * (counts[t] + 2) // total for t in kept[lang]}

    def value(p, q):
        return (p - q) ** 2 // (p + q)

    share = {key: shares(key[0], counts) for key, counts in groups.items()}
    out = []
    for (lang, source), p in share.items():
        q = shares(lang, whole[lang])
        pairs = [
            (-sum(value(p[t], r[t]) for t in p), other)
            for (its, other), r in share.items()
            if its == lang and other != source
        ]
        terms = [(-value(p[t], q[t]), t) for t in p if groups[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda row: (row[0], row[1].encode()))
            for rank, (minus, item) in enumerate(found, 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, -minus, rank))
    return sorted(out)


def found(spark, docs, **more):
    frame = spark.createDataFrame(docs, SCHEMA).withColumns({n: F.lit(1) for n in ("term", "n", "chunk", "total", "p")})
    return sorted(map(tuple, source_audit.audit(frame, **more).collect()))


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(11)
    words = [f"word{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(200)] + ["Über", "漢字", "éa", "x9y"]
    out = []
    for _ in range(500):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["hot"] * 6 + [f"s{n}" for n in range(12)])
        vocabulary = words[:: 1 + len(source) % 3]
        out.append((lang, source, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)))))
    return out


@pytest.mark.parametrize("chunk, tile", [(1 << 15, 8), (7, 2), (50, 1), (3, 100)])
def test_audit(spark, docs, chunk, tile):
    want = plain(docs, 10, 10)
    assert found(spark, docs, chunk_terms=chunk, tile_sources=tile) == want


def test_odd_groups(spark):
    """Empty and NULL fields, a group without terms, a language that keeps none, one with one source."""
    docs = [("en", "a", "One two"), ("en", "a", "one, ONE"), ("en", None, "two"), (None, None, None), ("en", "", "one"),
            ("en", "empty", ""), ("en", "rare", "never again"), ("xx", "p", "z"), ("xx", "q", "y"), ("yy", "only", "one one")]
    assert found(spark, docs, min_documents=2) == plain(docs, 2, 10)
    assert found(spark, [(None, "a", None), ("", "b", "")]) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]
    assert found(spark, []) == []


def test_ties_and_long_texts(spark):
    docs = [("en", s, " ".join(w * 30_000 for w in ("ab ", "ba ")) if s == "a" else t)
            for s in "abcd" for t in ("ab ba cd", "zz é", "Z") for _ in range(4)]
    for top in (1, 3, 100):
        assert found(spark, docs, top_terms=top) == plain(docs, 10, top)


def test_partial_counts(spark, docs, monkeypatch):
    """Counts that a task hands on early add up to the same."""
    whole = found(spark, docs)
    monkeypatch.setattr(source_audit, "COUNTED", 5)
    assert found(spark, docs) == whole


def test_shares_of_huge_counts(spark):
    row = spark.range(1).select(
        source_audit.share(F.lit(7 * 10**14), F.lit(9 * 10**15), F.lit(10**9)).alias("p")
    )
    assert row.first()["p"] == 1 + 10**9 * (7 * 10**14 + 2) // (9 * 10**15 + 2 * 10**9)


def test_galloping():
    draw = np.random.default_rng(3)
    for size, other in ((0, 5), (5, 0), (10, 10_000), (3000, 50_000), (2000, 2000)):
        a, b = (np.sort(draw.choice(60_000, n, replace=False)) for n in (size, other))
        in_a, in_b = source_audit.shared_places(a, b)
        assert a[in_a].tolist() == b[in_b].tolist() == np.intersect1d(a, b).tolist()


def test_prices_are_exact():
    p = np.array([1, 10**9 + 1, 10**9 + 1, 5])
    q = np.array([10**9 + 1, 1, 10**9 + 1, 3])
    assert source_audit.price(p, q).tolist() == [(int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(p, q)]
