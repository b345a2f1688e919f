"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import (
    bpe,
    html_extract,
    line_dedup,
    mixing,
    near_dedup,
    neighbours,
    quality_classifier,
    quality_rules,
    toxicity,
    url_filter,
)
from kindred.llm.queries import QUERIES, URL_RULES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 30_000
LINE = "one line that several documents hold"


def documents(spark, rows):
    return spark.createDataFrame([(*row, "en", None if row[0] == 3 else "s", 0) for row in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """NULL id, NULL and empty text, a long text, equal rows, one id with two texts."""
    frame = documents(
        spark,
        [
            (None, f"{LINE}\nno id"), (1, None), (2, ""), (3, " \t\n\n "), (4, LONG),
            (5, f"  {LINE.upper()} \nend"), (5, f"  {LINE.upper()} \nend"), (6, LINE), (6, "other text"),
            (7, f"{LINE}\r\nshort\n{LINE}"),
        ],
    )
    # Columns whose names the operators use themselves.
    return frame.withColumns({name: F.lit("x") for name in ("size", "key", "first", "doc", "text_hash", "n")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, None), (5, 0, 1), (5, 1, 1), (None, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def test_line_dedup(odd, none):
    found = rows(line_dedup.drop_repeated_lines(odd), "doc.doc_id", "text", "n_lines", "n_dropped")
    assert (None, f"{LINE}\nno id", 2, 0) in found
    assert (1, "", 1, 0) in found and (2, "", 1, 0) in found and (3, " \t\n\n ", 3, 0) in found
    assert found.count((5, f"  {LINE.upper()} \nend", 2, 0)) == 2
    assert (6, "", 1, 1) in found and (6, "other text", 1, 0) in found
    assert (7, "short", 3, 2) in found
    assert (4, LONG, 1, 0) in found
    assert rows(line_dedup.drop_repeated_lines(none), "text") == []


def test_near_dedup(odd, none, spark):
    text = " ".join(f"w{i}" for i in range(100))
    copies = documents(spark, [(20, text), (21, text.upper()), (22, text + " end"), (9, "other")])
    found = near_dedup.near_duplicates(odd.select(*copies.columns).unionAll(copies))
    by_id = {row["doc_id"]: row for row in found.collect()}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["kept"] for i in (1, 2, 3))
    assert by_id[4]["n_shingles"] == 1
    assert [by_id[i]["component_id"] for i in (20, 21, 22)] == [20, 20, 20]
    assert not by_id[21]["kept"] and by_id[20]["kept"] and by_id[9]["kept"]
    assert found.filter("doc_id = 5").count() == 2
    assert near_dedup.near_duplicates(none).count() == 0


def test_mixing(odd, none):
    taken = mixing.taken_words(*mixing.mix(odd))
    found = rows(taken, "doc_id", "size", "taken")
    assert len(found) == 10
    assert all(got <= 3 * size for _, size, got in found)
    assert (1, 0, 0) in found and (3, 0, 0) in found
    assert sum(got for *_, got in found) == sum(size for _, size, _ in found)
    assert rows(mixing.taken_words(*mixing.mix(none)), "taken") == []


def test_quality_rules(odd, none):
    by_id = {row["doc_id"]: row for row in quality_rules.apply_rules(odd).collect()}
    assert by_id[1]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
    assert by_id[4]["n_repeat_words"] == 30_000 and by_id[4]["base_failed"]
    assert by_id[7]["n_dup_lines"] == 0  # one of the two equal lines ends in a carriage return
    assert quality_rules.apply_rules(none).count() == 0


def test_classifiers(odd, none, labels):
    for module in (toxicity, quality_classifier):
        found = module.classify(odd, labels).collect()
        assert len(found) == 10
        assert all(0 <= row["score"] <= 1 for row in found)
        assert not any(row["held_out"] for row in found if row["doc_id"] is None)
        assert module.classify(none, labels.limit(0)).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "example.com/en/"), (4, "http://COM"), (5, "ftp://a.example.com/en/x?q"),
         (6, "http://WWW.Example.com/en/"), (6, "http://WWW.Example.com/en/"), (7, "http://a.net/es"),
         (8, "http://a.net/fr/#x"), (None, "https://example.com:80/en/"), (9, "http://xcom/")],
        "page_id bigint, url string",
    ).withColumn("host", F.lit("clash"))
    found = url_filter.filter_urls(pages, URL_RULES)
    assert rows(found, "page_id", "host", "path", "rule", "verdict") == sorted(
        [
            (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
            (4, "com", "", None, "allow"), (5, "a.example.com", "/en/x", "example.com/en/", "block"),
            (6, "www.example.com", "/en/", "www.example.com/en/", "allow"),
            (6, "www.example.com", "/en/", "www.example.com/en/", "allow"),
            (7, "a.net", "/es", None, "allow"), (8, "a.net", "/fr/", "net/fr/", "block"),
            (None, "example.com:80", "/en/", None, "allow"), (9, "xcom", "/", None, "allow"),
        ],
        key=repr,
    )
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_neighbours(spark):
    vectors = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]),
         (6, [float("nan"), 1.0]), (7, []), (8, [1e-200, 1e-200]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]),
         (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (50, [float("inf"), 0.0])],
        "vec_id bigint, embedding array<double>",
    ).withColumn("score", F.lit("clash"))
    found = [tuple(row) for row in neighbours.nearest(vectors).orderBy("query_id", "rank").collect()]
    assert [row[:3] for row in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (0, 4, 9), (0, 5, 9)]
    assert [row[3] for row in found] == pytest.approx([1, 1, 0.5**0.5, -1, -1], abs=1e-12)
    assert neighbours.nearest(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("cells, every", [(1, 3), (16, 50), (64, 2)])
def test_neighbours_in_cells(spark, monkeypatch, cells, every):
    """However queries and candidates are dealt, blocks never go through the driver."""
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 8)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 16)
    vectors = np.random.default_rng(4).normal(size=(300, 4))
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", cells)
    try:
        result = neighbours.nearest(frame, every=every)
        found = sorted(tuple(row) for row in result.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lengths = np.sqrt((vectors**2).sum(1))
    want = []
    for query in range(0, 300, every):
        scores = (vectors * vectors[query]).sum(1) / (lengths * lengths[query])
        others = sorted((i for i in range(300) if i != query), key=lambda i: -scores[i])[:5]
        want += [(query, rank, i, scores[i]) for rank, i in enumerate(others, 1)]
    assert [row[:3] for row in found] == [row[:3] for row in want]
    assert [row[3] for row in found] == pytest.approx([row[3] for row in want], abs=1e-12)
    assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, "http://h/a", "<article>one &amp; two</article>"), (1, "http://h/a", "<article>one &amp; two</article>"),
         (2, None, None), (None, "x", ""), (3, "http://h/b", "<p>" + LONG)],
        "page_id bigint, url string, html string",
    ).withColumn("lines", F.lit("clash"))
    found = rows(html_extract.extract(pages), "page_id", "text")
    assert found == sorted(
        [(1, "one & two"), (1, "one & two"), (2, ""), (None, ""), (3, LONG.strip())], key=repr
    )
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_bpe(odd, none):
    """NULL and empty texts have no tokens; repeated rows are encoded alike."""
    found = bpe.encode_documents(odd, corpus_pipeline.VOCABULARY, decode=True)
    by_id = {}
    for row in found.collect():
        by_id.setdefault(row["doc_id"], set()).add((row["n_tokens"], bytes(row["ids"]), row["decoded"]))
    assert by_id[1] == by_id[2] == by_id[3] == {(0, b"", "")}
    assert len(by_id[5]) == 1 and len(by_id[6]) == 2
    ((n, ids, decoded),) = by_id[4]
    assert n == 30_000 and len(set(ids[k : k + 4] for k in range(0, len(ids), 4))) == 1 and decoded.count("word") == n
    assert bpe.encode_documents(none, corpus_pipeline.VOCABULARY).count() == 0


def test_large_values(spark):
    """Vectors whose squares overflow take part: cosines don't depend on lengths."""
    vectors = spark.createDataFrame(
        [(0, [1e200, 1e200]), (1, [1e300, 0.0]), (2, [1e-300, 1e-300]), (3, [-1e200, 1.0])],
        "vec_id bigint, embedding array<double>",
    )
    found = [tuple(row) for row in neighbours.nearest(vectors).orderBy("rank").collect()]
    assert [row[2] for row in found] == [2, 1, 3]
    assert [row[3] for row in found] == pytest.approx([1, 0.5**0.5, -(0.5**0.5)], abs=1e-12)


def test_texts_over_a_megabyte(spark):
    long = "\n".join(f"a line of text number {n} that goes on" for n in range(40_000))
    docs = documents(spark, [(1, long), (2, long + "\nmore"), (3, f"own\n{LINE}"), (4, LINE)])
    found = {row["doc_id"]: row for row in line_dedup.drop_repeated_lines(docs).select("doc.doc_id", "text", "n_dropped").collect()}
    assert found[1]["text"] == long and (found[2]["text"], found[2]["n_dropped"]) == ("more", 40_000)
    assert found[4]["text"] == ""
    near = {row["doc_id"]: row["component_id"] for row in near_dedup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, none, name, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, odd, str(tmp_path))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == list(corpus_pipeline.COLUMNS)
    assert found.count() > 0
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
