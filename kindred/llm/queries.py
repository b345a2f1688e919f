"""The registered queries of the text operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import (
    bpe,
    html_extract,
    lexical_search,
    line_dedup,
    mixing,
    near_dedup,
    neighbours,
    quality_classifier,
    quality_rules,
    source_audit,
    token_files,
    toxicity,
    url_filter,
)
from kindred.plans.registry import Registry
from kindred.session import work_folder

QUERIES = Registry()

WORD_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@QUERIES.add(
    f"""
    WITH sized AS (
        SELECT doc_id, source, len({WORD_SQL})::BIGINT AS size,
               md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
    ranked AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
    limits AS (
        SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM ranked),
    levels AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE
                  / sum(weight) OVER after AS level
        FROM limits
        WINDOW before AS (ORDER BY most / weight, place
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               after AS (ORDER BY most / weight, place
                         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    goals AS (
        SELECT *, (SELECT level FROM levels WHERE level * weight < most
                   ORDER BY most / weight, place LIMIT 1) * weight AS share FROM levels),
    placed AS (
        SELECT row_number() OVER () AS row_no, doc_id, size, g.place, g.source_size,
               (CASE WHEN share < most THEN share ELSE most END)::DOUBLE AS target,
               floor((CASE WHEN share < most THEN share ELSE most END)::DOUBLE + 0.5)::BIGINT AS quota,
               sum(size) OVER (PARTITION BY g.place ORDER BY digest, doc_id, size
                               ROWS UNBOUNDED PRECEDING)::BIGINT - size AS first
        FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
    -- van der Corput points, mapped through the sources' cumulative blocks and ranked per source
    spans AS (
        SELECT place, blocks, sum(blocks) OVER (ORDER BY place)::BIGINT - blocks AS first_block,
               sum(blocks) OVER ()::BIGINT AS total
        FROM (SELECT DISTINCT place, ceil(quota / {mixing.BLOCK_WORDS})::BIGINT AS blocks FROM placed)),
    points AS (
        SELECT slot, list_sum(list_transform(range(bits), lambda k: ((slot >> k) & 1) << (bits - 1 - k)))::BIGINT
                     AS point
        FROM (SELECT bits, unnest(range(1 << bits)) AS slot
              FROM (SELECT greatest(1, ceil(log2(max(total))))::INTEGER AS bits FROM spans))),
    drawn AS (
        SELECT place, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS block
        FROM points JOIN spans ON point >= first_block AND point < first_block + blocks),
    rounds AS (
        SELECT row_no, place, first + round * source_size AS begin,
               least(first + size + round * source_size, quota) AS stop
        FROM placed, (SELECT unnest(range({mixing.MAX_REPEATS})) AS round)
        WHERE size > 0 AND first + round * source_size < quota),
    pieces AS (
        SELECT row_no, place, begin, stop,
               unnest(range(begin // {mixing.BLOCK_WORDS}, (stop - 1) // {mixing.BLOCK_WORDS} + 1)) AS block
        FROM rounds),
    takings AS (
        SELECT row_no, min(slot) AS first_slot,
               sum(least(stop, (block + 1) * {mixing.BLOCK_WORDS}) - greatest(begin, block * {mixing.BLOCK_WORDS}))::BIGINT
                   AS taken
        FROM pieces JOIN drawn USING (place, block) GROUP BY row_no)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot
    FROM placed LEFT JOIN takings USING (row_no)
    """
)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(documents, pieces).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot"
    )


URL_RULES = (
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
RULE_ROWS_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)


@QUERIES.add(
    f"""
    WITH parts AS (
        SELECT page_id, url, row_number() OVER () AS row_no,
               translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    rules(verdict, rule_host, rule_path) AS (VALUES {RULE_ROWS_SQL}),
    fitting AS (
        SELECT p.*, r.*, row_number() OVER (
                   PARTITION BY row_no ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS n
        FROM parts p LEFT JOIN rules r
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule_host || rule_path AS rule,
           coalesce(verdict, 'allow') AS verdict
    FROM fitting WHERE n = 1
    """
)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


STOP_SQL = ", ".join(f"'{word}'" for word in sorted(set(quality_rules.STOP_WORDS)))


@QUERIES.add(
    f"""
    WITH docs AS (
        SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
    measured AS (
        SELECT row_no, doc_id, {WORD_SQL} AS words,
               list_filter(string_split(text, chr(10)),
                           lambda l: length(translate(l, {SPACE_SQL}, '')) > 0) AS lines,
               length(translate(text, {SPACE_SQL}, ''))::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols
        FROM docs),
    windows AS (
        SELECT row_no, pos, words[pos:pos + 4] AS five
        FROM (SELECT row_no, words, unnest(range(1, len(words) - 3)) AS pos FROM measured)),
    repeated AS (
        SELECT row_no, pos FROM (
            SELECT row_no, pos, count(*) OVER (PARTITION BY row_no, five) AS n FROM windows)
        WHERE n > 1),
    covered AS (
        SELECT row_no, count(DISTINCT pos + step)::BIGINT AS n_repeat_words
        FROM repeated, (SELECT unnest(range(5)) AS step) GROUP BY row_no),
    counted AS (
        SELECT doc_id, len(words)::BIGINT AS n_words, word_chars, n_symbols,
               (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
               len(lines)::BIGINT AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
               len(list_filter(words, lambda w: lower(w) IN ({STOP_SQL})))::BIGINT AS n_stop
        FROM measured LEFT JOIN covered USING (row_no)),
    judged AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed
           AND coalesce(word_chars / n_words BETWEEN 2.0 AND 15.0, TRUE)
           AND coalesce(n_symbols / n_words <= 0.2, TRUE)
           AND (n_words < 100 OR n_stop / n_words >= 0.01)
           AND coalesce(n_dup_lines / n_lines <= 0.6, TRUE)
           AND (n_words < 100 OR n_words / n_lines >= 1.5) AS kept
    FROM judged
    """
)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@QUERIES.add()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decode=True
    )
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@QUERIES.add()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@QUERIES.add()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@QUERIES.add(
    f"""
    WITH split AS (
        SELECT row_no, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT row_number() OVER () AS row_no, doc_id,
                     string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
    keyed AS (
        SELECT *, translate(trim(line, {SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
    shared AS (
        SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    marked AS (
        SELECT k.*, coalesce(owner <> doc_id, FALSE) AS dropped
        FROM keyed k LEFT JOIN shared USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
           count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), ''))
               AS kept_sha256
    FROM marked GROUP BY row_no
    """
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@QUERIES.add()
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@QUERIES.add()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@QUERIES.add()
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


@QUERIES.add()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_folder(spark, "token-files")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary, folder, end_id=1)
    return token_files.read_tokens(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SEARCH_TERMS_SQL = (
    f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)


@QUERIES.add(
    f"""
    WITH words AS (
        SELECT row_no, doc_id, unnest({SEARCH_TERMS_SQL}) AS term
        FROM (SELECT row_number() OVER () AS row_no, * FROM documents)),
    counts AS (SELECT row_no, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (SELECT row_no, sum(tf)::BIGINT AS n FROM counts GROUP BY row_no),
    corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM sizes),
    asked AS (SELECT DISTINCT item_id, unnest({SEARCH_TERMS_SQL}) AS term FROM benchmark),
    weights AS (
        SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
        FROM counts, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
    scored AS (
        SELECT item_id, row_no, doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_words))))::BIGINT
                   AS score
        FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (row_no), corpus
        GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
           doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50
    """
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


AUDIT_TERMS_SQL = (
    f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)


@QUERIES.add(
    f"""
    WITH docs AS (
        SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text
        FROM documents),
    words AS (SELECT row_no, lang, source, unnest({AUDIT_TERMS_SQL}) AS term FROM docs),
    counts AS (
        SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT row_no) AS held
        FROM words GROUP BY ALL),
    kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(held) >= 10),
    langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    totals AS (
        SELECT lang, source, sum(c.n)::HUGEINT AS total FROM counts c JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (
        SELECT lang, source, coalesce(t.total, 0)::HUGEINT AS total
        FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals t USING (lang, source)),
    shares AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v) AS p,
               1 + (1000000000 * (k.n + 2)) // (langs.total + 2 * v) AS q
        FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang)
        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sums AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY ALL),
    parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT
        FROM shares WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value,
           row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM parts QUALIFY part = 'pair' OR rank <= 10
    """
)
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))
