"""Registered queries: similarities, rankings and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.operators import (
    cooccurrence,
    factorize,
    filters,
    history,
    products,
    ranking,
    recommend,
    similarity,
)
from kindred.plans import algorithms, incremental, views
from kindred.plans.registry import Registry
from kindred.session import work_folder
from kindred.sources import cells, tables

QUERIES = Registry()

FILTERED_ACTIONS = ("view", "click")

# --- SQL building blocks -------------------------------------------------------------------


def _x_log_x(x: str) -> str:
    return f"(CASE WHEN ({x}) = 0 THEN 0.0 ELSE ({x}) * ln({x}) END)"


def _entropy(*counts: str) -> str:
    whole = " + ".join(f"({c})" for c in counts)
    parts = " + ".join(_x_log_x(c) for c in counts)
    return f"({_x_log_x(whole)} - ({parts}))"


_ROWS = _entropy("n2", "n1 - n12 + total")
_COLS = _entropy("n1", "n2 - n12 + total")
_CELLS = _entropy("n12", "n2 - n12", "n1 - n12", "total")

SCORE_SQL = {
    "cooccurrence": "CAST(n12 AS BIGINT)",
    "jaccard": "CAST(round(CAST(n12 AS DOUBLE) / (n1 + n2 - n12) * 1000) AS BIGINT)",
    "cosine": "CAST(round(n12 / (sqrt(n1) + sqrt(n2)) * 1000) AS BIGINT)",
    "loglikelihood": (
        f"CASE WHEN {_ROWS} + {_COLS} < {_CELLS} THEN 0 "
        f"ELSE CAST(round(2 * ({_ROWS} + {_COLS} - {_CELLS}) * 1000) AS BIGINT) END"
    ),
}


def pair_ctes(view: str, where: str = "TRUE") -> str:
    return f"""{view},
seen AS (SELECT DISTINCT channel_id, user_id, item_id FROM interactions WHERE {where}),
counts AS (SELECT channel_id, item_id, count(*) AS n FROM seen GROUP BY ALL),
totals AS (SELECT channel_id, count(*) AS total FROM seen GROUP BY ALL),
together AS (
  SELECT a.channel_id, a.item_id, b.item_id AS other_id, count(*) AS n12
  FROM seen a JOIN seen b ON a.channel_id = b.channel_id AND a.user_id = b.user_id
       AND a.item_id < b.item_id
  GROUP BY ALL),
pairs AS (
  SELECT t.*, c1.n AS n1, c2.n AS n2, totals.total
  FROM together t
  JOIN counts c1 ON c1.channel_id = t.channel_id AND c1.item_id = t.item_id
  JOIN counts c2 ON c2.channel_id = t.channel_id AND c2.item_id = t.other_id
  JOIN totals ON totals.channel_id = t.channel_id)"""


def scored_ctes(view: str, base: str, where: str = "TRUE") -> str:
    return f"""{pair_ctes(view, where)},
scored AS (SELECT channel_id, item_id, other_id, {SCORE_SQL[base]} AS score FROM pairs),
both_ways AS (
  SELECT channel_id, item_id, other_id, score FROM scored
  UNION ALL
  SELECT channel_id, other_id, item_id, score FROM scored)"""


def scores_sql(view: str, base: str, where: str = "TRUE") -> str:
    return f"WITH {scored_ctes(view, base, where)} SELECT * FROM scored"


def similar_items_sql(view: str, base: str, size: int, channel: str = "channel_id, ") -> str:
    return f"""WITH {scored_ctes(view, base)}
SELECT {channel}item_id, other_id, score, rank FROM (
  SELECT *, row_number() OVER (
    PARTITION BY channel_id, item_id ORDER BY score DESC, other_id) AS rank
  FROM both_ways) WHERE rank <= {size}"""


# --- pair scores ---------------------------------------------------------------------------


@QUERIES.add(
    similar_items_sql(
        views.BASKETS_SQL, "jaccard", ranking.SIMILAR_ITEMS_DEFAULT, channel=""
    )
)
def similar_items_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.similarity(views.baskets(spark, sf_dir), "jaccard", by=())
    return ranking.similar_items(similarity.symmetric(pairs), by=())


def _pairs_of(base: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return similarity.similarity(views.interactions(spark, sf_dir), base)

    return build


for _name, _base in {
    "cooccurrence_pairs": "cooccurrence",
    "jaccard_pairs": "jaccard",
    "cosine_pairs": "cosine",
    "llr_pairs": "loglikelihood",
}.items():
    QUERIES.add(scores_sql(views.INTERACTIONS_SQL, _base), _name)(_pairs_of(_base))


@QUERIES.add(
    f"""WITH {pair_ctes(views.BASKETS_SQL)}
SELECT item_id, other_id,
       {", ".join(f"{sql} AS {base}" for base, sql in SCORE_SQL.items())}
FROM pairs"""
)
def basket_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.count_similarities(views.baskets(spark, sf_dir), by=())


@QUERIES.add(
    scores_sql(
        views.INTERACTIONS_SQL,
        "loglikelihood",
        f"action IN {FILTERED_ACTIONS}",
    )
)
def llr_pairs_action_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.interactions(spark, sf_dir)
    return similarity.similarity(rows, "loglikelihood", FILTERED_ACTIONS)


_SPREAD = "(sxx - sx * sx / n) * (syy - sy * sy / n)"


PEARSON_CTES = f"""ratings AS (
  SELECT DISTINCT channel_id, user_id, item_id, rating FROM interactions
  WHERE action = 'rating' AND rating IS NOT NULL),
sums AS (
  SELECT a.channel_id, a.item_id, b.item_id AS other_id, count(*) AS n,
         sum(a.rating) AS sx, sum(b.rating) AS sy, sum(a.rating * a.rating) AS sxx,
         sum(b.rating * b.rating) AS syy, sum(a.rating * b.rating) AS sxy
  FROM ratings a JOIN ratings b ON a.channel_id = b.channel_id AND a.user_id = b.user_id
       AND a.item_id < b.item_id
  GROUP BY ALL),
correlated AS (
  SELECT channel_id, item_id, other_id,
         CASE WHEN greatest({_SPREAD}, 0) = 0 THEN 0
              ELSE CAST(round((1 + (sxy - sx * sy / n) / sqrt(greatest({_SPREAD}, 0))) / 2 * 1000)
                        AS BIGINT) END AS score
  FROM sums)"""


@QUERIES.add(f"WITH {views.INTERACTIONS_SQL}, {PEARSON_CTES} SELECT * FROM correlated")
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarity(views.interactions(spark, sf_dir), "pearson")


def _kept_up(spark: SparkSession, sf_dir: str, base: str, actions: tuple[str, ...] = ()) -> DataFrame:
    """Scores after three batches of events, the second one given twice, merged in between."""
    root, rows = work_folder(spark, "kept-up"), _one_channel(spark, sf_dir)
    algorithm = algorithms.Algorithm(views.ONE_CHANNEL, "AL-1", base, actions)
    for batch in (0, 1, 1, 2):
        part = rows.where(F.col("event_id") % 3 == batch)
        incremental.update(spark, root, algorithm, part, batch)
        if batch == 1:
            incremental.compact(spark, root)
    return incremental.similarities(spark, root, algorithm)


@QUERIES.add(
    f"""WITH {pair_ctes(views.ONE_CHANNEL_SQL, f"action IN {FILTERED_ACTIONS}")}
SELECT item_id, other_id, {SCORE_SQL["loglikelihood"]} AS score FROM pairs"""
)
def kept_up_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_up(spark, sf_dir, "loglikelihood", FILTERED_ACTIONS)


@QUERIES.add(
    f"""WITH {pair_ctes(views.ONE_CHANNEL_SQL)}
SELECT item_id, other_id, {SCORE_SQL["jaccard"]} AS score FROM pairs"""
)
def kept_up_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_up(spark, sf_dir, "jaccard")


@QUERIES.add(f"WITH {views.ONE_CHANNEL_SQL}, {PEARSON_CTES} SELECT item_id, other_id, score FROM correlated")
def kept_up_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_up(spark, sf_dir, similarity.PEARSON)


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL},
seen AS (SELECT DISTINCT channel_id, user_id, item_id FROM interactions),
counts AS (SELECT channel_id, item_id, count(*) AS users FROM seen GROUP BY ALL)
SELECT *, CAST(sum(users) OVER (PARTITION BY channel_id) AS BIGINT) AS total FROM counts"""
)
def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = cooccurrence.user_items(views.interactions(spark, sf_dir))
    return cooccurrence.with_total(cooccurrence.item_counts(seen))


@QUERIES.add(
    f"""WITH {scored_ctes(views.INTERACTIONS_SQL, "cosine")}
SELECT channel_id, item_id, other_id, score FROM both_ways"""
)
def similarity_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.symmetric(_pairs_of("cosine")(spark, sf_dir))


@QUERIES.add(
    similar_items_sql(
        views.INTERACTIONS_SQL, "loglikelihood", ranking.SIMILAR_ITEMS_DEFAULT
    )
)
def similar_items_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.similar_items(similarity.symmetric(_pairs_of("loglikelihood")(spark, sf_dir)))


_ALL_ALGOS = " UNION ALL ".join(
    f"SELECT channel_id, '{base}' AS algo_id, item_id, other_id, {sql} AS score FROM pairs"
    for base, sql in SCORE_SQL.items()
)


@QUERIES.add(
    f"""WITH {pair_ctes(views.INTERACTIONS_SQL)},
{PEARSON_CTES},
scored AS (
  {_ALL_ALGOS}
  UNION ALL SELECT channel_id, 'pearson', item_id, other_id, score FROM correlated),
both_ways AS (
  SELECT channel_id, algo_id, item_id, other_id, score FROM scored
  UNION ALL
  SELECT channel_id, algo_id, other_id, item_id, score FROM scored)
SELECT * FROM (
  SELECT *, row_number() OVER (
    PARTITION BY channel_id, algo_id, item_id ORDER BY score DESC, other_id) AS rank
  FROM both_ways) WHERE rank <= {ranking.COMPARISON_SIZE}"""
)
def similar_items_all_algos(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = list(similarity.COUNT_SCORES)
    rows = views.interactions(spark, sf_dir)
    wide = similarity.count_similarities(rows)
    counted = wide.unpivot(["channel_id", "item_id", "other_id"], bases, "algo_id", "score")
    rated = similarity.similarity(rows, similarity.PEARSON).withColumn(
        "algo_id", F.lit(similarity.PEARSON)
    )
    long = counted.unionByName(rated)
    return ranking.compare_algorithms(similarity.symmetric(long))


# --- recommendations -----------------------------------------------------------------------

HISTORY_CTE = """latest AS (
  SELECT channel_id, user_id, time, item_id, action, rating, event_id AS ingest_seq
  FROM interactions
  QUALIFY row_number() OVER (
    PARTITION BY channel_id, user_id, time, item_id ORDER BY event_id DESC) = 1)"""


def recommendations_sql(
    where: str,
    rating: str = "rating",
    unseen: bool = False,
    view: str = views.INTERACTIONS_SQL,
) -> str:
    seen = (
        "WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.channel_id = r.channel_id "
        "AND k.user_id = r.user_id AND k.item_id = r.item_id)"
        if unseen
        else ""
    )
    return f"""WITH {scored_ctes(view, "jaccard")},
{HISTORY_CTE},
known AS (
  SELECT channel_id, user_id, item_id,
         arg_max({rating}, time) FILTER (
           WHERE action = 'rating' AND {rating} IS NOT NULL) AS rating
  FROM latest WHERE {where} GROUP BY channel_id, user_id, item_id),
sums AS (
  SELECT k.channel_id, k.user_id, s.other_id AS item_id,
         sum(s.score * coalesce(k.rating, 1.0)) AS numerator,
         sum(CASE WHEN k.rating IS NULL THEN 0 ELSE s.score END)
         + CASE WHEN arg_min(CASE WHEN k.rating IS NULL THEN 1 ELSE 0 END, k.item_id) = 1
                THEN 1 ELSE 0 END AS denominator
  FROM known k JOIN both_ways s ON s.channel_id = k.channel_id AND s.item_id = k.item_id
  GROUP BY k.channel_id, k.user_id, s.other_id),
ratios AS (
  SELECT channel_id, user_id, item_id,
         CASE WHEN denominator = 0 THEN NULL
              ELSE numerator / CAST(denominator AS DOUBLE) END AS score
  FROM sums)
SELECT * FROM (
  SELECT r.*, row_number() OVER (
    PARTITION BY channel_id, user_id ORDER BY score DESC NULLS LAST, item_id) AS rank
  FROM ratios r {seen}) WHERE rank <= {ranking.RECOMMENDATIONS_DEFAULT}"""


def _history_and_similarity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = views.interactions(spark, sf_dir)
    past = history.latest(history.from_interactions(rows, F.col("event_id")))
    return past, similarity.symmetric(similarity.similarity(rows, "jaccard"))


@QUERIES.add(recommendations_sql("TRUE", rating="CAST(NULL AS DOUBLE)"))
def user_recs_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    past, similarities = _history_and_similarity(spark, sf_dir)
    unrated = past.withColumn("rating", F.lit(None).cast("double"))
    return recommend.recommendations(unrated, similarities)


@QUERIES.add(recommendations_sql("action = 'rating'"))
def user_recs_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    past, similarities = _history_and_similarity(spark, sf_dir)
    return recommend.recommendations(filters.ratings_only(past), similarities)


@QUERIES.add(recommendations_sql("TRUE"))
def user_recs_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommendations(*_history_and_similarity(spark, sf_dir))


@QUERIES.add(recommendations_sql("TRUE", unseen=True))
def user_recs_exclude_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    past, similarities = _history_and_similarity(spark, sf_dir)
    return recommend.recommendations(past, similarities, exclude_seen=True)


# --- published results ---------------------------------------------------------------------

def _one_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one channel."""
    rows = views.interactions(spark, sf_dir)
    return rows.withColumn("channel_id", F.lit(views.ONE_CHANNEL))


@QUERIES.add(recommendations_sql("TRUE", view=views.ONE_CHANNEL_SQL))
def served_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations from the history table and the published version of an algorithm."""
    root = work_folder(spark, "served")
    rows = _one_channel(spark, sf_dir)
    tables.append_history(rows, root, F.col("event_id"))
    algorithm = algorithms.Algorithm(views.ONE_CHANNEL, "AL-1", "jaccard")
    algorithms.run(spark, root, rows, algorithm)
    return algorithms.serve(spark, root, algorithm, ranking.RECOMMENDATIONS_DEFAULT)


@QUERIES.add(
    f"""WITH {scored_ctes(views.ONE_CHANNEL_SQL, "jaccard")}
SELECT channel_id, 'AL-1' AS algo_id, '000002' AS version, item_id, other_id, score
FROM both_ways"""
)
def similarity_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two successful versions and a failed third one; the second is served."""
    root = work_folder(spark, "published")
    channel, algo = views.ONE_CHANNEL, "AL-1"
    rows = _one_channel(spark, sf_dir)
    for actions in (FILTERED_ACTIONS, ()):
        algorithm = algorithms.Algorithm(channel, algo, "jaccard", actions)
        algorithms.run(spark, root, rows, algorithm)
    served = tables.current_results(spark, root, tables.SIMILARITY)
    leftover = served.withColumn("score", F.lit(0).cast("bigint"))
    tables.write_result(leftover, root, tables.SIMILARITY, channel, algo, "000003")
    tables.record_run(
        spark, root, channel_id=channel, algo_id=algo, version="000003",
        start_ms=0, end_ms=1, outcome=algorithms.FAILURE, output="stopped",
    )
    current = tables.current_results(spark, root, tables.SIMILARITY)
    return current.select("channel_id", "algo_id", "version", "item_id", "other_id", "score")


# Ids with characters that mean something in the names of folders.
ODD_IDS = {"AL/1": "cooccurrence", "AL%31": "jaccard", "AL=1 ü": "cosine"}


@QUERIES.add(
    f"""WITH {pair_ctes(views.ONE_CHANNEL_SQL)},
scored AS ({" UNION ALL ".join(
        f"SELECT '{algo}' AS algo_id, item_id, other_id, {SCORE_SQL[base]} AS score FROM pairs"
        for algo, base in ODD_IDS.items())})
SELECT algo_id, item_id, other_id, score FROM scored
UNION ALL SELECT algo_id, other_id, item_id, score FROM scored"""
)
def odd_ids_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algorithms with odd ids, each first registered in another form than it is run in."""
    root, channel = work_folder(spark, "odd-ids"), views.ONE_CHANNEL
    rows = _one_channel(spark, sf_dir)
    for bases in (dict.fromkeys(ODD_IDS, "loglikelihood"), ODD_IDS):
        defined = spark.createDataFrame([(channel, algo, base) for algo, base in bases.items()],
                                        "channel_id string, algo_id string, base string")
        tables.put_catalog(defined, root, tables.ALGORITHMS)
    for algo in ODD_IDS:
        algorithms.run(spark, root, rows, algorithms.stored(spark, root, channel, algo))
    current = tables.current_results(spark, root, tables.SIMILARITY)
    return current.select("algo_id", "item_id", "other_id", "score")


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    symmetric = similarity.symmetric(_pairs_of("loglikelihood")(spark, sf_dir))
    return symmetric.select(
        "*", F.lit("AL-1").alias("algo_id"), F.lit("000001").alias("version")
    )


@QUERIES.add(
    f"""WITH {scored_ctes(views.INTERACTIONS_SQL, "loglikelihood")}
SELECT lower(channel_id) || ':al-1:' || CAST(item_id AS VARCHAR) || ':000001' AS rowkey,
       's' AS family,
       CASE WHEN length(CAST(score AS VARCHAR)) >= 6 THEN CAST(score AS VARCHAR)
            ELSE lpad(CAST(score AS VARCHAR), 6, '0') END
         || ':' || CAST(other_id AS VARCHAR) AS qualifier,
       '1' AS value
FROM both_ways"""
)
def similarity_encoded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.similarity_cells(_published(spark, sf_dir))


@QUERIES.add(
    f"""WITH {scored_ctes(views.INTERACTIONS_SQL, "loglikelihood")}
SELECT lower(channel_id) AS channel_id, 'al-1' AS algo_id, '000001' AS version,
       item_id, other_id, score
FROM both_ways"""
)
def similarity_decoded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.similarities_from_cells(cells.similarity_cells(_published(spark, sf_dir)))


@QUERIES.add(
    f"""WITH {views.ONE_CHANNEL_SQL},
known AS (
  SELECT user_id, item_id, CAST(count(*) * 37 % 11 AS DOUBLE) / 4 AS score FROM interactions GROUP BY ALL)
SELECT '{views.ONE_CHANNEL}' AS channel_id, user_id, item_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM known)
WHERE rank <= 5"""
)
def stored_recommendations_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of a published version of predictions, whose scores are made from counts."""
    root, channel = work_folder(spark, "stored"), views.ONE_CHANNEL
    scored = _one_channel(spark, sf_dir).groupBy("user_id", "item_id").agg(
        ((F.count("*") * 37 % 11).cast("double") / 4).alias("score")
    )
    algorithm = algorithms.Algorithm(channel, "AL-1", "als")
    version = tables.claim_version(spark, root, channel, "AL-1")
    tables.write_result(scored, root, tables.RECOMMENDATIONS, channel, "AL-1", version)
    tables.record_run(spark, root, channel_id=channel, algo_id="AL-1", version=version, outcome=algorithms.SUCCESS)
    return algorithms.serve(spark, root, algorithm, 5)


# --- factorisation: values depend on the solver's arithmetic, so SQL tells the observed pairs and
# --- what must hold for any good solution


ALS_SQL = f"""WITH {views.ONE_CHANNEL_SQL},
observed AS (
  SELECT DISTINCT user_id, item_id FROM interactions WHERE action = 'rating' AND rating IS NOT NULL)"""
ALS_CHECKED_SQL = f"""{ALS_SQL}
SELECT user_id, item_id, TRUE AS in_range, TRUE AS fits FROM observed"""


def _checked(rows: DataFrame, scored: DataFrame, wanted: DataFrame, low: float, high: float) -> DataFrame:
    """Observed pairs, whether each score is in range, and whether the scores fit what they were
    learned from clearly better than each item's mean does."""
    means = wanted.groupBy("item_id").agg(F.avg("goal").alias("mean"))
    both = wanted.join(scored, ["user_id", "item_id"]).join(means, "item_id")
    errors = both.agg(
        F.sum((F.col("goal") - F.col("score")) ** 2).alias("ours"),
        F.sum((F.col("goal") - F.col("mean")) ** 2).alias("plain"),
    )
    fits = errors.select((F.col("ours") < 0.8 * F.col("plain")).alias("fits")).scalar()
    return scored.select(
        "user_id", "item_id", F.col("score").between(low, high).alias("in_range"), fits.alias("fits")
    )


@QUERIES.add(ALS_CHECKED_SQL)
def als_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _one_channel(spark, sf_dir)
    wanted = factorize.ratings(rows).withColumnRenamed("rating", "goal")
    return _checked(rows, factorize.predictions(rows), wanted, -1, 7)


@QUERIES.add(
    f"""{ALS_SQL}
SELECT user_id, item_id, TRUE AS in_range FROM observed"""
)
def als_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implicit scores are about 1 for what was observed, whatever the rating."""
    scored = factorize.predictions(_one_channel(spark, sf_dir), implicit=True)
    return scored.select("user_id", "item_id", F.col("score").between(-1, 4).alias("in_range"))


@QUERIES.add(
    f"""{ALS_SQL}
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS BIGINT) AS rank,
       TRUE AS observed, TRUE AS falling
FROM observed QUALIFY rank <= {ranking.RECOMMENDATIONS_DEFAULT}"""
)
def als_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best stored predictions of every user: ranks, and whether each item was rated by the
    user and scores no more than the one before."""
    rows = _one_channel(spark, sf_dir)
    best = ranking.stored_recommendations(factorize.predictions(rows), by=())
    rated = factorize.ratings(rows).select("user_id", "item_id").distinct().withColumn("rated", F.lit(True))
    above = F.lag("score").over(Window.partitionBy("user_id").orderBy("rank"))
    return best.join(rated, ["user_id", "item_id"], "left").select(
        "user_id",
        "rank",
        F.coalesce("rated", F.lit(False)).alias("observed"),
        F.coalesce(F.col("score") <= above, F.lit(True)).alias("falling"),
    )


@QUERIES.add(
    f"""{ALS_SQL}, known AS (SELECT count(DISTINCT item_id) AS items FROM observed)
SELECT user_id, least(20, items - count(*)) AS found, TRUE AS unseen, TRUE AS falling
FROM observed, known GROUP BY user_id, items HAVING items > count(*)"""
)
def als_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best items a user has not rated, from the factors: how many, and what must hold."""
    rows = _one_channel(spark, sf_dir)
    best, _ = factorize.unseen(rows, 20)
    rated = factorize.ratings(rows).select("user_id", "item_id").distinct().withColumn("rated", F.lit(True))
    above = F.lag("score").over(Window.partitionBy("user_id").orderBy("rank"))
    checked = best.withColumn("right", F.coalesce(F.col("score") <= above, F.lit(True)))
    return checked.join(rated, ["user_id", "item_id"], "left").groupBy("user_id").agg(
        F.count("*").alias("found"),
        F.every(F.col("rated").isNull()).alias("unseen"),
        F.every("right").alias("falling"),
    )


@QUERIES.add(
    """WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x * 1000)::DOUBLE) AS vector FROM embeddings)
SELECT u.vec_id AS user_id, i.vec_id AS item_id, list_inner_product(u.vector, i.vector) AS score,
       row_number() OVER (
         PARTITION BY u.vec_id ORDER BY list_inner_product(u.vector, i.vector) DESC, i.vec_id) AS rank
FROM whole u JOIN whole i ON i.vec_id <> u.vec_id AND i.vec_id <> u.vec_id + 1
QUALIFY rank <= 10"""
)
def largest_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact largest products of all vectors with all others but the next, in whole numbers."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double"))
    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector"))
    users = vectors.withColumnRenamed("vec_id", "user_id")
    seen = users.select("user_id", F.explode(F.array("user_id", F.col("user_id") + 1)).alias("item_id"))
    best, _ = products.largest_products(
        users, vectors.withColumnRenamed("vec_id", "item_id"), seen, 10, block_items=64
    )
    return best
