"""The rule catalogue as a table, and the searches it gives rise to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.catalog import CATEGORIES, RULES, Rule
from keysift.functions.literals import literal_table
from keysift.functions.text import sql_text


def rules_frame(spark: SparkSession, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per rule, in evaluation order."""
    order = {c: i for i, c in enumerate(CATEGORIES, 1)}
    return literal_table(
        spark, "ord, secret_id, category, category_ord, category_label, label, confidence, search_query",
        [(i, r.secret_id, r.category, order.get(r.category, len(order) + 1), CATEGORIES.get(r.category, r.category),
          r.label, r.confidence, r.search_query) for i, r in enumerate(rules or RULES, 1)])


def rules_listing(spark: SparkSession, detections: DataFrame | None = None,
                  rules: Sequence[Rule] | None = None) -> DataFrame:
    """Rules by category, with how often each was found when ``detections`` are given."""
    frame = rules_frame(spark, rules)
    if detections is not None:
        found = detections.groupBy("secret_id").agg(F.count("*").alias("n"))
        frame = frame.join(found, "secret_id", "left").withColumn("n_detections", F.coalesce("n", F.lit(0))).drop("n")
    return frame.orderBy("category_ord", "ord")


def query_list(requests: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The searches of each request: one row per distinct query text, in request order.

    ``requests`` has request_id, secret_ids (array) and search_qualifier.  A lone ALL
    (any case) stands for every rule; unknown ids and rules without a search text are
    skipped; the qualifier is appended; of equal texts the first is kept.  All of it happens inside the request's
    own short array, so nothing is shuffled.
    """
    rules = [r for r in rules or RULES if r.phrases]
    if not rules:
        return requests.selectExpr("request_id", "1 AS query_ord", "'' AS query").where("false")
    catalogue = "map(" + ", ".join(f"{sql_text(r.secret_id)}, {sql_text(r.search_query)}" for r in rules) + ")"
    every = ", ".join(sql_text(r.secret_id) for r in rules)
    wanted = (f"CASE WHEN size(secret_ids) = 1 AND upper(get(secret_ids, 0)) = 'ALL' THEN array({every}) "
              "ELSE transform(secret_ids, i -> upper(i)) END")
    texts = f"array_compact(transform({wanted}, i -> try_element_at({catalogue}, i)))"
    qualified = f"transform({texts}, q -> trim(concat_ws(' ', q, nullif(trim(search_qualifier), ''))))"
    return (requests.select("request_id", F.posexplode_outer(F.expr(f"array_distinct({qualified})"))
                            .alias("pos", "query"))
            .where("query IS NOT NULL").select("request_id", (F.col("pos") + 1).alias("query_ord"), "query"))
