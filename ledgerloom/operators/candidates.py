"""Ranking the most likely ledger numbers for invoices the cascade could not place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.config import Config
from ledgerloom.functions.keys import supplier_key
from ledgerloom.operators.similar import similar_names
from ledgerloom.sources.scratch import cut


def number_groups(ledger: DataFrame) -> DataFrame:
    """One row per ledger number: its amount, and supplier and date of its first row."""
    first = F.min(F.struct("row_no", "supplier_key", F.col("invoice_date").alias("ledger_date"),
                           "invoice_number", F.col("supplier").alias("ledger_supplier")))
    return (ledger.where("invoice_key is not null and row_no is not null").groupBy("invoice_key").agg(
        F.coalesce(F.sum("incl"), F.lit(0)).try_cast("decimal(18,2)").alias("amount"), first.alias("first"))
        .select("invoice_key", "amount", "first.*").drop("row_no").where("supplier_key is not null"))


def _keep_smallest_keys(points: DataFrame, group: list[str], limit: int) -> DataFrame:
    """Rows equal in ``group`` get equal scores and ties go to the smaller number, so beyond the first
    ``limit`` numbers a group can add nothing to any ranking."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy("invoice_key"))
    return points.withColumn("rn", rn).where(F.col("rn") <= limit).drop("rn")


def _days_asked(queries: DataFrame, points: DataFrame, reach: int) -> DataFrame:
    """Queries with each ``ledger_date`` in reach on which their supplier has points.

    Most days in reach have none. Days are kept in blocks as long as a reach, so a query meets two blocks of its
    supplier and not every day of them.
    """
    def block(day: Column) -> Column:
        return F.floor(F.unix_date(day) / (2 * reach + 1))

    days = points.where("ledger_date is not null").select("supplier_key", "ledger_date").distinct().groupBy(
        "supplier_key", block(F.col("ledger_date")).alias("block")).agg(F.collect_list("ledger_date").alias("days"))
    first, last = F.date_sub("query.date", reach), F.date_add("query.date", reach)
    met = queries.where("query.date is not null").withColumns({
        "first": first, "last": last, "block": F.explode(F.array_distinct(F.array(block(first), block(last))))})
    return met.join(days, ["supplier_key", "block"]).select(
        *queries.columns, "first", "last", F.explode("days").alias("ledger_date")).where(
        "ledger_date between first and last").drop("first", "last")


def _nearest(probes: DataFrame, points: DataFrame, part: list[str], limit: int) -> DataFrame:
    """(query, invoice_key): for each probe the ``limit`` nearest amounts on either side in its part.

    Every point first collects its own ``limit`` nearest on that side; merged in amount order with the
    probes, the latest such list is carried to each probe. No probe meets the whole part.
    """
    query_type = probes.schema["query"].dataType

    def one_side(amount_order) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(amount_order(F.col("amount")), F.col("invoice_key").desc())
        p = points.select(*part, "amount", F.lit(None).cast(query_type).alias("query"),
                          F.collect_list("invoice_key").over(w.rowsBetween(1 - limit, 0)).alias("near"),
                          "invoice_key")
        q = probes.select(*part, F.col("query.total").alias("amount"), "query",
                          F.lit(None).cast("array<string>").alias("near"),
                          F.lit(None).cast("string").alias("invoice_key"))
        carry = (Window.partitionBy(*part)
                 .orderBy(amount_order(F.col("amount")), F.col("query").isNotNull(), F.col("invoice_key").desc())
                 .rowsBetween(Window.unboundedPreceding, 0))
        return (p.unionByName(q).withColumn("carried", F.last("near", True).over(carry))
                .where("query is not null").select("query", F.explode("carried").alias("invoice_key")))

    return one_side(F.asc).unionByName(one_side(F.desc))


def _nearest_of(queries: DataFrame, points: DataFrame, keys: list[str], buckets: Column, limit: int) -> DataFrame:
    """(query, invoice_key) of the nearest amounts among points with equal keys.

    Only distinct keys and totals are looked up, so queries that share them do not crowd one part. Points of parts that
    nobody asks for are left out first.
    """
    asked = queries.where("query.total is not null").withColumn("total", F.col("query.total"))
    probes = asked.select(*keys, "total").distinct().withColumn("query", F.struct(*keys, "total"))
    probes, part = probes.withColumn("bucket", buckets), [*keys, "bucket"]
    points = points.join(probes.select(*part).distinct(), part, "left_semi")
    found = _nearest(probes, points, part, limit).distinct()
    return asked.join(found.select("query.*", "invoice_key"), [*keys, "total"]).select("query", "invoice_key")


def _score(cfg: Config) -> Column:
    diff = F.coalesce(F.greatest(cfg.amount_weight - F.abs(F.col("amount_diff")), F.lit(0)), F.lit(0))
    gap = F.coalesce(F.greatest(cfg.date_weight - F.col("date_gap"), F.lit(0)), F.lit(0))
    return (diff + gap).cast("double") + F.col("similarity") * cfg.similarity_weight


def rank_candidates(docs: DataFrame, ledger: DataFrame, cfg: Config) -> DataFrame:
    """Top candidates of every document (doc_id, supplier, invoice_date, total), best first.

    Scoring all ledger numbers of a supplier for each of its documents is a product. A number can be
    among the best only if it is one of the supplier's first numbers (no points for amount or date), of
    the first numbers of a date in reach, of the nearest amounts in reach, or of the nearest amounts on a
    date in reach. Those few are looked up by equi-joins and merges, so the result equals the full
    ranking. Documents with equal supplier, date and total share one lookup. The similar suppliers and
    their ledger numbers serve every lookup and are stored.
    """
    k, reach = cfg.candidate_limit, cfg.date_weight - 1
    width = 2 * cfg.amount_weight
    named = docs.select("doc_id", supplier_key(F.col("supplier")).alias("name"),
                        F.col("invoice_date").alias("date"), F.col("total").try_cast("decimal(18,2)").alias("total")
                        ).where("name is not null")
    groups = number_groups(ledger)
    suppliers = ledger.where("invoice_key is not null").select(F.col("supplier_key").alias("name"))
    pairs = cut(similar_names(named.select("name"), suppliers, cfg).select(
        F.col("left_name").alias("name"), F.col("right_name").alias("supplier_key"), "similarity"))
    queries = named.select("name", "date", "total").distinct().join(pairs, "name").select(
        F.struct("name", "date", "total").alias("query"), "supplier_key")
    points = cut(groups.join(pairs.select("supplier_key").distinct(), "supplier_key", "left_semi"))

    def bucket(amount: Column) -> Column:
        return F.floor(amount / width)

    dated = cut(_days_asked(queries, points, reach))
    by_amount = F.explode(F.array_distinct(F.array(
        bucket(F.col("query.total") - cfg.amount_weight), bucket(F.col("query.total") + cfg.amount_weight))))
    amounts = points.withColumn("bucket", bucket(F.col("amount")))

    found = [
        queries.join(_keep_smallest_keys(points, ["supplier_key"], k), "supplier_key").select("query", "invoice_key"),
        dated.join(_keep_smallest_keys(points, ["supplier_key", "ledger_date"], k),
                   ["supplier_key", "ledger_date"]).select("query", "invoice_key"),
        _nearest_of(queries, _keep_smallest_keys(amounts, ["supplier_key", "bucket", "amount"], k),
                    ["supplier_key"], by_amount, k),
        _nearest_of(dated, _keep_smallest_keys(amounts.where("ledger_date is not null"),
                                               ["supplier_key", "ledger_date", "bucket", "amount"], k),
                    ["supplier_key", "ledger_date"], by_amount, k),
    ]
    scored = (found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).distinct()
              .select("query", F.col("query.name").alias("name"), "invoice_key")
              .join(points, "invoice_key").join(pairs, ["name", "supplier_key"])
              .withColumns({"amount_diff": (F.col("amount") - F.col("query.total")).try_cast("decimal(18,2)"),
                            "date_gap": F.abs(F.datediff("query.date", "ledger_date"))})
              .withColumn("score", _score(cfg)))
    best = scored.withColumn("rank", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "invoice_key"))).where(F.col("rank") <= k)
    best = best.select(
        F.col("name").alias("q_name"), F.col("query.date").alias("q_date"), F.col("query.total").alias("q_total"),
        "rank", "invoice_number", "ledger_supplier", "ledger_date", "amount", "amount_diff", "date_gap", "score")
    return named.join(best, (named.name == best.q_name) & named["date"].eqNullSafe(best.q_date)
                      & named.total.eqNullSafe(best.q_total)).select(
        "doc_id", "rank", "invoice_number", "ledger_supplier", "ledger_date", "amount", "amount_diff",
        "date_gap", "score")
