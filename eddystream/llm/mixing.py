"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; a running sum over the buckets
finds the one in which a source's budget ends, and only that bucket is summed
again by finer buckets. Documents are then kept by comparing hashes with two
numbers a source: nothing is sorted. Budgets of one order are nested: with a
larger budget every document kept before is kept again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddystream.llm.common import plain, stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
WORDS = r"[^\x20\x09-\x0D]+"
#: As many sources at most are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Hex digits of a document's hash that make a coarse bucket, then a fine one within it.
COARSE, FINE = 3, 6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hex_of(doc_id: Column, text: Column) -> Column:
    """The hash that orders documents: of the id alone where there is one, else of the text."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit("")))).cast("binary"))


def bucket(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_size) with each source's target: weights by code point order of the sources, filled as water is.

    A source that reaches ``most`` times its size stops; the others share what
    it leaves by weight. Sorted by the level at which they stop, the stopped
    ones come first, so one running sum finds the level. There is one row a
    source here, never a document; only these few rows go through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", (most * F.col("source_size")).cast("double"))
    whole = Window.partitionBy()
    upto = Window.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_w", F.sum("w").over(whole))
        .withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("gone_w", F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("gone_w")))
        .withColumn("stays", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("found", F.min(F.when(F.col("stays"), F.struct(F.col("cap") / F.col("w"), "i", "level"))).over(whole))
    )
    return level.select("source", "source_size", F.least("cap", F.col("found.level") * F.col("w")).alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of its source, its size, and its coarse and fine bucket."""
    return (
        docs.withColumn("_digest", hex_of(F.col("doc_id"), F.col("text"))).withColumn("_key", _key(F.col("source")))
        .withColumn("_size", n_words(F.col("text")))
        .withColumn("_coarse", bucket(F.col("_digest"), COARSE)).withColumn("_fine", bucket(F.col("_digest"), FINE)).drop("_digest")
    )


def budgets(base: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(_key, source_size, target, full, cut) of each source of ``base`` (source and the columns of :func:`_hashed`).

    A document is taken ``full`` times, and once more if its fine bucket is below ``cut``.
    """
    goal = targets(base.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, most)
    goal = (
        goal.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("_key", _key(F.col("source"))).drop("source")
    )
    goal = stored(goal, "mix-targets")
    rest = goal.select("_key", "rest")

    def ends(parts: DataFrame, by: str) -> DataFrame:
        """Each source's bucket in which its running sum passes the budget, with the sums before and in it."""
        upto = Window.partitionBy("_key").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        run = parts.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        return run.join(rest, "_key").where("before <= rest and before + n > rest").groupBy("_key").agg(F.min(F.struct(by, "before", "n")).alias("at"))

    coarse = base.groupBy("_key", "_coarse").agg(F.sum("_size").alias("n")).withColumn("start", F.lit(0).cast("long"))
    edge = ends(coarse, "_coarse").select("_key", F.col("at._coarse").alias("_coarse"), F.col("at.before").alias("start"))
    # by both columns: a source may hold any share of the rows
    edge = F.broadcast(edge) if goal.count() <= BROADCAST_SOURCES else edge.repartition("_key", "_coarse")
    finer = base.join(edge, ["_key", "_coarse"]).groupBy("_key", "start", "_fine").agg(F.sum("_size").alias("n"))
    cut = ends(finer, "_fine").join(rest, "_key")
    # the fine bucket in which the budget ends is taken if that comes nearer to the budget
    cut = cut.select("_key", (F.col("at._fine") + F.when(2 * (F.col("rest") - F.col("at.before")) > F.col("at.n"), 1).otherwise(0)).alias("cut"))
    return stored(goal.drop("rest").join(cut, "_key", "left").withColumn("cut", F.coalesce("cut", F.lit(0))), "mix-budgets")


def apply(base: DataFrame, goal: DataFrame) -> DataFrame:
    """``base`` with size, source_size, target, and times: how often the mix takes each row."""
    goal = F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal
    times = F.col("full") + F.when(F.col("_fine") < F.col("cut"), 1).otherwise(0)
    out = base.join(goal, "_key").withColumn("times", times).withColumnRenamed("_size", "size")
    return out.drop("_key", "_coarse", "_fine", "full", "cut")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    ``taken`` is the document's words times how often the mix takes it: every
    document as often as the target holds its source whole, and those below
    the source's hash threshold once more. The threshold is the bucket bound
    nearest to the budget. Rows with one id (or, without an id, one text) share
    a hash, and so a fate. Null text has size 0; a null source is a source;
    an empty table gives no rows.
    """
    base = stored(_hashed(plain(docs, "doc_id", "text", "source")).drop("text"), "mix-sizes")
    out = apply(base, budgets(base, weights, most))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, each as often as it takes it, with all their columns."""
    base = stored(_hashed(plain(docs, "doc_id", "text", "source")).drop("text", "doc_id"), "mix-sizes")
    whole = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    out = apply(_hashed(whole), budgets(base, weights, most)).where("times > 0 and size > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("_row.*")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH base AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))), 1, 3) AS BIGINT) AS coarse,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))), 1, 6) AS BIGINT) AS fine
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i
  FROM base GROUP BY source
), weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CAST(3 * source_size AS DOUBLE) AS cap FROM sizes
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0)) /
            (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size,
         least(cap, w * (SELECT level FROM levels WHERE level * w <= cap ORDER BY cap / w, i LIMIT 1)) AS target
  FROM levels
), goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_times,
         target - source_size * CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rest
  FROM goal
), fines AS (
  SELECT source, fine, sum(size) AS n FROM base GROUP BY source, fine
), run AS (
  SELECT f.source, f.fine, f.n, g.rest, sum(f.n) OVER (PARTITION BY f.source ORDER BY f.fine) - f.n AS before
  FROM fines f JOIN goals g ON f.source IS NOT DISTINCT FROM g.source
), cut AS (
  SELECT source, min(fine + CASE WHEN 2 * (rest - before) > n THEN 1 ELSE 0 END) AS cut
  FROM run WHERE before <= rest AND before + n > rest GROUP BY source
)
SELECT b.doc_id, CAST(b.size AS BIGINT) AS size, g.source_size, g.target,
       CAST(b.size * (g.full_times + CASE WHEN b.fine < coalesce(c.cut, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source
LEFT JOIN cut c ON c.source IS NOT DISTINCT FROM g.source
"""
