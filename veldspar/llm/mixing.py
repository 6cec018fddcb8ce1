"""Mixing sources to target weights: native DataFrame operations only.

Tokens are summed by source, the budget is shared by weight under a cap for each source, and the repetition
rate of a source is its target over its size. Each document is emitted floor(rate) times, plus one copy by a
Bernoulli draw whose probability is the rate's fraction. The draw is a hash of the document's id and text, so it needs
no shuffle, doesn't depend on other documents, and is the same in each run. The words that a source takes stray from
its target as independent draws do: by sqrt(f * (1 - f) * sum of size^2) with f the fraction.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a source of size 0
has target 0; rows that repeat a doc_id are documents of their own, and only those with the same text too draw alike;
extra columns may have any name; an empty table gives an empty result. A hot source is summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET, CAP, SEED = 1.5, 2.0, "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1): the first 48 bits of an MD5 of the seed, the id and the text's MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, size) rows -> (source, source_size, target): budget * all sizes shared by weight, target <= cap * size.

    Water level: with sources in the order of cap * size / weight, those that fill up are a prefix (past it the
    water only falls, so the level that counts is its highest value among the rest), and the others
    share what is left by weight. The windows run over one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    so_far = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    share = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", share)
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("left", F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(so_far), F.lit(0.0)))
        .withColumn("water", F.col("left") / F.sum("weight").over(rest))
        .withColumn("full", F.col("level") <= F.col("water"))
        .withColumn("open", F.max(F.when(~F.col("full"), F.col("water"))).over(every))
        .select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("open")).alias("target"))
    )


def _copied(sized: DataFrame, sizes: DataFrame, **shares) -> DataFrame:
    """sized(source, size, u, ...) with source_size, target, rate and copies, by the targets of sizes(source, size).

    The targets are a written table of one row for each source, so that Spark knows its size when it picks the join."""
    aims = written(targets(sizes, **shares).withColumnRenamed("source", "aim"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    return sized.join(aims, F.col("source").eqNullSafe(F.col("aim"))).withColumn("rate", rate).withColumn("copies", (whole + (F.col("u") < F.col("rate") - whole).cast("long")).cast("long")).drop("aim", "u")


def mix_plan(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies for each row of docs(doc_id, text, source)."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u")), "mix-sizes")
    return _copied(sized, sized, **shares)


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """docs with each row repeated as mix_plan() says, in the same columns. Each row carries its own draw: texts aren't
    shuffled unless the sources are too many to be broadcast."""
    size = word_count(F.col("text")).alias("size")
    rows = docs.select(F.struct("*").alias("row"), "source", size, draw(F.col("doc_id"), F.col("text"), seed).alias("u"))
    plan = _copied(rows, docs.select("source", size), **shares).where("copies > 0")
    return plan.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op10(docs: DataFrame) -> DataFrame:
    plan = mix_plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


#: DuckDB SQL for op10's rows.
OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT / {float(1 << 48)!r} AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS level FROM w),
t AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
         - coalesce(sum(most) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM l),
o AS (SELECT *, max(CASE WHEN level > water THEN water END) OVER () AS open FROM t),
a AS (SELECT source, source_size, CASE WHEN level <= water THEN most ELSE weight * open END AS target FROM o),
r AS (SELECT d.doc_id, d.size, a.source_size, a.target, d.u,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate
      FROM sized d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
z AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, rate, copies FROM z
"""
