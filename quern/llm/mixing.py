"""Mixing sources to target weights by a low-discrepancy schedule (operator 3).

The mix is a row of slots, each a block of as many words. Slot i falls to the source in whose share of
the cumulative targets the point frac(i * golden ratio) lies, so each source gets its share of any
stretch of slots, within a few blocks. Each source's documents stand in a fixed shuffled order and
form one stream of words; its slot of rank r takes the words [r * block, (r + 1) * block) of it. Blocks
run on past the stream's end into a second round and end with it.

The number of slots grows with the mix: `slots`, or more once a block would be over `most_block` words.

Defined cases: null text has size 0; a document without words takes 0 and has no slot; a null source
is a source of its own, last in order; a source with a target but no slot gets one at the end; equal
rows stand next to one another and each counts; an empty table gives an empty table; columns besides
doc_id, text and source are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, store, table

GOLDEN = 0.6180339887498949


def sizes(docs: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    return docs.select("doc_id", "source", F.md5(key.cast("binary")).alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source: source, source_size, weight, target. One row per source throughout.

    Resharing the excess until nobody is above the limit ends where every source below its limit
    has level * weight, with one level for all; limits are reached in order of limit / weight.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto, past = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("level", (F.lit(share) * F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(past))
    fits = F.col("limit") >= F.col("level") * F.col("weight")
    # levels rise while sources still run into their limit; the first that fits is the smallest at which all later ones fit
    first = F.min(F.when(fits, F.struct((F.col("limit") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.withColumn("first", first).select("source", "source_size", "weight", F.coalesce(F.least(F.col("limit"), F.col("first.level") * F.col("weight")), F.col("limit")).alias("target"))


def _ranked(df: DataFrame, chunk: str, order: list, size, name: str) -> DataFrame:
    """df with `name`: the sum of size over the rows of its source that stand before, by chunk, then order; no task holds more than a chunk."""
    df = df.withColumn("_n", size)
    sums = df.groupBy("source", chunk).agg(F.sum("_n").alias("_all"))
    before = sums.select(F.col("source").alias("_s"), F.col(chunk).alias("_k"), F.coalesce(F.sum("_all").over(Window.partitionBy("source").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("source", chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn(name, inner).join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col(chunk) == F.col("_k")))
    return df.withColumn(name, (F.col(name) + F.col("_b")).cast("long")).drop("_n", "_s", "_k", "_b", chunk)


def blocks(words: int, slots: int, most_block: int) -> tuple[int, int]:
    """Words of a block and number of slots for a mix of so many words."""
    block = max(1, min(-(-words // slots), most_block))
    return block, max(1, (words + block // 2) // block)


def schedule(spark: SparkSession, goals: DataFrame, slots: int, step: float = GOLDEN, cells: int = 4096) -> DataFrame:
    """(slot, source, rank) for every slot, and one further slot for each source with a target but none."""
    goals = goals.filter("target >= 0.5")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    spans = goals.select("source", F.sum("target").over(order).alias("hi"), F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    spans = spans.select("source", (F.col("hi") / F.col("all")).alias("hi"), F.coalesce(F.lag(F.col("hi") / F.col("all")).over(order), F.lit(0.0)).alias("lo"))
    # the points are put in cells so that they meet the sources' spans by equality; a span covers the cells it touches
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"pmod((id + 1) * {step!r}D, 1D)").alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    cover = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(1 - 1e-12)) * cells))))
    hits = points.join(cover, "cell").filter("x >= lo and x < hi").select("slot", "source")
    none = spans.select("source").join(hits.select("source").distinct().withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left_anti")
    late = none.select((F.row_number().over(order) - 1 + slots).cast("long").alias("slot"), "source")
    return _ranked(hits.unionByName(late).withColumn("chunk", F.expr("slot div 65536")), "chunk", ["slot"], F.lit(1).cast("long"), "rank")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, slots: int = 65536, most_block: int = 65536, step: float = GOLDEN) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, blocks): see the module's text. blocks: those the document stands in."""
    spark = docs.sparkSession
    sized = store(sizes(docs))  # the only pass over the texts
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block, slots = blocks(math.floor(min(share, most) * words), slots, most_block)
    goals = store(targets(sized, weights, share, most))
    plan = store(schedule(spark, goals, slots, step))
    parts = plan.groupBy("source").agg(F.count("*").alias("parts")).withColumnRenamed("source", "ps")
    digits = 3 if rows < 1 << 28 else 5  # a bucket is a stretch of the shuffled order
    g = goals.select(F.col("source").alias("gs"), "source_size", "target")
    placed = _ranked(sized.filter("size > 0").withColumn("bucket", F.substring("h", 1, digits)), "bucket", ["h", "doc_id", "size"], F.col("size"), "at")
    placed = placed.join(g, F.col("source").eqNullSafe(F.col("gs"))).drop("gs", "h")
    rounds = placed.join(parts, F.col("source").eqNullSafe(F.col("ps"))).withColumn("start", F.explode(F.array(F.col("at"), F.col("at") + F.col("source_size"))))
    rounds = rounds.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("parts") * block)).filter("start < end")
    pieces = rounds.withColumn("rank", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")))
    of = plan.select(F.col("source").alias("bs"), F.col("rank").alias("br"), "slot")
    pieces = pieces.join(of, F.col("source").eqNullSafe(F.col("bs")) & (F.col("rank") == F.col("br")))
    part = F.least("end", (F.col("rank") + 1) * block) - F.greatest("start", F.col("rank") * block)
    key = ["source", "at", "doc_id", "size", "source_size", "target"]
    out = pieces.select(*key, part.alias("part"), "slot").unionByName(placed.select(*key, F.lit(0).cast("long").alias("part"), F.lit(None).cast("long").alias("slot")))
    out = out.groupBy(*key).agg(F.sum("part").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("blocks"))
    none = sized.filter("size = 0").join(g, F.col("source").eqNullSafe(F.col("gs"))).select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("blocks"))
    return out.drop("at").unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "blocks")


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS lim FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE lim >= level * weight ORDER BY lim / weight, level LIMIT 1),
g AS (SELECT source, source_size, least(lim, coalesce((SELECT level FROM f) * weight, lim)) AS target FROM l),
t AS (SELECT CAST(floor(1.5::DOUBLE * coalesce(sum(size), 0)) AS BIGINT) AS words FROM d),
b AS (SELECT words, greatest(1, least((words + 65535) // 65536, 65536)) AS block FROM t),
n AS (SELECT block, greatest(1, (words + block // 2) // block) AS slots FROM b),
spans AS (SELECT source, sum(target) OVER (ORDER BY source ASC NULLS LAST) / sum(target) OVER () AS hi FROM g WHERE target >= 0.5),
span AS (SELECT source, hi, coalesce(lag(hi) OVER (ORDER BY hi), 0) AS lo FROM spans),
point AS (SELECT range AS slot, (range + 1)::DOUBLE * {GOLDEN!r}::DOUBLE % 1 AS x FROM range((SELECT slots FROM n))),
hit AS (SELECT slot, source FROM point JOIN span ON x >= lo AND x < hi),
late AS (SELECT (SELECT slots FROM n) + row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS slot, source FROM span WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.source IS NOT DISTINCT FROM span.source)),
plan AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM (SELECT * FROM hit UNION ALL SELECT * FROM late)),
parts AS (SELECT source, count(*) AS parts FROM plan GROUP BY source),
p AS (SELECT d.*, row_number() OVER () AS id, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM d),
r AS (SELECT id, p.source, a + o * source_size AS start, least(a + o * source_size + size, parts * block) AS "end"
      FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source JOIN parts ON p.source IS NOT DISTINCT FROM parts.source, n, (VALUES (0), (1)) AS v(o) WHERE size > 0),
q AS (SELECT id, source, start, "end", unnest(range(start // block, ("end" - 1) // block + 1)) AS rank FROM r, n WHERE start < "end"),
x AS (SELECT id, CAST(sum(least("end", (q.rank + 1) * block) - greatest(start, q.rank * block)) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS blocks
      FROM q JOIN plan ON q.source IS NOT DISTINCT FROM plan.source AND q.rank = plan.rank, n GROUP BY id)
SELECT p.doc_id, p.size, g.source_size, g.target, coalesce(taken, 0) AS taken, first_slot, coalesce(blocks, 0) AS blocks
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN x ON p.id = x.id
"""
