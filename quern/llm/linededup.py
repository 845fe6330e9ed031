"""Removal of repeated line chunks (operator 6), DataFrame operations only.

A document's lines are hashed. A chunk ends where the bytes of its lines reach `least`, or at `most`
lines; so a boundary depends on what the chunk holds, not on where it stands, and moves along with a
shifted passage. A chunk starts at each line: boundaries chosen by one rolling hash leave a short
passage without a whole chunk, so those of all phases are kept. Chunks, told by the rolled hash of
their line hashes, that occur more than once are compared byte by byte (they are grouped by their
text) and all but the first are removed; first is the smallest (doc_id, hash of the text, line). As
chunks overlap, a repeated passage goes from its first line to its last.

Hashes alone are counted. Texts move once, all of them, to meet the chunks that occur again; those
that have such chunks move a second time, to meet the decision.

Defined cases: null and empty texts stay as they are; a document may lose all of its lines (its text
is then empty); rows equal in doc_id and text are one document and lose the same lines; a null
doc_id comes first; what repeats is left alone where it has neither `least` bytes nor `most` lines of
`blank` bytes together; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, store, table


def _once(expr):
    """A generator of one row: the optimiser doesn't copy what is below it into lambdas, where it would run for each element."""
    return F.explode(F.array(expr))


def _chunks(docs: DataFrame, least: int, most: int, blank: int) -> DataFrame:
    """(_id, _th, s, e, h): the chunks that may be removed."""
    d = docs.filter("text is not null").select("_id", "_th", _once(F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), F.octet_length(x).alias("n")))).alias("l"))
    # from each line on as many lines as it takes to reach the bytes; the hash rolls along
    roll = f"aggregate(slice(l, i + 1, {most}), struct(0 as k, 0 as n, 0L as h), (a, x) -> if(a.n >= {least}, a, struct(a.k + 1 as k, a.n + x.n as n, xxhash64(a.h, x.h) as h)))"
    d = d.select("_id", "_th", F.posexplode(F.expr(f"transform(sequence(0, size(l) - 1), i -> {roll})")).alias("s", "c"))
    return d.filter(f"c.n >= {least} or c.k = {most} and c.n >= {blank}").select("_id", "_th", "s", (F.col("s") + F.col("c.k")).alias("e"), "c.h")


def dedup(docs: DataFrame, least: int = 160, most: int = 8, blank: int = 40, lost: str = "_lines") -> DataFrame:
    """docs with repeated chunks taken out of text; the further column `lost` has how many lines went.

    All other columns travel under numbers, so that none clashes with a name used here.
    """
    other = {c: f"o{i}" for i, c in enumerate(docs.columns) if c != "text"}
    keyed = docs.select("text", F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), *(F.col(f"`{c}`").alias(o) for c, o in other.items()))
    chunks = store(_chunks(keyed, least, most, blank))
    again = chunks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    seen = chunks.join(again.hint("merge"), "h", "left_semi").groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "e")).alias("c"))
    same = lambda a, b: a["_id"].eqNullSafe(b["id2"]) & (a["_th"] == b["th2"])
    spots = seen.select(F.col("_id").alias("id2"), F.col("_th").alias("th2"), "c")
    spotted = store(keyed.join(spots.hint("merge"), same(keyed, spots), "left").drop("id2", "th2"))
    forget(chunks)
    some = spotted.filter("c is not null")
    found = some.select("_id", "_th", "c", _once(F.split("text", "\n", -1)).alias("l")).select("_id", "_th", "l", F.explode("c").alias("c"))
    found = store(found.select("_id", "_th", "c.s", "c.e", F.expr("array_join(slice(l, c.s + 1, c.e - c.s), '\\n')").alias("chunk")))
    first = store(found.groupBy("chunk").agg(F.min(F.struct("_id", "_th", "s")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    drops = found.join(first.hint("merge"), "chunk").filter(~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_th") == F.col("first._th")) & (F.col("s") == F.col("first.s"))))
    # what stays between the ranges that go: from where all before have ended to where the next begins
    upto = F.max("e").over(Window.partitionBy("_id", "_th").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    stay = drops.groupBy("_id", "_th", "s").agg(F.max("e").alias("e")).withColumn("from", F.coalesce(upto, F.lit(0)))
    stay = stay.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.when(F.col("s") > F.col("from"), F.struct("from", F.col("s").alias("to"))))).alias("d"), F.max("e").alias("last"))
    stay = store(stay.select(F.col("_id").alias("id2"), F.col("_th").alias("th2"), "d", "last"))
    forget(found, first)
    out = some.drop("c").join(stay.hint("merge"), same(some, stay), "left")
    out = out.withColumn("_all", _once(F.when(F.col("last").isNotNull(), F.split("text", "\n", -1))))
    out = out.withColumn("_kept", _once(F.expr("concat(flatten(transform(d, r -> slice(_all, r.from + 1, r.to - r.from))), slice(_all, last + 1, size(_all) - last))")))
    gone = F.when(F.col("last").isNotNull(), F.size("_all") - F.size("_kept")).otherwise(0).cast("long")
    text = F.when(F.col("last").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col("text"))
    columns = lambda text, gone: [*((F.col(other[c]) if c in other else text).alias(c) for c in docs.columns), gone.alias(lost)]
    return out.select(*columns(text, gone)).unionByName(spotted.filter("c is null").select(*columns(F.col("text"), F.lit(0).cast("long"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", F.col("_lines").alias("lines_removed"))


#: For documents whose ids differ; the order of texts of one id is a hash's.
SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(len(l))) AS s FROM d),
k AS (SELECT *, list_max(list_filter(range(1, 9), lambda k: s + k <= len(l) AND coalesce(list_sum(list_transform(l[s + 1:s + k - 1], lambda x: strlen(x))), 0) < 160)) AS k FROM s),
n AS (SELECT *, list_sum(list_transform(l[s + 1:s + k], lambda x: strlen(x))) AS n FROM k),
c AS (SELECT doc_id, s, k, row_number() OVER (PARTITION BY array_to_string(l[s + 1:s + k], chr(10)) ORDER BY doc_id NULLS FIRST, s) AS r FROM n WHERE n >= 160 OR k = 8 AND n >= 40),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS i FROM c WHERE r > 1),
stay AS (SELECT s.doc_id, string_agg(l[s + 1], chr(10) ORDER BY s) AS text, count(*) AS n FROM s
         WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id IS NOT DISTINCT FROM s.doc_id AND gone.i = s.s) GROUP BY s.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(stay.text, '') END AS text, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.l) - coalesce(stay.n, 0) END AS lines_removed
FROM d LEFT JOIN stay ON d.doc_id IS NOT DISTINCT FROM stay.doc_id
"""
