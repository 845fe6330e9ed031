"""SimHash near-duplicates by deletion-variant signatures (operator 9).

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes of the text's word shingles.
For links at two or fewer differing bits a fingerprint is cut into two halves, so that one of them
differs by at most one bit: each half is indexed 32 times, once with each bit struck out, and equal
signatures are verified. Equal fingerprints are one node from the start.

A signature that more than `small` fingerprints share isn't expanded into pairs. Its fingerprints
take the exact way of few rows for each: every fingerprint with two bits struck out, in each of 2016
ways. Those that share such a signature differ in these two bits at most, so all of them link and a
star to the smallest keeps their component. No pair is lost, none within a group is enumerated.

Defined cases: null or wordless text has fingerprint zero, which links like any other; fewer words
than a shingle count as one shingle; a null doc_id takes part, but a component's id is the smallest
doc_id that isn't null; repeated rows share a fingerprint; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import components, forget, store, table

CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint. bytes.lower() and bytes.split() know ASCII only, as is asked for."""
    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) >= words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        s, e = starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist()
        h = np.array([h64(joined[a:b], seed) for a, b in zip(s, e)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(starts)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def _prints(words: int, seed: int):
    def run(it):
        for b in it:
            fp = [fingerprint(x, words, seed) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64())], names=["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp): th is the text's hash, by which rows of one id are told apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(_prints(words, seed), "doc_id long, th long, fp long")


def links(fps: DataFrame, small: int = 64) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b): enough links for the components at two or fewer differing bits."""
    half = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.expr("fp & 4294967295").alias("v")), F.struct(F.lit(1).alias("side"), F.expr("shiftrightunsigned(fp, 32)").alias("v"))))
    sigs = fps.select("fp", half.alias("x")).select("fp", "x.*", F.explode(F.expr("sequence(0, 31)")).alias("p"))
    sigs = sigs.select("fp", F.expr("(v & ~shiftleft(1L, p)) | shiftleft(cast(p as long), 32) | shiftleft(cast(side as long), 37)").alias("sig"))
    sigs = sigs.repartition("sig")  # one exchange, which counting and joining share
    shared = sigs.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    members = store(sigs.join(shared.hint("merge"), "sig"))
    few = members.filter(F.col("n") <= small).groupBy("sig").agg(F.sort_array(F.collect_set("fp")).alias("f"))
    pairs = few.select(F.explode(F.expr("flatten(transform(f, (x, i) -> transform(filter(slice(f, i + 2, size(f)), y -> bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))))")).alias("e")).select("e.a", "e.b").distinct()
    hot = members.filter(F.col("n") > small).select("fp").distinct()
    two = F.expr("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> struct(cast(i * 64 + j as int) as ij, fp & ~shiftleft(1L, i) & ~shiftleft(1L, j) as v))))")
    wild = hot.select("fp", F.explode(two).alias("w")).select("fp", "w.ij", "w.v")
    least = wild.groupBy("ij", "v").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top")
    stars = wild.join(least.hint("merge"), ["ij", "v"]).filter("fp > b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def _rooted(prints: DataFrame, small: int = 64) -> DataFrame:
    """(fp, low, root) of the distinct fingerprints: its first row, and the smallest fingerprint that links reach."""
    nodes = store(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("low")))
    comp = store(components(links(nodes.select("fp"), small)))
    # fingerprints that link with no other are their own root
    roots = nodes.join(comp.hint("merge"), nodes.fp == comp.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return store(roots)


def dedup(docs: DataFrame, words: int = 3, seed: int = 42, small: int = 64) -> DataFrame:
    """(doc_id, th, fp, component_id, kept) for every row; kept: the first of its component by doc_id (null last), then th."""
    prints = store(fingerprints(docs, words, seed))
    roots = _rooted(prints, small)
    low = store(roots.groupBy("root").agg(F.min("low").alias("first")))
    final = roots.join(low.hint("merge"), "root").select("fp", "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    return prints.join(final.hint("merge"), "fp").select("doc_id", "th", "fp", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, th, node, component_id, kept) for every row, linked by fingerprints as in dedup or at a Jaccard similarity of their five-word shingles.

    Fingerprints alone leave most near copies: at 0.8 two of them differ in 10 bits on average (sf0.1: 3
    to 11), which segments that differ by one bit at most would have to be about six bits long for, so
    that every text would meet every other. So links at that similarity come on top, by the same index,
    segments with one part struck out, on sketches of minima, which agree with the chance of the
    similarity itself. Components are those of both kinds of links together.
    """
    prints = store(fingerprints(docs))
    roots = _rooted(prints)
    classes = store(prints.join(roots.select("fp", "root").hint("merge"), "fp").select("th", F.col("root").alias("class")).distinct())
    forget(prints, roots)
    return shingles.dedup(docs, least, classes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
