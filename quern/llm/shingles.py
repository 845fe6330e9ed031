"""Near-duplicates by the Jaccard similarity of word shingles, for operator 9 (see simhash.near_duplicates).

A text is the set of its five-word shingles (ASCII lower case, ASCII white space). Texts of one set
are one node. A set's sketch is SEGMENTS * PARTS minima under as many hashes; two sketches agree in
each with the chance of their sets' similarity. The sketch is cut into segments, and each segment is
indexed PARTS times, once with each of its minima struck out: equal signatures are segments that
differ in one minimum at most. A pair at similarity 0.8 is missed with chance
(1 - 0.8 ** 6 - 6 * 0.2 * 0.8 ** 5) ** 11 = 9e-6, a closer one less; candidates are verified on the
sets themselves, so no pair below the threshold is linked.

Of the texts that share a signature each is first verified against the one that shares the most
signatures with others, which is near the middle of a group of copies. Pairs that these links join
already can't change a component; of all the others of the group those are verified that may reach
the threshold: |a & b| <= (|a| + |b| - d) / 2, where d is the number of differing bits of two bitmaps
of the sets, and no pair above that bound is lost.

Defined cases: null and wordless texts have the empty set and are one node that links with no other;
fewer words than a shingle count as one shingle; a null doc_id takes part; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, store

WORDS, SEGMENTS, PARTS = 5, 11, 6
MINIMA = SEGMENTS * PARTS
BITS = 1024
_R = np.random.default_rng(5)
FLIP = _R.integers(0, 1 << 64, MINIMA, np.uint64)
ODD = _R.integers(0, 1 << 64, WORDS + MINIMA, np.uint64) | np.uint64(1)
TAGS = _R.integers(0, 1 << 64, (2, SEGMENTS, PARTS), np.uint64)
CHUNK = 1 << 13


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, parts)), np.uint64)
    k = min(words, len(h))
    m = len(h) - k + 1
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += (h[j : j + m] ^ (h[j : j + m] >> np.uint64(29))) * ODD[j]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def signatures(s: np.ndarray) -> np.ndarray:
    """A hash for each segment of the sketch and each of its minima: that of the segment's other minima."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max)
    for i in range(0, len(s), CHUNK):
        low = np.minimum(low, ((s[i : i + CHUNK, None] ^ FLIP) * ODD[WORDS:]).min(axis=0))
    part = _mix(low.reshape(SEGMENTS, PARTS) + TAGS[0])
    return _mix(part.sum(axis=1, keepdims=True, dtype=np.uint64) - part + TAGS[1]).ravel()


def bitmap(s: np.ndarray) -> np.ndarray:
    """The set's shingles as set bits, signed words of 64."""
    bits = np.zeros(BITS, np.uint8)
    bits[(s >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(bits).view(np.int64)


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes())


def _prints(it):
    for b in it:
        sets = [shingles(x) for x in b.column(1).to_pylist()]
        node = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
        sigs = [signatures(s).view(np.int64).tolist() if len(s) else [] for s in sets]
        columns = [b.column(0), b.column(2), pa.array(node), pa.array(list(map(len, sets)), pa.int64()), pa.array(sigs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "node", "n", "sigs"])


def _sets(it):
    for b in it:
        sets = [shingles(x) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], names=["node", "s", "bits"])


def dedup(docs: DataFrame, least: float = 0.8, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, th, node, component_id, kept) for every row; kept: the first of its component by doc_id (null last), then th.

    classes: (th, class) of texts that are linked besides, those of a class with one another."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th"))
    prints = store(keyed.mapInArrow(_prints, "doc_id long, th long, node long, n long, sigs array<long>"))
    nodes = store(prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("low")))
    members = prints.select("node", "n", F.explode("sigs").alias("sig")).distinct().repartition("sig")  # one exchange, which counting and joining share
    shared = members.groupBy("sig").agg(F.count("*").alias("m")).filter("m > 1")
    members = store(members.join(shared.hint("merge"), "sig"))
    members = store(members.join(members.groupBy("node").agg(F.sum("m").alias("weight")), "node"))
    leads = members.groupBy("sig").agg(F.max(F.struct("weight", "node", "n")).alias("lead"))
    members = store(members.join(leads, "sig").select("sig", "node", "n", "lead"))
    texts = members.select("node").distinct().join(nodes, "node").select("node", F.col("low.th").alias("th"))
    sets = store(keyed.select("th", "text").join(texts, "th").dropDuplicates(["node"]).select("node", "text").mapInArrow(_sets, "node long, s array<long>, bits array<long>"))

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs: (a, b, na, nb) -> (a, b) at the threshold or above."""
        near = pairs.filter(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9).select("a", "b").distinct()
        both = near.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("i"))
        return store(both.filter(F.col("i") >= least * (F.col("n") - F.col("i")) - 1e-9).select("a", "b"))

    stars = verified(members.filter("node != lead.node").select(F.col("node").alias("a"), F.col("lead.node").alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb")))
    comp = store(components(stars))
    rooted = lambda df, of, name: df.join(comp.select(F.col("node").alias("_c"), F.col("root").alias("_r")), F.col(of) == F.col("_c"), "left").withColumn(name, F.coalesce("_r", of)).drop("_c", "_r")
    members = store(rooted(rooted(members.select("sig", "node", "n", F.col("lead.node").alias("lead")), "node", "root"), "lead", "top"))
    # groups with members that the first links leave apart
    split = members.filter("root != top").select("sig").distinct()
    rest = members.join(split.hint("merge"), "sig", "left_semi").join(sets.select("node", "bits").hint("merge"), "node")
    rest = store(rest.select("sig", "node", "n", "root", (F.col("root") != F.col("top")).alias("off"), "bits"))
    apart = rest.filter("off").select("sig", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("bits").alias("ba"))
    others = rest.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("bits").alias("bb"), "off")
    far = F.expr("aggregate(zip_with(ba, bb, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
    # two of the group that are both apart meet once
    both = F.col("na") + F.col("nb")
    once = ~F.col("off") | (F.col("a") > F.col("b"))
    sizes = F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9
    shared = (both - far) / 2 >= least / (1 + least) * both - 1e-9
    pairs = apart.join(others.withColumnRenamed("sig", "sig2"), (F.col("sig") == F.col("sig2")) & (F.col("ra") != F.col("rb")) & once & sizes & shared)
    first = F.col("a") > F.col("b")
    pairs = pairs.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"),
        F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb"),
    )
    found = stars.unionByName(verified(pairs))
    if classes is not None:
        classed = store(prints.select("node", "th").distinct().join(classes.hint("merge"), "th").select("class", "node").distinct())
        low = store(classed.groupBy("class").agg(F.min("node").alias("b")))
        found = found.unionByName(classed.join(low.hint("merge"), "class").filter("node > b").select(F.col("node").alias("a"), "b"))
    comp = store(components(found))
    roots = nodes.join(comp.hint("merge"), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    roots = store(roots)
    final = roots.join(store(roots.groupBy("root").agg(F.min("low").alias("first"))).hint("merge"), "root").select("node", "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    return prints.join(final.hint("merge"), "node").select("doc_id", "th", "node", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))
