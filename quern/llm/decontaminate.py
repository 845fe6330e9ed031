"""Benchmark decontamination by templates (operator 2).

Numbers, the units after them and names (runs of capitalised words within a sentence) become typed
placeholders, one for each; punctuation goes and case folds. Windows of five canonical words are hashed on both
sides and joined by hash. A document holds an item if windows that cover `least` of the item's are
found in it and its slots are consistent: each value in the item meets one value in the document,
for `least` of the slots. So copies are caught, and the same question with other numbers or names.

Each occurrence is judged by itself: hits are banded by document position minus item position, in
bands as wide as the item that start at every half of its length, and in one band of the whole
document; in a band each item position takes the hit nearest the most frequent shift. One band that
passes is enough.

All is done with names as placeholders and, under other hashes, with names as plain folded words, so
that copies whose case was changed are caught as well.

Candidates come from each item's rarest windows, by the number of items that have them: of a share
`least` of its windows one at least is among any 1 - least of them and one more. Only a candidate's
hits are joined whole, so a window that many items and documents share multiplies nothing.

The benchmark's windows thin out the documents' through a bitmap of fixed size (2 ** BITS bits)
before anything is shuffled; the bitmap lets false windows pass, never drops a true one.

Defined cases: null, empty and wordless texts hold nothing; items without words are never held; an
item or document shorter than a window is one window; windows with under three plain words don't count unless
the item has no others; a document is its id and text together, so rows without an id, or with the
same one, are judged each by itself; a (doc_id, item_id) is reported once, by its best occurrence;
null ids take part as they are; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table

WORDS = 5
BITS = 24
NUMBER, NAME, UNIT = b"\x01", b"\x02", b"\x03"
UNITS = "mm|cm|km|m|mg|kg|g|t|lb|lbs|oz|ml|l|hours?|hrs?|h|minutes?|mins?|min|seconds?|secs?|s|days?|weeks?|months?|years?|miles?|feet|foot|ft|inch|inches|in|yards?|dollars?|cents?|euros?|pounds?|percent|degrees?|meters?|metres?|kilometers?|kilometres?|kilograms?|grams?|liters?|litres?"
UP, LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
#: A number and the unit after it, or a name; the first sign decides at once where neither can start.
SLOT = re.compile(rf"[\d{UP}](?:(?<=\d)\d*(?:[.,:/]\d+)*(?P<unit>\s?(?i:{UNITS})(?![^\W_]))?|(?:(?<=[^\W\d_][ ,;].)|(?<=[^\W\d_][ ,;]\s.))(?P<name>[{LOW}]+(?![^\W_])(?: [{UP}][{LOW}]+(?![^\W_]))*))")
FOLDED = np.uint64(0x94D049BB133111EB)  # tells windows with names as plain words from the others
BREAK = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x00\x04\x05" else i for i in range(256))
C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def canonical(text: str) -> tuple[list[bytes], list[str]]:
    """Canonical words, and the values of its placeholders in order."""
    values: list[str] = []

    def slot(m: re.Match) -> str:
        if m.lastgroup == "name":
            values.append(m[0].lower())
            return " \x02 "
        unit = m["unit"]
        values.append(m[0].removesuffix(unit) if unit else m[0])
        if not unit:
            return " \x01 "
        values.append(unit.strip().lower())
        return " \x01 \x03 "

    t = SLOT.sub(slot, text.translate({1: " ", 2: " ", 3: " "}) if re.search("[\x01-\x03]", text) else text)
    return t.lower().encode("utf-8", "surrogatepass").translate(BREAK).split(), values


def windows(text: str | None) -> list[tuple[np.ndarray, np.ndarray, list[int], list[str]]]:
    """(hash of each window, its plain words, indices of placeholders, their values), with names as placeholders and as plain words."""
    words, values = canonical(text) if text else ([], [])
    if not words:
        return []
    h64, n = xxhash.xxh64_intdigest, len(words)
    h = np.array([h64(w) for w in words], dtype=np.uint64)
    slots = [i for i, w in enumerate(words) if w in (NUMBER, NAME, UNIT)] if values else []
    out = [(*_windows(h, slots), slots, values)]
    rest = [(i, v) for i, v in zip(slots, values) if words[i] != NAME]
    if len(rest) == len(values):
        return [*out, (out[0][0] ^ FOLDED, *out[0][1:])]
    names = iter(v for i, v in zip(slots, values) if words[i] == NAME)
    spelt = [y for w in words for y in (next(names).encode("utf-8", "surrogatepass").split() if w == NAME else (w,))]
    h = np.array([h64(w) for w in spelt], dtype=np.uint64)
    slots = [i for i, w in enumerate(spelt) if w in (NUMBER, UNIT)] if rest else []
    h, plain = _windows(h, slots)
    return [*out, (h ^ FOLDED, plain, slots, [v for _, v in rest])]


def _windows(h: np.ndarray, slots: list[int]) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    plain = np.ones(n, np.int64)
    plain[slots] = 0
    k = min(WORDS, n)
    m = n - k + 1
    out, count = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    for j in range(k):
        out += (h[j : j + m] ^ (h[j : j + m] >> np.uint64(29))) * C[j]
        count += plain[j : j + m]
    out ^= out >> np.uint64(32)
    return out * C[0], count


def _rows(keep):
    """keep: packed bits of the benchmark's windows, or None for the benchmark itself."""
    def run(it):
        table_ = None if keep is None else np.unpackbits(np.frombuffer(keep, np.uint8))
        for b in it:
            ids, own, kinds, at, hs, plains, vals = [], [], [], [], [], [], []
            for i, t, o in zip(*(c.to_pylist() for c in b.columns)):
                for kind, (h, plain, slots, values) in enumerate(windows(t)):
                    hit = np.arange(len(h)) if table_ is None else np.flatnonzero(table_[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                    if not len(hit):
                        continue
                    s = np.array(slots, np.int64)
                    lo, hi = np.searchsorted(s, hit), np.searchsorted(s, hit + WORDS)
                    ids += [i] * len(hit)
                    own += [o] * len(hit)
                    kinds += [kind] * len(hit)
                    at += hit.tolist()
                    hs.append(h[hit])
                    plains.append(plain[hit])
                    vals += [values[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
            cat = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(kinds, pa.int32()),
                    pa.array(at, pa.int32()),
                    pa.array((np.concatenate(hs) if hs else np.zeros(0, np.uint64)).view(np.int64)),
                    cat(plains, np.int32),
                    pa.array(vals, pa.list_(pa.string())),
                    pa.array(own, pa.int64()),
                ],
                names=["id", "kind", "at", "h", "plain", "v", "own"],
            )

    return run


ROW = "id long, kind int, at int, h long, plain int, v array<string>, own long"


def held(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, coverage, consistency): the items that documents hold."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), F.col("item_id").cast("long").alias("own")).mapInArrow(_rows(None), ROW).drop("own")
    items = store(items)
    most = items.groupBy("id", "kind").agg(F.max("plain").alias("most"), (F.max("at") + WORDS).alias("wide"))
    items = items.join(most.withColumnsRenamed({"id": "i2", "kind": "k2"}), F.col("id").eqNullSafe(F.col("i2")) & (F.col("kind") == F.col("k2")))
    items = items.filter("plain >= least(3, most)").select(F.col("id").alias("item_id"), "kind", F.col("at").alias("ia"), "wide", "h", F.col("v").alias("iv"))
    items = store(items.distinct())
    cells = np.fromiter((r.c for r in items.select(F.shiftrightunsigned("h", 64 - BITS).alias("c")).distinct().toLocalIterator()), np.int64)  # 2 ** BITS at most
    bits = np.zeros(1 << BITS, np.uint8)
    bits[cells] = 1
    # a row key tells documents apart
    rid = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.select(rid.alias("rid"), F.col("text").cast("string"), F.col("doc_id").cast("long").alias("own"))
    found = found.mapInArrow(_rows(np.packbits(bits).tobytes()), ROW)
    found = store(found.select(F.col("id").alias("doc_id"), F.col("at").alias("da"), "h", F.col("v").alias("dv"), "own").distinct())
    windows_ = items.select("item_id", "kind", "h").distinct()
    rare = windows_.join(windows_.groupBy("h").agg(F.count("*").alias("df")), "h")
    mine = Window.partitionBy("item_id", "kind")
    rare = rare.withColumn("no", F.row_number().over(mine.orderBy("df", "h"))).withColumn("size", F.count("*").over(mine)).filter(F.col("no") <= F.floor((1 - least) * F.col("size") + 1e-9) + 1)
    cand = found.select("doc_id", "h").join(rare.select("item_id", "kind", "h"), "h").select(F.col("doc_id").alias("d0"), "item_id", "kind").distinct()
    hits = found.join(cand, F.col("doc_id") == F.col("d0")).drop("d0").withColumnsRenamed({"item_id": "i0", "kind": "k0", "h": "h0"})
    hits = store(hits.drop("own").join(items, F.col("i0").eqNullSafe(F.col("item_id")) & (F.col("k0") == F.col("kind")) & (F.col("h0") == F.col("h"))).drop("i0", "k0", "h0"))
    sizes = items.groupBy("item_id", "kind").agg(F.countDistinct("h").alias("size"))
    pair = hits.groupBy("doc_id", "item_id", "kind").agg(F.countDistinct("h").alias("got"))
    pair = pair.join(sizes.withColumnsRenamed({"item_id": "i2", "kind": "k2"}), F.col("item_id").eqNullSafe(F.col("i2")) & (F.col("kind") == F.col("k2"))).filter(F.col("got") / F.col("size") >= least)
    pair = pair.select(F.col("doc_id").alias("d3"), F.col("item_id").alias("i3"), F.col("kind").alias("k3"), "size")
    hits = hits.join(pair, F.col("doc_id").eqNullSafe(F.col("d3")) & F.col("item_id").eqNullSafe(F.col("i3")) & (F.col("kind") == F.col("k3")))
    shift = hits.withColumn("off", F.col("da") - F.col("ia"))
    ways = ["struct(0 as way, 0L as no)", "struct(1 as way, cast(floor(off / wide) as long) as no)", "struct(2 as way, cast(floor((off + wide / 2) / wide) as long) as no)"]
    shift = shift.withColumn("band", F.explode(F.expr(f"array({', '.join(ways)})")))
    one = ["doc_id", "item_id", "kind", "band"]
    usual = shift.withColumn("times", F.count("*").over(Window.partitionBy(*one, "off"))).withColumn("mode", F.max(F.struct("times", (-F.col("off")).alias("turned"))).over(Window.partitionBy(*one)))
    # of each item position the hit nearest the most frequent shift, which mode has with its sign turned
    far = F.abs(F.col("off") + F.col("mode")["turned"]).alias("far")
    near = usual.groupBy(*one, "ia", "size").agg(F.min(F.struct(far, "da", "h", "iv", "dv")).alias("x"))
    near = store(near.select(*one, "ia", "size", "x.h", "x.iv", "x.dv"))
    got = near.groupBy(*one, "size").agg((F.countDistinct("h") / F.col("size")).alias("coverage")).filter(F.col("coverage") >= least).drop("size")
    slots = near.filter("size(iv) > 0 and size(iv) = size(dv)").select(*one, F.explode(F.arrays_zip("iv", "dv")).alias("p")).groupBy(*one, "p.iv", "p.dv").agg(F.count("*").alias("n"))
    slots = slots.groupBy(*one, "iv").agg(F.max("n").alias("top"), F.sum("n").alias("n")).groupBy(*one).agg((F.sum("top") / F.sum("n")).alias("consistency"))
    s = slots.select(F.col("doc_id").alias("d2"), F.col("item_id").alias("i2"), F.col("kind").alias("k2"), F.col("band").alias("b2"), "consistency")
    out = got.join(s, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("item_id").eqNullSafe(F.col("i2")) & (F.col("kind") == F.col("k2")) & (F.col("band") == F.col("b2")), "left")
    out = out.withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).filter(F.col("consistency") >= least)
    out = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "consistency")).alias("x")).select(F.col("doc_id").alias("rid"), "item_id", "x")
    named = found.select(F.col("doc_id").alias("r2"), "own").distinct()
    return out.join(named, F.col("rid") == F.col("r2")).groupBy(F.col("own").alias("doc_id"), "item_id").agg(F.max("x").alias("x")).select("doc_id", "item_id", "x.coverage", "x.consistency")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
