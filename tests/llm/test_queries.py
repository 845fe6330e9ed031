"""Every query over odd tables and over empty ones, and two models against plain fits."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import labelled, quality, toxicity
from quern.llm.queries import QUERIES

LONG = "the long text of many words that goes on and on " * 12_000
TEXTS = [(None, None), (None, "one row without an id"), (1, ""), (1, ""), (1, "another text of the same id"), (2, " \n\t "), (3, "word"), (4, LONG), (5, "tie tie tie"), (6, "tie tie tie"), (7, "a\n" * 500), (8, "é ü ß 汉字 \U0001f600 \x00 x"), (9, "the copy of a row"), (9, "the copy of a row"), (10, "I am r0tten, y o u r o t t e n"), (11, LONG[:5000])]
HTML = [(None, None, None), (1, "u", ""), (1, "u", "<p>" + "word " * 50_000), (2, None, "<article><p>The same page once more, with enough words in it to be read.</p></article>" * 20), (3, "u", "<article><p>The same page once more, with enough words in it to be read.</p></article>" * 20), (3, "u", "<<>&<a"), (4, "x", "plain \x00 text")]
VECTORS = [(None, [1.0, 0.0]), (1, None), (1, []), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (6, [1.0, 1.0, 1.0]), (7, [float("inf"), 1.0]), (8, [1e-30, 0.0])]
EXTRA = ["kind", "h", "cls", "key", "bucket", "score", "own", "node", "fp", "_id", "rep", "size", "taken", "x", "y"]


def tables(spark, at, keep):
    """Tables whose further columns have names that operators use themselves."""
    def put(name, rows, schema, free=True):
        df = spark.createDataFrame(rows if keep else [], schema)
        for c in EXTRA if free else ():
            df = df.withColumn(c, F.lit("clash"))
        df.repartition(3).write.parquet(f"{at}/{name}.parquet")

    put("documents", [(i, t, "en", None if k % 3 else "s", 1) for k, (i, t) in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    put("pages", HTML, "page_id long, url string, html string")
    put("embeddings", [(*v, 1) for v in VECTORS], "vec_id long, embedding array<float>, label int")
    put("benchmark", [(None, None), (1, ""), (2, "another text of the same id"), (2, "another text of the same id"), (3, "tie"), (None, "word")], "item_id long, text string")
    put("labels", [(None, 1, 1), (1, None, None), (3, 1, 0), (3, 0, 1), (4, 1, 0), (5, 0, 1), (6, 0, 1), (7, 1, 0), (99, 1, 1), (10, 0, 1)], "doc_id long, quality int, toxic int")
    return at


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("odd")), True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("empty")), False)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_tables(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    given = {"op1": HTML, "op10": HTML, "op8": VECTORS}.get(name.split("_")[0], TEXTS)
    if name.startswith("op2"):
        assert sorted((r.doc_id, r.item_id or 0) for r in rows) == [(1, 2), (3, 0)]  # an item shorter than a window is held by an equal text alone
        return
    assert sorted((r[0] is None, r[0]) for r in rows) == sorted((x[0] is None, x[0]) for x in given)
    alike = {}
    for r in rows:  # repeated rows have one result
        if r[0] == 9 and name != "op3_mixing":
            alike.setdefault(r[0], set()).add(tuple(r))
    assert all(len(x) == 1 for x in alike.values())


def test_quality_same_as_a_plain_fit(spark):
    r = random.Random(8)
    texts = [" ".join("abcdefgh"[r.randrange(8)] * r.randint(1, 6) for _ in range(r.randint(5, 80))) + r.choice((".", "!!! $$", "")) for _ in range(90)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 80)] + [(0, 0), (3, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x, best = np.array([quality.vector(t) for t in texts]), {}
    for i, y in labels:
        if y is not None and zlib.crc32(str(i).encode()) % 5:
            best[i] = max(y, best.get(i, 0))
    of = {k: x[[i for i, y in best.items() if y == k]] for k in (0, 1)}
    n = {k: len(z) for k, z in of.items()}
    cov = {k: np.cov(z.T, bias=True) for k, z in of.items()}
    pooled = sum(n[k] * cov[k] for k in cov) / sum(n.values())
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    dense = {}
    for k in (0, 1):
        c = (0.9 * cov[k] + 0.1 * pooled) / np.outer(scale, scale)
        c = 0.98 * c + max(0.02 * np.trace(c) / len(c), quality.FLOOR) * np.eye(len(c))
        z = (x - of[k].mean(axis=0)) / scale
        dense[k] = math.log(n[k] / sum(n.values())) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z)
    gap = dense[1] - dense[0]
    want = 1 / (1 + np.exp(-np.sign(gap) * np.log1p(np.abs(gap) / 8) * 2))
    assert all(abs(got[i] - want[i]) < 1e-6 for i in got) and 0.1 < np.mean([s > 0.5 for s in got.values()]) < 0.9


def test_quality_of_classes_without_spread(spark):
    docs = spark.createDataFrame([(i, "the good text" if i % 2 else "junk $$$ junk") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality.classify(docs, labels).collect()}
    assert len({round(s, 9) for s in got.values()}) == 2 and got[1] > 0.5 > got[0]


def test_toxicity_same_as_a_plain_fit(spark):
    """The lexicon and both coefficients by counting over lists."""
    r = random.Random(4)
    words = [a + b + c + d for a in "bcdfg" for b in "aeiou" for c in "lmnp" for d in "aeiou"][:300]
    texts = [[r.choice(words) for _ in range(25)] for _ in range(500)]
    for i in range(0, 500, 4):
        texts[i][5] = r.choice(("rotter", "r0tter", "scoundrel"))
    rows = [(i, " ".join(t), float(i % 4 == 0)) for i, t in enumerate(texts)]
    train = spark.createDataFrame(rows, "doc_id long, text string, y double")
    restore, lexicon = toxicity.fit(train)
    part = {x.doc_id: x.p for x in train.select("doc_id", F.expr("pmod(xxhash64(doc_id, 7), 4)").alias("p")).collect()}
    seen, n = ({}, {}), [0, 0]
    for i, t, y in rows:
        if part[i]:
            n[int(y)] += 1
            for f in toxicity.evidence(restore.distinct(t)):
                seen[int(y)][f] = seen[int(y)].get(f, 0) + 1
    want = {}
    for f, bad in seen[1].items():
        clean = seen[0].get(f, 0)
        gain = math.log((bad - 1.64 * math.sqrt(bad)) / n[1] + 1e-9) - math.log((clean + 1.64 * math.sqrt(clean + 1)) / n[0]) if bad > 1.64 * math.sqrt(bad) else -99
        if bad >= max(5, math.ceil(0.01 * n[1])) and gain > 3:
            want[f] = gain
    assert lexicon.weights.keys() == want.keys() and all(abs(lexicon.weights[f] - g) < 1e-9 for f, g in want.items()) and {"rotter$", "scoundrel$"} <= set(want)
    plain = toxicity.Lexicon(want)
    rest = [(plain.total(restore.distinct(t)), y) for i, t, y in rows if not part[i]]
    base, slope = toxicity.logistic([a for a, _ in rest], [y for _, y in rest])
    assert abs(lexicon.base - base) < 1e-6 and abs(lexicon.slope - slope) < 1e-6
    for word, y in (("rotter", True), ("r o t t e r", True), ("bamo", False)):
        assert (lexicon.score(restore.distinct(f"{' '.join(words[:9])} {word}")) >= 0.3) == y


def test_toxicity_learns_from_every_labelled_row(spark):
    """More training rows than a sample of 16,000; those that its order leaves out are the only toxic ones."""
    ids = spark.range(24_000).withColumnRenamed("id", "doc_id").filter(labelled.remainder(4) != 2).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [x.doc_id for x in ids.collect()]
    assert len(ids) > 16_400
    bad = set(ids[16_000:])
    docs = spark.createDataFrame([(i, f"plain words number {'abcdefgh'[i % 8]}" + (" rotter" if i in bad else "")) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in bad)) for i in ids], "doc_id long, toxic int")
    restore, lexicon = toxicity.trained(docs, labels)
    assert lexicon.score(restore.distinct("you r0tter")) >= 0.3 > lexicon.score(restore.distinct("plain words number a"))
    twice = labelled.training(docs.union(docs.limit(1)), labels, "toxic", 4, 2)
    assert twice.count() == len(ids) + 1
