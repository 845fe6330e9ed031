import gzip
import math
import random
import struct
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontaminate, html, linededup, mixing, neardup, pitmanyor, quality, simhash, toxicity, warc

signed = lambda x: x - (1 << 64) if x >> 63 else x
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}" if i % 5 else None, 1, "x") for i, t in enumerate(texts)], DOC)


def h42(x):
    if isinstance(x, tuple):
        s = 42
        for v in x:
            s = signed(xxhash.xxh64_intdigest(struct.pack("<q", v), s & (2**64 - 1)))
        return s
    return signed(xxhash.xxh64_intdigest(x.encode(), 42))


ODD = [None, "", " \n\t ", "a", "a", "one two", "x " * 30_000]


def same_as_sql(spark, name, sf="/root/testdata/sf0.001"):
    import os

    import duckdb

    from quern.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    got = QUERIES[name](spark, sf).toPandas()
    want = con.sql(SQL[name]).df()[list(got.columns)]
    clean = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).assign(**{c: df[c].astype("Int64") for c in df.columns if df[c].dtype.kind in "if" and c not in ("target", "audit_recall")}).values.tolist()))
    assert len(got) and clean(got) == clean(want)


@pytest.mark.parametrize("name", ["op3_mixing", "op6_line_dedup", "op8_embedding_neardup", "op10_warc"])
def test_query_is_same_as_its_sql(spark, name):
    same_as_sql(spark, name)


def test_mixing(spark):
    texts = ODD + [" ".join(["w"] * n) for n in (5, 50, 500, 70)]
    rows = mixing.mix(docs(spark, texts)).collect()
    assert len(rows) == len(texts) and all(0 <= r.taken <= 2 * r.size and (r.blocks > 0) == (r.taken > 0) == (r.first_slot is not None) for r in rows)
    for t in {(r.source_size, r.target) for r in rows}:
        assert abs(sum(r.taken for r in rows if (r.source_size, r.target) == t) - t[1]) <= 4 and t[1] <= 2 * t[0]
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    other = mixing.mix(docs(spark, texts), step=0.5).collect()
    assert sorted((r.doc_id, r.first_slot) for r in rows if r.blocks) != sorted((r.doc_id, r.first_slot) for r in other if r.blocks)
    assert mixing.mix(docs(spark, texts).limit(0)).count() == 0
    alone = [(None, "a b c"), (None, "a b c"), (None, "d e"), (7, None)]
    got = mixing.mix(spark.createDataFrame([(i, t, "en", None, 1, "x") for i, t in alone], DOC)).collect()
    assert sum(r.taken for r in got) == 12 and len(got) == 4


def test_mixing_schedule_has_low_discrepancy(spark):
    goals = spark.createDataFrame([("a", 500.0), ("b", 300.0), (None, 199.9), ("c", 0.1)], "source string, target double")
    rows = sorted((r.slot, r.source, r.rank) for r in mixing.schedule(spark, goals.withColumn("target", F.col("target") * 1000), 5000).na.fill("-").collect())
    seen = Counter()
    for i, (slot, source, rank) in enumerate(rows):
        assert slot == i and rank == seen[source]
        seen[source] += 1
        if slot < 5000:
            assert all(abs(seen[s] - (i + 1) * t / 1000) < 5 for s, t in (("a", 500), ("b", 300), ("-", 199.9), ("c", 0.1)))
    assert mixing.blocks(10, 65536, 65536) == (1, 10) and mixing.blocks(10**13, 65536, 65536) == (65536, 152587891)


def test_simhash(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(300)) for _ in range(6)]
    texts = ODD + base + [b + " tail" for b in base] + base[:2]
    rows = {x.doc_id: x for x in simhash.dedup(docs(spark, texts)).collect()}
    fp = [simhash.fingerprint(t) for t in texts]
    assert [rows[i].fp for i in range(len(texts))] == fp and fp[0] == fp[1] == 0
    low = list(range(len(fp)))
    for _ in fp:
        for i in range(len(fp)):
            for j in range(len(fp)):
                if bin((fp[i] ^ fp[j]) & (2**64 - 1)).count("1") <= 2:
                    low[i] = min(low[i], low[j])
    assert [rows[i].component_id for i in range(len(fp))] == low
    assert simhash.dedup(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("small", [64, 2])
def test_simhash_links_of_a_large_group(spark, small):
    r = random.Random(2)
    center = r.getrandbits(63)
    values = sorted({center} | {center ^ 1 << r.randrange(63) ^ 1 << r.randrange(63) for _ in range(80)} | {r.getrandbits(63) for _ in range(50)})
    edges = [(e.a, e.b) for e in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), small).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    seen, todo = {center}, [center]
    while todo:
        v = todo.pop()
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x == v and y not in seen:
                    seen.add(y)
                    todo.append(y)
    assert {v for v in values if (v ^ center).bit_count() <= 2} <= seen


def brute_lines(rows, least=160, most=8, blank=40):
    """Line dedup by plain loops: {(doc_id, text): new text}."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0], h42(r[1])))
    where = {}
    for d, (_, t) in enumerate(docs):
        lines = t.split("\n")
        for s in range(len(lines)):
            e = n = 0
            while e < most and s + e < len(lines) and n < least:
                n += len(lines[s + e].encode())
                e += 1
            if n >= least or e == most and n >= blank:
                where.setdefault("\n".join(lines[s : s + e]), []).append((d, s, s + e))
    drop = {}
    for spots in where.values():
        for d, s, e in spots[1:]:
            drop.setdefault(d, set()).update(range(s, e))
    out = {(i, t): t for i, t in rows}
    for d, gone in drop.items():
        out[docs[d]] = "\n".join(x for i, x in enumerate(docs[d][1].split("\n")) if i not in gone)
    return out


def test_line_dedup_same_as_brute_force(spark):
    r = random.Random(3)
    line = lambda: " ".join(r.choice("abcdefghij") * r.randint(1, 6) for _ in range(r.choice((1, 3, 9, 60))))
    shared = ["\n".join(line() for _ in range(r.randint(1, 9))) for _ in range(8)] + ["\n" * 12, "x\n" * 30, "\n".join(["same line of words"] * 20)]
    texts = ODD + ["\n".join(r.choice(shared) if r.random() < 0.4 else line() for _ in range(r.randint(1, 9))) for _ in range(60)]
    given = [(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (None, texts[21]), (None, texts[22]), (30, texts[33])]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in given], DOC)
    out = [(x.doc_id, x.text) for x in linededup.dedup(df).collect()]
    want = brute_lines(given)
    assert sorted(out, key=str) == sorted(((i, want[i, t]) for i, t in given), key=str) and {t for _, t in out} != set(texts)
    assert linededup.dedup(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("lines, words", [(1, 60), (3, 18), (4, 14), (6, 9), (10, 6), (26, 2)])
def test_line_dedup_takes_whole_passages(spark, lines, words):
    r = random.Random(lines)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    row = lambda: " ".join(word() for _ in range(words))
    passage = "\n".join(row() for _ in range(lines))
    own = [[row() for _ in range(6)] for _ in range(12)]
    texts = ["\n".join([*x[:k], passage, *x[k:]]) for k, x in zip([0, 6, *range(1, 6), 0, 6, 2, 3, 4], own)]
    out = {x.doc_id: x.text for x in linededup.dedup(docs(spark, texts)).collect()}
    assert out[0] == texts[0] and all(out[i] == "\n".join(own[i]) for i in range(1, 12))


def test_decontamination(spark):
    item = "A train leaves Paris at 9 and travels 120 km before the driver called Anna stops to rest for 30 minutes"
    other = "A train leaves Paris at 7 and travels 450 km before the driver called Berta stops to rest for 10 minutes"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    clean = "The river runs through the old town and past the mill where nobody has worked for many long years"
    rows = {r.doc_id for r in decontaminate.held(docs(spark, ODD + [item, f"Before. {other}. After", clean, item.lower()]), bench).collect()}
    assert {7, 8} <= rows and 9 not in rows and not rows & set(range(7))
    assert decontaminate.held(docs(spark, ODD), bench.limit(0)).count() == 0


def test_decontamination_judges_each_occurrence(spark):
    item = "A train leaves Paris at 9 and travels 120 km before the driver called Anna stops to rest for 30 minutes"
    other = "A train leaves Lyon at 7 and travels 450 km before the driver called Berta stops to rest for 10 minutes"
    # no number is met twice alike, so each value of the template has two in the whole document
    twice = " ".join(f"At the long market stall number {n} a farmer sells {m} baskets of ripe fruit to them." for n, m in ((3, 14), (8, 26), (5, 37)))
    filler = "the river runs through the old town and past the mill where nobody has worked for many long years " * 3
    bench = spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")
    given = [f"{item}. {other}.", f"{item}. {filler}{other}. {filler}{other}.", twice, f"{filler}{twice} {filler}", filler]
    got = {(r.doc_id, r.item_id) for r in decontaminate.held(docs(spark, given), bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 2), (3, 2)}


@pytest.mark.parametrize("case", [str.lower, str.upper, str.title])
def test_decontamination_of_copies_in_another_case(spark, case):
    item = "A train leaves Paris at 9 and travels 120 km before the driver called Anna stops to rest for 30 minutes"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.held(docs(spark, ["some other words that aren't in it at all", case(item)]), bench).collect()} == {1}


def test_decontamination_tells_rows_of_one_id_apart(spark):
    item = "A train leaves Paris at 9 and travels 120 km before the driver called Anna stops to rest for 30 minutes"
    half = len(item) // 2
    bench = spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")
    rows = [(None, item[:half]), (None, item[half:]), (4, item[:half]), (4, item[half:]), (5, "something else entirely here"), (5, item), (6, item), (6, item)]
    got = decontaminate.held(spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, own double"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(5, 1, 1.0), (6, 1, 1.0)]
    assert decontaminate.held(spark.createDataFrame([(None, item)], "doc_id long, text string"), bench).first().doc_id is None


@pytest.mark.parametrize("names", [("Berta", "Lyon"), ("Anna Maria", "New York"), ("Jean Paul Marie", "Rome")])
def test_decontamination_of_other_names(spark, names):
    item = "The old clerk called Anna walked from the station at Paris to a market and bought 12 apples for 30 cents each"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = item.replace("Anna", names[0]).replace("Paris", names[1]).replace("12", "7")
    assert {r.doc_id for r in decontaminate.held(docs(spark, [f"So then. {text}. And so on it went."]), bench).collect()} == {0}


def brute_held(docs_, items, least=0.8):
    """Items that documents hold, window by window, occurrence by occurrence, without bitmap, candidates or joins."""
    got = set()
    for d, text in docs_:
        for i, item in items:
            for kind, (h, plain, slots, values) in enumerate(decontaminate.windows(item)):
                need = min(3, int(plain.max()))
                want = [k for k in range(len(h)) if plain[k] >= need]
                size, wide = len({int(h[k]) for k in want}), len(h) - 1 + decontaminate.WORDS
                dh, _, dslots, dvalues = decontaminate.windows(text)[kind] if decontaminate.windows(text) else ([], [], [], [])
                pairs = [(a, k) for k in want for a in range(len(dh)) if dh[a] == h[k]]
                inside = lambda slots, values, at: [v for s, v in zip(slots, values) if at <= s < at + decontaminate.WORDS]
                for band in {("all", 0)} | {(w, math.floor((a - k + w * wide / 2) / wide)) for a, k in pairs for w in (0, 1)}:
                    mine = [(a, k) for a, k in pairs if band[0] == "all" or math.floor((a - k + band[0] * wide / 2) / wide) == band[1]]
                    if not mine:
                        continue
                    times = Counter(a - k for a, k in mine)
                    usual = min(times, key=lambda o: (-times[o], o))
                    near = {}
                    for a, k in mine:
                        near[k] = min(near.get(k, (1 << 60, 0)), (abs(a - k - usual), a))
                    if len({int(h[k]) for k in near}) / size < least:
                        continue
                    met = Counter()
                    for k, (_, a) in near.items():
                        x, y = inside(slots, values, k), inside(dslots, dvalues, a)
                        if x and len(x) == len(y):
                            met.update(zip(x, y))
                    of = {}
                    for (x, y), n in met.items():
                        of.setdefault(x, []).append(n)
                    if not of or sum(max(n) for n in of.values()) / sum(map(sum, of.values())) >= least:
                        got.add((d, i))
    return got


def test_decontamination_same_as_brute_force(spark):
    r = random.Random(12)
    words = [r.choice("bcdfglm") + r.choice("aeiou") + r.choice("nrst") for _ in range(25)]
    part = lambda: r.choice([str(r.randint(1, 99)), f"{r.randint(1, 99)} km", r.choice(["Anna", "Berta", "New York"]), *[r.choice(words)] * 7])
    items = [(i, "so " + " ".join(part() for _ in range(r.randint(3, 25)))) for i in range(12)]
    texts = []
    for _ in range(60):
        w = [part() for _ in range(r.randint(0, 30))]
        for _, item in r.sample(items, 2):
            x = item.split()
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                x[r.randrange(len(x))] = part()
            w[(k := r.randint(0, len(w))) : k] = x
        texts.append(" ".join(w))
    got = {(x.doc_id, x.item_id) for x in decontaminate.held(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_held(list(enumerate(texts)), items)
    assert got == want and 30 < len(want) < 120


def test_toxicity(spark):
    r = random.Random(4)
    words = [r.choice("bcdfglmnprst") + r.choice("aeiou") + r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        w = [r.choice(words) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            w[7] = r.choice(("rotter", "scoundrel"))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    restore, lexicon = toxicity.trained(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = lambda t: lexicon.score(restore.distinct(t))
    for t in ("you r0tter", "r o t t e r", "rrrotterrr", "sc0undre1", "s.c.o.u.n.d.r.e.l", "b a m o r o t t e r", "r o t t e r s c o u n d r e l", "r\u043ett\u0435r", "\uff52\uff4f\uff54\uff54\uff45\uff52"):
        assert score(" ".join(words[:20]) + " " + t) >= 0.3, (t, restore(t))
    assert score(" ".join(words[:40])) < 0.3 and score(None) == score("") < 0.3
    assert restore("r0tter") == "rotter" and restore("r o t t e r s c o u n d r e l") == "rotter scoundrel"
    long = "r o t t e r " * 20_000
    assert len(restore(long)) > 100_000 and score(long) >= 0.3
    assert toxicity.classify(docs(spark, ODD), restore, lexicon).count() == len(ODD)


def test_quality(spark):
    r = random.Random(5)
    good = [" ".join("abcdefgh"[r.randrange(8)] * r.randint(1, 6) for _ in range(r.randint(20, 200))) + "." for _ in range(120)]
    junk = [" ".join(r.choice(("###", "$$$ A1", "!!", "ZZ")) for _ in range(r.randint(20, 200))) for _ in range(120)]
    labels = spark.createDataFrame([(i + len(ODD), int(i < 120)) for i in range(240)], "doc_id long, quality int")
    rows = {x.doc_id: x.score for x in quality.classify(docs(spark, ODD + good + junk), labels).collect()}
    assert len(rows) == len(ODD) + 240 and all(0 <= s <= 1 for s in rows.values())
    assert np.mean([rows[i + len(ODD)] > 0.5 for i in range(120)]) > 0.95 and np.mean([rows[i + len(ODD)] < 0.5 for i in range(120, 240)]) > 0.95
    assert {round(x.score, 6) for x in quality.classify(docs(spark, ODD), labels.limit(0)).collect()} == {0.5}


def test_language_model(spark):
    from quern.llm.labelled import remainder

    r = random.Random(6)
    texts = ODD + [" ".join(r.choice(("red fox", "blue sky", "old man", f"w{r.randrange(40)}")) for _ in range(30)) for _ in range(80)]
    rows = {x.doc_id: x for x in pitmanyor.score(docs(spark, texts), remainder(10) == 0).collect()}
    tok = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in enumerate(texts)}
    c = Counter(w for i, t in tok.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tok.items():
        assert rows[i].train_tokens == n and rows[i].n_tokens == len(t) and rows[i].n_known == sum(c[w] > 0 for w in t)
        assert math.isclose(rows[i].base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [x for x in rows.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)  # word pairs are regular here
    one = docs(spark, texts[7:40])
    again = {x.doc_id: x for x in pitmanyor.score(one, remainder(10) == 0, bucket_chars=100).collect()}
    for x in pitmanyor.score(one, remainder(10) == 0).collect():  # as many buckets or more: the same seats
        assert math.isclose(x.score, again[x.doc_id].score, rel_tol=1e-6)
    split = pitmanyor.score(docs(spark, texts), remainder(10) == 0, hot=500).collect()  # hot words in classes
    assert sum(x.score for x in split if x.held_out) > sum(x.base_score for x in held)


def test_language_model_tells_words_apart():
    import pyarrow as pa

    r = random.Random(2)
    words = list({"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(20_000)} | {"a" * n for n in (1023, 1024, 1025, 2048, 5000)} | {"a" * k + "b" + "a" * (3000 - k) for k in (0, 5, 1024, 1029, 2048)})
    h = pitmanyor._hashes(pa.array(words))
    assert len(np.unique(h)) == len(words) and (pitmanyor._hashes(pa.array(words), 100) == h).all() and (pitmanyor._hashes(pa.array(["x", *words]).slice(1)) == h).all()
    assert (pitmanyor._uncut(pitmanyor._cut(h, pitmanyor.WORD), pitmanyor.WORD) == h).all() and len(pitmanyor._hashes(pa.array([], pa.string()))) == 0


def test_language_model_of_odd_tables(spark):
    assert pitmanyor.score(docs(spark, []), F.lit(False)).count() == 0
    rows = pitmanyor.score(docs(spark, ["a b", None, "a b"]), F.lit(True)).collect()  # nothing to learn from
    assert len(rows) == 3 and all(x.train_tokens == x.n_known == 0 and math.isclose(x.base_score, 0, abs_tol=1e-9) for x in rows)
    odd = spark.createDataFrame([(None, "a b c", 1), (None, "a b d", 1), (3, "a b c", 1), (3, "a b c", 1)], "doc_id long, text string, score int")
    rows = pitmanyor.score(odd, F.lit(False)).collect()
    assert sorted((x.doc_id or 0, x.n_tokens) for x in rows) == [(0, 4), (0, 4), (3, 4), (3, 4)] and all(x.train_tokens == 16 for x in rows)


def test_language_model_opens_restaurants_for_rare_contexts(spark):
    r = random.Random(9)
    pairs = [f"a{i} b{i}" for i in range(1500)]  # no word holds a thousandth of the tokens
    texts = [" ".join(r.sample(pairs, 100)) for _ in range(150)]
    rows = [x for x in pitmanyor.score(docs(spark, texts), F.col("doc_id") % 10 == 0).collect() if x.held_out]
    gain = sum(x.score - x.base_score for x in rows) / sum(x.n_tokens for x in rows)
    assert len(rows) == 15 and gain > 1  # every second word follows from the one before


def test_language_model_sweeps_until_scores_settle(spark):
    r = random.Random(12)
    texts = [" ".join(r.choices([f"w{i}" for i in range(30)], [1 / (i + 1) for i in range(30)], k=60)) for _ in range(120)]
    scores = lambda **sweeps: {x.doc_id: x.score for x in pitmanyor.score(docs(spark, texts), F.col("doc_id") % 4 == 0, **sweeps).collect() if x.held_out}
    got, few, many = scores(), scores(burn=0, samples=2), scores(burn=40, samples=60)
    off = lambda some: np.mean([abs(some[i] - many[i]) for i in many])
    assert len(many) == 30 and off(got) < 0.3 < off(few)


def tree_of(words, train=None, extra=()):
    """A tree of numbered words, each after the three before it; extra: (u, v, x, w) that are no customers."""
    w = np.array([0, 0, 0, *words], np.uint64)
    u, v, x, w = w[2:-1], w[1:-2], w[:-3], w[3:]
    more = [np.array(y, np.uint64) for y in zip(*extra)] if extra else [np.zeros(0, np.uint64)] * 4
    u, v, x, w = (np.concatenate(y) for y in zip((u, v, x, w), more))
    return pitmanyor.Tree(u, v, x.astype(np.uint16), w, np.arange(len(w)) < len(words)), w


def test_language_model_root_is_seated_from_drawn_tables(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh"[: r.randint(2, 8)]) for _ in range(60)) for _ in range(40)]
    rooted, seen = pitmanyor._rooted, []
    monkeypatch.setattr(pitmanyor, "_rooted", lambda asked: seen.append(rooted(asked)) or seen[-1])
    pitmanyor.score(docs(spark, texts), F.lit(False)).count()
    (_, first), (_, last) = seen
    assert first[:2] == last[:2] and last[2] > first[2] and last[3] >= last[1]  # the same tokens and words; more tables than one a dish
    words = [r.randint(1, 9) for _ in range(600)]
    tree, _ = tree_of(words)
    base = np.full(len(tree.words), 1 / len(tree.words))
    for _ in range(3):
        tree.sweep(base)
    seats, p = tree.seats(), tree.chances(base)
    again, _ = tree_of(words)
    again.take(*seats, tree.no)
    assert (again.chances(base) == p).all() and (again.sent() == tree.sent()).all()
    tree.sweep(base), again.sweep(base)
    assert all((a == b).all() for a, b in zip(tree.t, again.t))
    with pytest.raises(ValueError):
        tree_of(words[1:])[0].take(*seats, 3)


def test_language_model_sums_to_one():
    r = np.random.default_rng(1)
    words = r.integers(1, 9, 400)
    for context in ((3, 4, 5), (int(words[9]), int(words[8]), int(words[7])), (77, 78, 79)):
        tree, w = tree_of(words, extra=[(*context, k) for k in range(1, 10)])  # word 9 isn't known
        m = tree.sent()
        m[tree.words == 9] = 0
        t = pitmanyor.root_tables(tree.words, m, 8, 8.0, 0)
        root = pitmanyor.root_chances(m, t, 8, m.sum(), t.sum())
        assert math.isclose(root.sum(), 1)
        for _ in range(3):
            tree.sweep(root)
            assert math.isclose(tree.chances(root)[tree.leaf[-9:]].sum(), 1)
            for k in range(3):
                assert (tree.t[k] <= tree.c[k]).all() and ((tree.t[k] > 0) == (tree.c[k] > 0)).all()
                assert (tree.all_c[k] == np.bincount(tree.rest[k], tree.c[k])).all() and (tree.all_t[k] == np.bincount(tree.rest[k], tree.t[k])).all()
                assert k == 2 or (tree.c[k] == np.bincount(tree.up[k + 1], tree.t[k + 1], len(tree.c[k]))).all()


def test_language_model_packs_hashes_by_their_differences():
    r = np.random.default_rng(4)
    h = np.sort(r.integers(0, 1 << 63, 5000, np.uint64)) & ~np.uint64(0xFF)
    packed = pitmanyor._deltas(h, 7)
    assert (pitmanyor._undeltas(packed, 7) == h).all() and len(packed) < 6.1 * len(h)  # seven bytes each before
    for x in (h[::-1].copy(), h[:1], h[:0]):
        assert (pitmanyor._undeltas(pitmanyor._deltas(x, 7), 7) == x).all()
    assert (pitmanyor._undeltas(pitmanyor._deltas(h, 6), 6) == h & ~np.uint64(0xFFFF)).all()


def test_language_model_numbers_hashes():
    r = np.random.default_rng(5)
    apart = r.integers(0, 1 << 63, 900, np.uint64)
    near = np.array([7 << 40, (7 << 40) + 1, (7 << 40) + 2], np.uint64)  # told apart by their lowest bits only
    for x in (apart[r.integers(0, 900, 5000)], np.concatenate([near, near, apart])[r.permutation(906)], np.zeros(0, np.uint64), near[:1]):
        code, first = pitmanyor._codes(x)
        distinct, want = np.unique(x, return_inverse=True)
        assert (code == want).all() and (x[first] == distinct).all() and (first == np.unique(x, return_index=True)[1]).all()


def test_language_model_sweeps_only_what_can_change():
    r = random.Random(9)
    words = [int(r.expovariate(0.15)) for _ in range(3000)]
    tree, w = tree_of(words)
    base = np.full(len(tree.words), 1 / 60)
    for _ in range(4):
        tree.sweep(base)
        for k in range(3):
            c = np.bincount(tree.up[k + 1], tree.t[k + 1], len(tree.key[k])) if k < 2 else np.bincount(tree.leaf, np.arange(len(w)) < len(words), len(tree.key[k]))
            assert (tree.c[k] == c).all() and (tree.t[k] <= c).all() and (tree.t[k] >= np.minimum(c, 1)).all()
            assert (tree.all_c[k] == np.bincount(tree.rest[k], c)).all() and (tree.all_t[k] == np.bincount(tree.rest[k], tree.t[k])).all()
    assert sum(map(len, tree.part.key)) < sum(map(len, tree.key)) / 2
    assert all(len(at) == len(set(zip(tree.rest[k][at], tree.key[k][at]))) for k, at in enumerate(tree.ats))


def seats_by_hand(words, root, sweeps, seed):
    """Customers at tables, moved one at a time: the mean probability of each (context, word) seen, after a third of the sweeps."""
    r, levels = random.Random(seed), [pitmanyor.LEVELS[k] for k in range(3)]
    rooms = {}  # context -> word -> sizes of tables

    def chance(context, w):
        if not context:
            return root[w]
        d, s = levels[len(context) - 1]
        room = rooms.get(context, {})
        sizes = room.get(w, [])
        n, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        return (sum(sizes) - d * len(sizes) + (s + d * t) * chance(context[:-1], w)) / (s + n)

    def sit(context, w):
        if not context:
            return
        d, s = levels[len(context) - 1]
        room = rooms.setdefault(context, {})
        sizes = room.setdefault(w, [])
        fresh = (s + d * sum(map(len, room.values()))) * chance(context[:-1], w)
        at = r.random() * (sum(sizes) - d * len(sizes) + fresh)
        for i, n in enumerate(sizes):
            at -= n - d
            if at < 0:
                sizes[i] += 1
                return
        sizes.append(1)
        sit(context[:-1], w)

    def leave(context, w):
        if not context:
            return
        sizes = rooms[context][w]
        i = r.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            leave(context[:-1], w)

    p = [0, 0, 0, *words]
    seen = [((p[i - 1], p[i - 2], p[i - 3]), p[i]) for i in range(3, len(p))]
    total, n = Counter(), 0
    for c, w in seen:
        sit(c, w)
    for k in range(sweeps):
        for c, w in seen:
            leave(c, w)
            sit(c, w)
        if k >= sweeps // 3:
            n += 1
            for c, w in set(seen):
                total[c, w] += chance(c, w)
    return {k: x / n for k, x in total.items()}


def test_language_model_seats_as_a_sampler_of_single_customers():
    r = random.Random(5)
    words = [w for _ in range(25) for w in r.choice(([1, 2, 3], [1, 2, 4], [1, 1, 2], [5]))]
    root = {w: 0.2 for w in range(1, 6)}
    want = seats_by_hand(words, root, 3000, 1)
    tree, w = tree_of(words)
    p, mean = np.array([0.2] * len(tree.words)), 0.0
    for k in range(3000):
        tree.sweep(p, colours=None)
        mean = mean + tree.chances(p) * (k >= 1000) / 2000
    q = [0, 0, 0, *words]
    for i, leaf in enumerate(tree.leaf):
        assert abs(mean[leaf] - want[(q[i + 2], q[i + 1], q[i]), q[i + 3]]) < 0.015
    # and all at once
    tree, mean = tree_of(words)[0], 0.0
    for k in range(1500):
        tree.sweep(p)
        mean = mean + tree.chances(p) * (k >= 500) / 1000
    assert all(abs(mean[leaf] - want[(q[i + 2], q[i + 1], q[i]), q[i + 3]]) < 0.03 for i, leaf in enumerate(tree.leaf))


def test_language_model_in_stretches_is_near_the_exact_draw():
    key, n = np.arange(3000, dtype=np.uint64), 3000
    for base, rest in ((0.3, 5), (0.01, 40)):
        exact = pitmanyor.stirling(0.75)[1000, 1:1001] + np.cumsum(np.log((1 + 0.75 * (rest + np.arange(1000))) * base))
        p = np.exp(exact - exact.max())
        mean = (np.arange(1, 1001) * p).sum() / p.sum()
        got = pitmanyor._stretches(key, 0, np.full(n, 1000), np.full(n, rest), np.full(n, base), 0.75, 1.0).mean()
        assert abs((1000 - 0.75 * got) / (1000 - 0.75 * mean) - 1) < 0.1  # what the dish's probability depends on


def test_embeddings(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(300, 16))
    x[50:90] = x[0] + 0.05 * r.normal(size=(40, 16))
    x[100:110] = x[99]
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(np.float32(x))] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0, 2.0], 1), (905, [], 1)]
    rows += [(None, [3.0, 1.0], 1), (904, [2.0, 4.0], 1), (907, [1.0] * 5000, 1), (907, [1.0] * 5000, 1)]
    got = {a.vec_id: a for a in neardup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")).collect()}
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i].n_links for i in range(300)] == (near.sum(axis=1) - 1).tolist()
    assert all(got[i].component_id == 99 for i in range(99, 110)) and all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 905))
    assert got[904].n_links == got[907].n_links == 1 and got[None].n_links == 0 and got[0].audit_recall == 1
    assert neardup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_groups():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 200, 150), r.integers(0, 200, 150)
    low = list(range(200))
    for _ in range(200):
        for i, j in zip(a, b):
            low[i] = low[j] = min(low[i], low[j])
    label = neardup.groups(200, a[:80], b[:80])
    assert neardup.groups(200, a, b).tolist() == low == neardup.groups(200, a[80:], b[80:], label).tolist()


def test_graph_recall():
    x = np.random.default_rng(8).normal(size=(3000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = neardup.Graph(x)
    found = g.above(x[:200], 0.8, 48)
    truth = [set(np.flatnonzero(row >= 0.8)) for row in x[:200] @ x.T]
    assert sum(len(t & set(f)) for t, f in zip(truth, found)) >= 0.95 * sum(map(len, truth))


def test_graph_of_one_dense_cluster():
    x = np.random.default_rng(8).normal(size=(1, 16)) + 0.01 * np.random.default_rng(9).normal(size=(4000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = neardup.Graph(x)
    began = time.process_time()
    assert all(len(f) == 4000 for f in g.above(x[:64], 0.95, 48)) and time.process_time() - began < 5


def test_warc(spark):
    same = "<p>é</p>" * 300
    rows = [(1, "http://a/", same, 0), (2, "http://b/", same, 0), (3, None, None, 0), (4, "u", "short", 0), (5, "u", "short", 0), (None, "u", "x" * 200_000, 0)]
    got = {r.page_id: r for r in warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, payload int"))).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response" and got[2].payload.decode() == same
    assert got[1].payload_bytes == got[2].payload_bytes == len(same.encode()) and got[1].payload_digest == got[2].payload_digest
    assert got[3].payload_bytes == 0 and got[4].record_type == got[5].record_type == "response" and got[None].payload_bytes == 200_000
    ok = [(1, "revisit", "aa", 2), (2, "response", "aa", None), (2, "response", "bb", None)]
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, record_type string, payload_digest string, refers_to long")
    assert warc.checked(frame(ok)).count() == 3
    for bad in ((1, "revisit", "cc", 2), (1, "revisit", "aa", 5), (1, "revisit", "aa", None)):
        with pytest.raises(warc.WarcError):
            warc.checked(frame([bad, *ok]))
    data = warc.record(7, "u", b"body")
    broken = gzip.compress(gzip.decompress(data).replace(b"body", b"bodi"))
    assert warc.read_bytes(data + data)[1]["page_id"] == 7
    swollen = gzip.compress(gzip.decompress(data) + bytes(1 << 24))
    short = gzip.compress(gzip.decompress(data).replace(b"body", b"bo"))
    many = [bytes([i]) * (i * 977) for i in range(150)]
    assert [x["payload"] for x in warc.read_bytes(b"".join(warc.record(i, "u", p) for i, p in enumerate(many)))] == many
    for bad in (broken, data[:-9], b"junk", swollen, short, gzip.compress(bytes(1 << 22))):
        with pytest.raises(warc.WarcError):
            warc.read_bytes(bad)


def test_main_text(spark):
    page = "<html><head><title>T</title></head><body><header class=site-header><h2>My site</h2></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Heads  &amp; tails</h1><p>The first paragraph says a good deal about it.<p>The second one\n says more, and more.</p><div class=ad>Buy now, cheap.</div></article><section class=comments><h3>Comments</h3><div class=comment><p>I don't agree with any of this.</p></div></section><footer>&copy; 2020</footer><script>var x = '</p>';</script></body></html>"
    rows = spark.createDataFrame([(1, "u", page, 0), (2, "u", None, 0), (3, "u", "", 0), (4, "u", "<div>" * 3000 + "<p>deep", 0), (5, "u", "<<<>&& <", 0)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html.main_text(rows).collect()}
    assert got[1] == "Heads & tails\nThe first paragraph says a good deal about it.\nThe second one says more, and more."
    assert got[2] == got[3] == "" and len(got) == 5


@pytest.mark.parametrize("tag", ["select", "svg", "object", "canvas", "video"])
def test_main_text_after_a_tag_left_open(spark, tag):
    page = f"<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><{tag} class=x><article><h1>Heads</h1><p>The first paragraph says a good deal about it.</p><p>The second one says more, and more.</p></article><footer>&copy; 2020</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page, 0)], "page_id long, url string, html string, text int")
    assert html.main_text(rows).first().text == "Heads\nThe first paragraph says a good deal about it.\nThe second one says more, and more."


class Article(HTMLParser):
    """Blocks of text in <article>, by the standard library's parser."""

    INLINE = ("a", "b", "i", "em", "span", "strong")

    def __init__(self, page):
        super().__init__()
        self.on, self.out, self.buf = False, [], []
        self.feed(page)

    def cut(self):
        text, self.buf = " ".join("".join(self.buf).split()), []
        if self.on and text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.buf.append(" ")
        elif tag not in self.INLINE:
            self.cut()
            self.on |= tag == "article"

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.cut()
            self.on &= tag != "article"

    def handle_data(self, data):
        self.buf.append(data)


def test_main_text_of_all_pages(spark):
    """These pages keep their main text in <article>."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: "\n".join(Article(r.html or "").out) for r in pages.collect()}
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert got == want and len(got) > 2000


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "<p>x", "<div>" * 50_000 + "</div>" * 50_000, "<p><button>" + "<div>" * 50_000 + "x", '<a "' * 100_000, "<!--" * 100_000, "<ul><li>x" * 20_000, "<svg>" * 30_000, "<" * 500_000], ids=range(9))
def test_page_scanner_is_linear(page):
    html.Page(page[:1000])
    began = time.process_time()
    html.Page(page)
    assert time.process_time() - began < 2


@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("names", ["kopfzeile artikel werbung kommentare", "a1 a2 a3 a4", "header article ad comments", "entete contenu publicite commentaires"])
@pytest.mark.parametrize("n", [1, 4])
def test_main_text_whatever_the_names(tag, names, n):
    top, art, ad, com = names.split()
    paras = [f"The {w} paragraph says a good deal about the matter at hand, and more." for w in ("first", "second", "third", "fourth")[:n]]
    page = f'<html><body><{tag} class="{top}"><a href=/>Home</a> <a href=/n>News</a></{tag}><{tag} class="{art}"><h1>Big news of today</h1>{"".join(f"<p>{p}</p>" for p in paras)}<{tag} class="{ad}"><p>Kaufen Sie jetzt billig.</p></{tag}></{tag}><{tag} class="{com}"><p>I do not agree with that at all.</p></{tag}></body></html>'
    assert html.extract(page, html.model()).split("\n") == ["Big news of today", *paras]


def test_main_text_keeps_all_of_the_article():
    read = lambda x: html.extract(x, html.model())
    assert read("<html><body><article><h1>Title here</h1><p>One paragraph of text that is long enough.</p><p class='review'>This is a real paragraph with a class.</p><footer><p>Share this</p></footer></article></body></html>") == "Title here\nOne paragraph of text that is long enough.\nThis is a real paragraph with a class."
    assert read("<html><body><nav><a href=/>x</a></nav><article><p>Before it <math><mi>x</mi><mo>=</mo><mn>1</mn></math> after.</p><noscript><p>Inside noscript text.</p></noscript><object><p>In object <object>nested</object> end.</p></object></article><footer>c</footer></body></html>") == "Before it x=1 after.\nInside noscript text.\nIn object\nnested\nend."
    assert read("<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><footer>&copy; 2020 some firm</footer></body></html>") == ""


def test_main_text_of_an_empty_table(spark):
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0
