import random

import pytest

import corpus_pipeline as cp
from quern.llm import simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long, _k string, _id string, d string, _lines string, fp string, score string"
PROSE = "the quick keeper of the old lighthouse counted every ship that passed the northern cape during the long winter of storms and wrote each name into a heavy book by the light of one lamp"
ITEM = "A farmer has 12 sheep and buys 7 more at the market before selling 5 of them to a neighbour called Anna on the way back home"


def prose(k):
    return " ".join(f"{w}{'aeiou'[(i * k) % 5]}{k}" for i, w in enumerate(PROSE.split()))


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "en", None if n % 3 else "s", None if t is None else len(t), "k", "i", "d", "l", "f", "x") for n, (i, t) in enumerate(pairs)], DOC)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100, 300)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_odd_rows_and_empty_table(spark, sf, stage):
    odd = rows(spark, [(None, None), (1, ""), (1, None), (2, " \n "), (None, "word"), (3, "x " * 30_000), (4, prose(3)), (4, prose(3))])
    out = stage(spark, odd, sf)
    assert out.count() <= 8 and (stage is cp.mix_sources or out.columns == odd.columns)
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_near_duplicates_keeps_one_of_each_group(spark, sf):
    # rows without an id, and rows of one id, hold different texts: none of them may go for another's sake
    given = [(None, prose(1)), (None, prose(2)), (5, prose(3)), (5, prose(4)), (7, prose(1)), (9, prose(4)), (9, prose(4)), (None, prose(5)), (None, prose(5))]
    kept = cp.drop_near_duplicates(spark, rows(spark, given), sf)
    assert pairs(kept) == sorted([(7, prose(1)), (None, prose(2)), (5, prose(3)), (5, prose(4)), (None, prose(5))], key=str)
    assert {tuple(r)[5:] for r in kept.collect()} == {("k", "i", "d", "l", "f", "x")}


def test_near_copies_go_as_by_brute_force(spark, sf):
    r = random.Random(11)
    texts = []
    for _ in range(25):
        w = [f"w{r.randrange(5000)}" for _ in range(r.choice((3, 30, 200, 400)))]
        texts.append(w)
        for _ in range(r.choice((1, 6))):  # copies with some words replaced, and copies of these
            w = list(r.choice(texts[-3:]))
            for _ in range(r.choice((0, 1, 4, 8, 15))):
                w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
            texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    low = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    given = [(i, " ".join(w)) for i, w in enumerate(texts)]
    far = sum(((simhash.fingerprint(given[i][1]) ^ simhash.fingerprint(given[j][1])) & (2**64 - 1)).bit_count() > 2 for i, j in links)
    assert far > 10  # pairs that links at two bits of three-word shingles would miss
    assert pairs(cp.drop_near_duplicates(spark, rows(spark, given), sf)) == sorted([given[i] for i in set(low)], key=str)


def test_near_duplicates_are_linked_by_fingerprints_too(spark, sf):
    # repeats outweigh the rest: few bits differ, though the sets of shingles share little
    given = [(i, f"{prose(1)} " * 300 + " ".join(f"w{i}x{j}" for j in range(90))) for i in range(1, 4)] + [(9, prose(5))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in given)]
    bits = lambda i, j: ((simhash.fingerprint(given[i][1]) ^ simhash.fingerprint(given[j][1])) & (2**64 - 1)).bit_count()
    assert all(bits(i, j) <= 2 and len(sets[i] & sets[j]) < 0.5 * len(sets[i] | sets[j]) for i, j in ((0, 1), (1, 2))) and bits(0, 3) > 2
    # a copy of the last one's set at 0.8 is linked with it, and so with all of them
    near = " ".join(given[2][1].split()[:-8])
    assert pairs(cp.drop_near_duplicates(spark, rows(spark, [*given, (5, near)]), sf)) == [given[0], given[3]]
    # the same groups as of operator 9, where no similarity of sets adds to them
    classes = simhash.dedup(rows(spark, given)).select("doc_id", "component_id")
    assert classes.exceptAll(simhash.near_duplicates(rows(spark, given)).select("doc_id", "component_id")).count() == 0


def test_contamination_of_one_row_spares_others_of_its_id(spark, sf):
    given = [(None, prose(1)), (None, f"{prose(2)} {ITEM}"), (5, prose(3)), (5, ITEM), (6, None), (7, ""), (8, f"Say. {ITEM}. {prose(4)}")]
    assert pairs(cp.drop_contaminated(spark, rows(spark, given), sf)) == sorted([(None, prose(1)), (5, prose(3)), (6, None), (7, "")], key=str)


def test_lines_that_stand_elsewhere_go(spark, sf):
    given = [(1, f"own one\n{prose(1)}\nown two"), (2, f"other\n{prose(1)}\nend"), (None, prose(2)), (3, None)]
    out = {r.doc_id: r for r in cp.drop_lines(spark, rows(spark, given), sf).collect()}
    assert out[1].text == given[0][1] and out[2].text == "other\nend" and out[2].n_chars == 9
    assert out[None].text == prose(2) and out[3].text is None and out[3].n_chars is None
    assert tuple(out[2])[5:] == ("k", "i", "d", "l", "f", "x")


def test_toxic_rows_go(spark, sf):
    texts = [(i, f"{prose(i)} you rotter" if i % 4 == 0 else prose(i)) for i in range(100, 300)]
    kept = cp.drop_toxic(spark, rows(spark, texts + [(None, None), (1, "")]), sf)
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, _ in texts if i % 4} | {None, 1}


def test_run_goes_through_all_stages(spark, sf):
    at = f"{sf}/documents.parquet"
    rows(spark, [(i, prose(i)) for i in range(100, 130)] + [(400, prose(101)), (401, ITEM), (None, None)]).write.parquet(at)
    out = cp.run(spark, sf)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(got) and {"doc_id", "size", "source_size", "target", "taken"} <= set(out.columns)
    # the item goes; line dedup empties the copy, which then stands for all empty documents
    assert set(got) == {*range(100, 130), 400} and got[400].size == 0 and all(got[i].size for i in range(100, 130))
