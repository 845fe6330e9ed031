import random
from types import SimpleNamespace

import pytest

from quern.llm import common


def test_shared_folder_must_be_named_on_a_cluster(spark):
    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None, isModifiable=lambda *a: True)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    for master in ("local", "local[4]", "local[*]"):
        assert common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))).startswith("file:///")
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stored_tables_can_be_removed(spark):
    kept, before = list(common.MADE), spark.conf.get(common.CLEANUP, "false")
    common.MADE.clear()
    a, b = common.store(spark.range(5)), common.store(spark.range(0))
    assert a.count() == 5 and b.count() == 0 and spark.conf.get(common.CLEANUP, "false") == before
    common.forget(a)
    with pytest.raises(Exception):
        a.count()
    common.cleanup(spark)
    with pytest.raises(Exception):
        b.count()
    assert not common.MADE
    common.MADE.extend(kept)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(0, i) for i in range(500, 900)] + [(i, i + 1) for i in range(1000, 1060)]
    low = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: y for x, y in low.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
