import zlib
from collections import Counter

import pytest
from conftest_llm import rows_of, same_ids

from episight.llm import sharding as S


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_slots_sizes_and_checksums(request, which):
    docs = request.getfixturevalue(which)
    got = S.histogram_shards(docs).collect()
    assert same_ids(got, docs)
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows_of(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_bytes_are_near_equal_with_a_hot_group(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(30_000)]
    got = S.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    share = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(x - share) <= 0.004 * share + 400 for x in size.values())


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 500} " * 9) for i in range(10_000)]
    at = {}
    for r in S.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, tolerance=0.01).collect():
        at.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(x) > 1 for x in at.values()) == 0


def test_other_columns_and_other_counts(edge):
    out = S.histogram_shards(edge, shards=3, keep=True)
    assert {"lang", "source", "row"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert {r.shard for r in out.collect()} <= {0, 1, 2} and out.count() == edge.count()


def test_splitters_count_exactly_and_keep_their_tolerance(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rows = [(i, "hot text " * 9 if i % 3 == 0 else f"text {i} " * (1 + i % 30)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = df.select(S.sort_key(F.col("text"), F.col("doc_id")).alias("key"), (F.octet_length("text") + 1).cast("long").alias("size")).cache()
    cut, below, rows_below, _ = S.splitters(keys, 8, 50, 0.002, 0.5)
    key, size = (np.array(x) for x in zip(*[(r.key, r.size) for r in keys.collect()]))
    total = size.sum()
    assert len(cut) == 399 and (np.diff(cut) >= 0).all()
    for i in range(0, 399, 7):
        assert below[i] == size[key < cut[i]].sum() and rows_below[i] == (key < cut[i]).sum()
    goal = total * np.arange(1, 400) / 400
    main = np.arange(1, 400) % 50 == 0
    assert (np.abs(below - goal)[main] <= 0.002 * total / 8 + size.max()).all()
    assert (np.abs(below - goal) <= 0.5 * total / 400 + size.max()).all()
    keys.unpersist()
