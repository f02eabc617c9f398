import hashlib
import math
from collections import Counter

import pytest
from conftest_llm import rows_of

from episight.llm import mixing as M


def copies(rate, ident, seed=17):
    u = (int(hashlib.md5(f"{seed}|count|{ident}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    if rate <= 0:
        return 0
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def brute(rows, temperature=0.7):
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").encode()) + 1
    want = {s: b**temperature for s, b in size.items()}
    total, wants = sum(size.values()), sum(want.values())
    rate = {s: round(want[s] / wants * total / size[s], 6) for s in size}
    ident = lambda d, t: "null|" + hashlib.md5((t or "").encode()).hexdigest() if d is None else d
    return Counter((d, i) for d, t, s in rows for i in range(copies(rate[s], ident(d, t))))


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_copies_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    got = M.mix(docs).collect()
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = brute(rows)
    assert Counter((r.doc_id, r["copy"]) for r in got) == want
    assert {"rate", "n_copies", "copy", "mix_key"} <= set(M.mix(docs).columns)


def test_wanted_weights_are_met(spark):
    rows = [(i, "x" * 50, "big" if i % 10 else "rare") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.source for r in M.mix(docs, weights={"big": 1, "rare": 1}).select("source").collect())
    assert got["rare"] / sum(got.values()) == pytest.approx(0.5, abs=0.02)
    assert sum(got.values()) == pytest.approx(20_000, rel=0.03)
    assert {r.source for r in M.mix(docs, weights={"rare": 1}).select("source").distinct().collect()} == {"rare"}


def test_no_python_in_the_plan(documents):
    plan = M.mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_stage_form_has_the_columns_of_documents(documents):
    out = M.mix(documents, extras=False)
    assert out.columns == documents.columns and {r.doc_id for r in out.collect()} <= {i for i, _ in rows_of(documents)}


def test_large_means_keep_their_mass(spark):
    from pyspark.sql import functions as F

    t = spark.range(1).select(M.poisson_table(F.lit(900.0)).alias("t")).first().t
    assert t[-1] == pytest.approx(1, abs=1e-9) and t[900] == pytest.approx(0.5088, abs=1e-3)


def test_rows_without_ids_are_kept_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "a") for i in range(2000)], "doc_id long, text string, source string")
    assert M.mix(docs).count() == pytest.approx(2000, rel=0.1)
