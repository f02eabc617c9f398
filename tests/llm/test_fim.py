"""Cutting and reordering against plain code over code points, and back again."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from conftest_llm import rows_of, same_ids

from episight.llm import fim, queries


def plain(i, text):
    digest = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
@pytest.mark.parametrize("chunk", [3, 4096])
def test_equals_plain_code_and_goes_back(request, which, chunk):
    docs = request.getfixturevalue(which)
    got = fim.restore(fim.transform(docs, chunk=chunk)).collect()
    assert same_ids(got, docs)
    want = [plain(i, t) for i, t in rows_of(docs)]
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == sorted(map(repr, want))
    assert sorted(repr((r.doc_id, r.restored)) for r in got) == sorted(repr((i, t)) for i, t in rows_of(docs))


def test_sentinels_in_texts_and_at_cuts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["<", "P", "S", "M", ">", "é", "🙂", "<P", "S>", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fim.restore(fim.transform(docs, chunk=2)).collect()}
    assert all(got[i].restored == t and (got[i].doc_id, got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output) == plain(i, t) for i, t in enumerate(texts))


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_places_of_units(unit, chunk):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab é\n 漢") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    cut = fim.Cutter(pa.array(["skip", *texts])[1:], unit, chunk)
    for k, t in enumerate(texts):
        starts = [i for i in range(len(t)) if not i or unit == "char" or (unit == "word" and t[i - 1] in " \n" and t[i] not in " \n") or (unit == "line" and t[i - 1] == "\n")]
        want = [len(t[:i].encode()) for i in [*starts, len(t)]]
        assert cut.n[k] == len(starts) and [cut.place(k, r) for r in range(len(starts) + 1)] == want


def test_words_and_lines_go_back(documents):
    for unit in ("word", "line"):
        got = fim.restore(fim.transform(documents, seed="7", unit=unit, plain_from=100, spm_below=50, sentinels=("\x01p\x02", "\x01s\x02", "\x01m\x02")), ("\x01p\x02", "\x01s\x02", "\x01m\x02")).collect()
        assert sorted((r.doc_id, r.restored) for r in got) == sorted(rows_of(documents))


def test_refused():
    for bad in ({"unit": "page"}, {"sentinels": ("<P>", "<P>", "<M>")}, {"sentinels": ("<P>", "><S", "<M>")}, {"sentinels": ("ab", "b", "c")}):
        with pytest.raises(ValueError):
            fim.transform(None, **bad)


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.sql(queries.OP11_SQL)
    got = queries.op11_fill_in_middle(spark, small)
    names = sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(got.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
