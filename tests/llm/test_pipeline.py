"""The pipeline, each stage against its brute-force version over the stage's own input."""

import re

import public_tokenizers
import pytest
from test_mixing import brute as brute_copies
from test_simhash import brute_groups
from tokenizers import Tokenizer

import corpus_pipeline
from episight.llm import quality
from episight.llm.common import tidied


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_stages(request, spark, small, tmp_path, which):
    docs = request.getfixturevalue(which)
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, small).write.parquet(str(tmp_path / str(k)))
        before, out = out.collect(), spark.read.parquet(str(tmp_path / str(k)))
        after = out.collect()
        if k < 3:
            assert out.columns == docs.columns
        if k == 0:
            good = {(r.doc_id, r.n_words) for r in quality.quality_rules(docs, public_tokenizers.path("piece_bpe_32k.model")).collect() if r.kept}
            assert {r.doc_id for r in after} == {i for i, _ in good}
        elif k == 1:
            want = set(brute_groups([(r.doc_id, r.text or "") for r in before]))
            assert {r.doc_id for r in after} - {None} == {w for w in want if not isinstance(w, tuple)}
            assert len(after) == len(want)
        elif k == 2:
            want = brute_copies([(r.doc_id, r.text, r.source) for r in before])
            assert sorted(repr(r.doc_id) for r in after) == sorted(repr(d) for (d, _), n in want.items() for _ in range(n))
            assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert sorted(repr((r.doc_id, r.n_tokens, r.ids)) for r in after) == sorted(repr((r.doc_id, len(ids), ids)) for r in before for ids in [tok.encode(r.text or "", add_special_tokens=False).ids])
            assert all(r.round_trips for r in after) and set(docs.columns) <= set(out.columns)


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_workers_give_memory_back():
    """What a task has freed goes back to the system, as its worker waits for others then."""
    kept = []

    def run(batches):
        for n in batches:
            texts = [b"x" * (1000 + k % 7) for k in range(n)]
            kept.append(texts[-1])  # stands behind what is freed
            yield n

    before = held_mb()
    assert list(tidied(run)(iter([100_000]))) == [100_000]
    assert held_mb() - before < 30
    list(run(iter([100_000])))
    assert held_mb() - before > 60


def test_run_has_the_rows_of_the_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.count() > 0 and {"doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trips"} <= set(got.columns)
