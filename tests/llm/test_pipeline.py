"""The pipeline: every stage on its own input against a plain version, then the whole of it."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerlift.llm.common import stored  # noqa: E402

from . import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {}
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given[name] = docs.collect()
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == schema.names
    last = docs.collect()
    after = [*list(given.values())[1:], last]
    language, exact, near, mixed = (Counter(r.doc_id for r in rows) for rows in after)
    lettered = [r for r in given["language_id"] if r.text and any(c.isalpha() for c in r.text)]
    assert set(language) <= {r.doc_id for r in lettered} and len(language) >= 0.9 * len(lettered)
    assert set(exact) == set(brute.winners([(r.doc_id, r.text) for r in given["exact_dedup"]]).values())
    root = brute.components([(r.doc_id, r.text) for r in given["near_dedup"]], corpus_pipeline.NEAR)
    assert set(near) == {i for i, r in root.items() if i == r}
    assert set(mixed) <= set(near) and max(mixed.values()) <= 2
    assert sum(len(brute.words(r.text)) for r in last) == pytest.approx(1.5 * sum(len(brute.words(r.text)) for r in given["mixing"]), rel=0.1)
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation(), tokenizer.no_padding()
    want = Counter()
    for r in last:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in coded) == want
