"""Ids of any long, and words of any length."""

from __future__ import annotations

from math import isfinite

import public_tokenizers
from pyspark.sql import functions as F

from palisade.llm import lattice_lm

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_extreme_ids_and_long_words(spark):
    rows = [(2**63 - 1, "ab " * 40 + "x" * 3000), (-(2**63), "ab cd"), (2**61, "x" * 3000 + " " + "yz" * 1500), (0, ""), (None, None), (None, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lattice_lm.score_documents(docs, MODEL, F.coalesce(F.col("doc_id") != 2**61, F.lit(None))).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=repr) == sorted(((i, len((t or "").split()) + 1) for i, t in rows), key=repr)
    assert all(isfinite(r.score) and r.score < 0 and isfinite(r.base_score) for r in found)
    of = {r.doc_id: r for r in found if r.doc_id is not None}
    # the long word is known from training, the other one is not; rows without an id do not teach
    assert of[2**61].n_known == 2 and not of[2**61].train and of[2**63 - 1].train
    assert {r.train_tokens for r in found} == {41 + 1 + 2 + 1 + 1}
