"""Token counts of a sentencepiece vocabulary without encoding every word.

No vocabulary string has the space mark after another character, so a merge never crosses into the next run of
spaces: a text is cut before each run, and its count is the sum over these pre-tokens. Vocabulary strings that encode
alone as one token are found out before the job (`proven`, bounded by the vocabulary); a pre-token among them counts
one. Only the others are merged by the library, and remembered within a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import slices

SPACE = "▁"
UNITS = re.compile(r" *[^ ]+| +$")
#: Merged pre-tokens that a worker remembers; beyond it, it forgets all and starts anew.
REMEMBERED = 400_000


@lru_cache(maxsize=2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def proven(path: str) -> frozenset[str]:
    """Pre-tokens (without their space mark) of which the library makes one token. Raises if the vocabulary does not
    allow the cut before spaces."""
    model = processor(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in piece.lstrip(SPACE) for piece in pieces):
        raise ValueError("a vocabulary string goes on past a space")
    words = [p[1:] for p in pieces if p.startswith(SPACE) and len(p) > 1 and p[1] != SPACE]
    return frozenset(w for w, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1)


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with what follows them, each without the one space that the library puts in front."""
    text = text.replace(SPACE, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    units = UNITS.findall(text)
    return units[:1] + [unit[1:] for unit in units[1:]]


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs`, repeated rows included.

    A null or empty text has no bytes and no tokens; a null id stays null; an empty table gives an empty one; other
    columns of `docs` are not read. No shuffle; one text at a time is held."""
    whole = proven(path)
    kind = docs.schema[doc_id].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = processor(path), dict.fromkeys(whole, 1) | {"": 1}
        first = len(known)
        for batch in slices(batches, "t"):
            texts = [x or "" for x in batch.column("t").to_pylist()]
            units = [pre_tokens(x) for x in texts]
            if len(known) - first > REMEMBERED:
                known = dict.fromkeys(whole, 1) | {"": 1}
            rest = list(set().union(*units) - known.keys())
            known.update(zip(rest, map(len, model.encode(rest, num_threads=1)), strict=True))
            counts = np.array([sum(map(known.__getitem__, x)) for x in units], np.int64)
            size = pc.binary_length(batch.column("t")).fill_null(0).cast(pa.int64())
            yield pa.record_batch([batch.column("i"), size, pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return out.mapInArrow(make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
