"""A mix of sources near target weights, made of whole documents.

Documents are counted by exact length in words. A source is taken in layers, each document once in each: whole layers
as often as the budget holds them; of the rest of it, each length gets its share, and a bounded knapsack over the
lengths that are left (dynamic programming over reachable sums) fills what remains. Which documents of a length are taken follows a seeded
order. Only scalars and each source's histogram of lengths are ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import slices, stored, utf8, with_rank
from palisade.llm.words import word_count

#: Words of budget that the knapsack fills exactly, after shares and a few long documents have filled the rest.
KNAPSACK = 1 << 16


def reachable(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """So many documents of each length that their sum is the largest that is not above the budget."""
    full, reach, steps = (1 << budget + 1) - 1, 1, []
    for length, count in zip(lengths, counts, strict=True):
        count, size = min(count, budget // length) if length else 0, 1
        while count and not reach >> budget & 1:
            n = min(size, count)
            more = (reach | reach << length * n) & full
            if more != reach:
                steps.append((length, n, reach))
            reach, count, size = more, count - n, size * 2
    total, took = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            took[length] = took.get(length, 0) + n
            total -= length * n
    return took


def fill(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """Documents of each length for a budget below the sum of all."""
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not whole:
        return {}
    took = {n: c * budget // whole for n, c in zip(lengths, counts, strict=True) if n}
    rest = budget - sum(n * k for n, k in took.items())
    by_size = sorted(((n, c) for n, c in zip(lengths, counts, strict=True) if n), reverse=True)
    for n, c in by_size:
        if rest <= KNAPSACK:
            break
        k = min(c - took[n], (rest - KNAPSACK) // n)
        took[n], rest = took[n] + k, rest - n * k
    for n, c in reversed(by_size):  # documents too long for the step above
        if rest <= KNAPSACK:
            break
        k = min(c - took[n], rest // n, -(-(rest - KNAPSACK) // n))
        took[n], rest = took[n] + k, rest - n * k
    left = [(n, c - took[n]) for n, c in by_size if n <= rest and c > took[n]]
    for n, k in reachable([n for n, _ in left], [c for _, c in left], min(rest, KNAPSACK)).items():
        took[n] += k
    return took


def sizes(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """(doc_id, source, size): words of every text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            size = pa.array([word_count(x) for x in utf8(batch.column("t"))], pa.int64())
            yield pa.record_batch([batch.column("i"), batch.column("s"), size], ["doc_id", "source", "size"])

    out = docs.select(F.col(doc_id).alias("i"), F.col(source).alias("s"), F.col(text).alias("t"))
    return out.mapInArrow(make, f"doc_id {kinds[doc_id]}, source {kinds[source]}, size long")


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, sid, target): budgets by weight, at most `most` times the size, the excess reshared.

    Sources get their weights in order of code point, null last, from a distributed rank. Sharing raises one level
    until no further source reaches its limit; a round brings two sums to the driver."""
    ranked = stored(with_rank(totals, F.col("source").asc_nulls_last()).withColumnRenamed("rank", "sid"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    limit = F.col("source_size") * most
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = weight * level > limit if full >= 0 else F.lit(False)
        row = ranked.agg(F.sum(F.when(over, limit).otherwise(0.0)).alias("kept"), F.sum(F.when(over, 0.0).otherwise(weight)).alias("open"), F.count(F.when(over, 1)).alias("full")).first()
        if row.full == full or not row.open:
            break
        level, full = (total - row.kept) / row.open, row.full
    return ranked.withColumn("target", F.least(weight * level, limit))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 11, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each row of `docs`.

    `share` times all words are dealt to the sources by `weights`, repeated over the sources in order of code point; no
    target is above `most` times its source. A null source is a source of its own; a null or empty text has size 0 and
    takes no words; repeated rows are taken each; other columns of `docs` are not read; an empty table gives an empty
    one. The same rows and seed give the same mix."""
    sized = stored(sizes(docs, doc_id, source, text))
    aim = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(most)))
    named = aim.withColumnRenamed("source", "its_source")
    keyed = stored(sized.join(named, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source"))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        lengths, counts, left, layers = group["size"].tolist(), group["n"].tolist(), int(group.target.iloc[0]), []
        whole = int(group.source_size.iloc[0])
        for _ in range(most):
            took = dict(zip(lengths, counts, strict=True)) if left >= whole else fill(lengths, counts, left)
            layers.append([took.get(n, 0) for n in lengths])
            left -= sum(n * k for n, k in took.items())
        return pd.DataFrame({"p_sid": group.sid, "p_size": group["size"], "layers": list(zip(*layers, strict=True))})

    histogram = keyed.groupBy("sid", "size", "source_size", "target").agg(F.count("*").alias("n"))
    plans = histogram.groupBy("sid").applyInPandas(plan, "p_sid long, p_size long, layers array<long>")
    ranked = stored(with_rank(keyed, "sid", "size", F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    first = ranked.groupBy(F.col("sid").alias("f_sid"), F.col("size").alias("f_size")).agg(F.min("rank").alias("first"))
    chosen = plans.join(first, (F.col("p_sid") == F.col("f_sid")) & (F.col("p_size") == F.col("f_size")))
    out = ranked.join(chosen, (F.col("sid") == F.col("p_sid")) & (F.col("size") == F.col("p_size")))
    copies = F.size(F.filter("layers", lambda n: n > F.col("rank") - F.col("first"))).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
