"""Exact k nearest binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, and each segment's value is an index. If two codes differ in fewer than
`segments * (r + 1)` bits, some segment differs in at most `r`. So in round `r` the queries that are left probe every
segment with all values at exactly `r` bits; after it, everything nearer than `segments * (r + 1)` has been seen, and
a query is done when its k-th verified distance is below that. A pair is taken in the one round and segment that meet
it first, so nothing is compared twice. Equal codes are one entry with their smallest ids, equal queries one search.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import Stored, shuffle_parts, stored

BITS = 64


def sign_code(vector: Column) -> Column:
    """The signs of the first 64 components, the first as the highest bit; null if the vector or one of them is."""
    first = F.slice(vector, 1, BITS)
    code = F.aggregate(first, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > 0).cast("long")))
    return F.when(~F.exists(first, lambda x: x.isNull() | F.isnan(x)), code)


def flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in some) for some in combinations(range(width), radius)]


def _segment(code: Column, n: int, width: int) -> Column:
    return F.shiftrightunsigned(code, n * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def nearest_codes(index: DataFrame, queries: DataFrame, k: int, segments: int = 4) -> DataFrame:
    """`index` (id, code), `queries` (code) to (code, id, distance): the `k` nearest by (distance, id) of each distinct
    query code, from all rows; fewer if there are fewer rows."""
    width = BITS // segments
    ids = F.array_sort(F.collect_list("id"))
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))  # cut to k for each code before it is grouped
    codes = index.filter("code is not null").withColumn("nth", nth).filter(F.col("nth") <= k)
    entries = stored(codes.groupBy("code").agg(ids.alias("ids")))
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("segment"), _segment(F.col("code"), n, width).alias("value")) for n in range(segments))))
    table = Stored(entries.select("code", "ids", parts.alias("part")).select("part.segment", "part.value", "code", "ids"))
    left = Stored(queries.filter("code is not null").select(F.col("code").alias("q")).distinct().withColumn("most", F.lit(BITS)))
    found, done = None, []
    for r in range(width + 1):
        if left.df.isEmpty():
            break
        dealt = left.df.repartition(shuffle_parts(left.df.sparkSession), "q")  # a query becomes thousands of probes
        probes = dealt.select("q", "most", F.explode(F.array(*(F.struct(F.lit(n).alias("s"), _segment(F.col("q"), n, width).alias("v")) for n in range(segments)))).alias("p"))
        probes = probes.select("q", "most", F.col("p.s").alias("s"), F.explode(F.transform(F.lit(flips(width, r)), lambda m: F.col("p.v").bitwiseXOR(m))).alias("v"))
        # the sizes of exploded probes are not known to the optimizer, which must not take them for small
        hits = probes.join(table.df.hint("shuffle_hash"), (F.col("s") == F.col("segment")) & (F.col("v") == F.col("value")))
        apart = [F.bit_count(_segment(F.col("q").bitwiseXOR(F.col("code")), n, width)) for n in range(segments)]
        first = F.lit(True)
        for n, d in enumerate(apart):
            first &= F.when(F.lit(n) < F.col("s"), d > r).when(F.lit(n) > F.col("s"), d >= r).otherwise(F.lit(True))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        new = hits.filter(first & (distance <= F.col("most"))).select("q", F.explode("ids").alias("id"), distance.alias("distance"))
        if found is not None:
            new = new.unionByName(found.df.join(left.df.select("q"), "q", "left_semi"))
        place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
        now = Stored(new.withColumn("place", place).filter(F.col("place") <= k).drop("place"))
        kth = now.df.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far")).filter(F.col("n") == k)
        covered = segments * (r + 1)
        state = Stored(left.df.select("q").join(kth, "q", "left").select("q", F.coalesce(F.col("far"), F.lit(BITS)).cast("int").alias("most")))
        ready = state.df.filter((F.col("most") < covered) | F.lit(r == width)).select("q")
        done.append(stored(now.df.join(ready, "q", "left_semi")))
        rest = Stored(state.df.filter((F.col("most") >= covered) & F.lit(r < width)))
        for old in filter(None, (left, found, state)):
            old.drop()
        left, found = rest, now
    out = done[0] if done else entries.select(F.col("code").alias("q"), F.explode("ids").alias("id"), F.lit(0).alias("distance")).limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("q", "code")


def search_codes(vectors: DataFrame, is_query: Column, k: int = 10, segments: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the `k` nearest other rows by the Hamming distance of sign codes, ties by
    id, for every row that `is_query` marks, against all rows.

    A null vector, or one with a null or NaN among its first 64 components, has no code: it is not found and finds
    nothing. A row is not its own neighbour; other rows with its id or its vector are. With fewer than `k` other
    rows there are fewer ranks; rows with a null id are found with a null one; an empty table gives an empty one."""
    # a row is told from others with its id by its row number
    rows = stored(vectors.select(F.col(vec_id).alias("id"), sign_code(F.col(embedding)).alias("code"), F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("row", F.monotonically_increasing_id()))
    asks = rows.filter("asks and code is not null").select("id", "code", "row")
    found = nearest_codes(rows.select(F.struct("id", "row").alias("id"), "code"), asks.select("code"), k + 1, segments)
    pairs = asks.withColumnRenamed("id", "vec_id").join(found.select(F.col("code").alias("c"), F.col("id.id").alias("neighbor_id"), F.col("id.row").alias("other"), "distance"), F.col("code") == F.col("c")).filter("row <> other")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "neighbor_id", "other"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "distance")
