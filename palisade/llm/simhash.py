"""Near-duplicates by SimHash and BK-trees.

A fingerprint is the majority of the bits of its shingles' hashes. Fingerprints within `radius` bits of each other are
linked. All of them in one BK-tree would visit a large part of the tree for each query, because most pairs of random
fingerprints are about equally far; so the trees are shards: with `radius + 2` blocks of bits, two fingerprints within
the radius agree in at least two blocks, and each pair of blocks with its values is a shard. In a shard's tree, children
hang on the Hamming distance to their parent, and a search follows only edges within the radius. A shard is never
larger than its distinct fingerprints, and gives at most a link for each of them (a spanning forest).

The trees are built where the shard's rows are, not broadcast: they grow with the corpus.

`dedup_similar` is for texts that share most of their shingles, which lie more bits apart than such a radius, and
shards of SimHash bits miss some of them at any length. Its shards are bands of MinHashes: two texts agree in one
MinHash with a chance equal to the Jaccard similarity J of their sets of shingles, in a band of r with J^r, and share no
band of b with (1 - J^r)^b, whatever their length. The members of a shard are compared by the shingles themselves; only
what a comparison has linked is one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import ASCII_LOWER, Stored, mixed, shuffle_parts, slices, stored, utf8
from palisade.llm.components import components
from palisade.llm.words import BASE, Layout, rolling

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles, repeats included; no words: 0."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    at, ends = 0, [0]
    for word in words:
        at += len(word) + 1
        ends.append(at)
    width = min(shingle, len(words))
    hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(ends, ends[width:], strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, bits): bits as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            made = np.array([fingerprint(x, shingle) for x in utf8(batch.column("t"))], np.uint64)
            yield pa.record_batch([batch.column("i"), pa.array(made.view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(make, f"doc_id {kind}, bits long")


class BKTree:
    """Fingerprints under the Hamming distance, and the sets that links within the radius make of them."""

    def __init__(self, radius: int) -> None:
        self.radius, self.nodes, self.edges, self.parent = radius, [], [], []

    def near(self, value: int) -> list[int]:
        found, todo, radius = [], [0] if self.nodes else [], self.radius
        while todo:
            n = todo.pop()
            d = (value ^ self.nodes[n]).bit_count()
            if d <= radius:
                found.append(n)
            edges = self.edges[n]
            if len(edges) > 2 * radius:
                todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
            else:
                todo += [child for e, child in edges.items() if -radius <= e - d <= radius]
        return found

    def insert(self, value: int) -> int:
        new = len(self.nodes)
        n = 0 if self.nodes else new
        while n != new:
            d = (value ^ self.nodes[n]).bit_count()
            n = self.edges[n].setdefault(d, new)
        self.nodes.append(value)
        self.edges.append({})
        self.parent.append(new)
        return new

    def root(self, n: int) -> int:
        while self.parent[n] != n:
            self.parent[n] = self.parent[self.parent[n]]
            n = self.parent[n]
        return n

    def join(self, value: int) -> list[int]:
        """Inserts a fingerprint; the nearest linked node of each set that it joins."""
        found, out = sorted(self.near(value), key=lambda n: (value ^ self.nodes[n]).bit_count()), []
        new = self.insert(value)
        for n in found:
            top = self.root(n)
            if top != self.root(new):
                self.parent[top] = new
                out.append(n)
        return out

    def add(self, value: int) -> list[int]:
        """Inserts a fingerprint; one linked fingerprint of each set that it joins."""
        return [self.nodes[n] for n in self.join(value)]


def block_masks(blocks: int) -> list[int]:
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << b - a) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(bits: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that connect all distinct values of `bits` which differ in at most `radius` bits."""
    pairs = list(combinations(block_masks(radius + 2), 2))
    shards = F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.col("bits").bitwiseAND(F.lit(_signed(a | b))).alias("part")) for k, (a, b) in enumerate(pairs))))
    dealt = bits.select("bits", shards.alias("shard")).select("bits", "shard.pair", "shard.part")
    dealt = dealt.repartition(shuffle_parts(bits.sparkSession), "pair", "part").sortWithinPartitions("pair", "part", "bits")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, BKTree(radius)
        for batch in batches:
            a, b = [], []
            columns = (batch.column(n).to_pylist() for n in ("bits", "pair", "part"))
            for value, pair, part in zip(*columns, strict=True):
                if (pair, part) != shard:
                    shard, tree = (pair, part), BKTree(radius)
                value &= (1 << 64) - 1
                for other in tree.add(value):
                    a.append(_signed(value))
                    b.append(_signed(other))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(make, "a long, b long")


def dedup_simhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest id reachable by links.

    Texts without words (null, empty, blank) have fingerprint 0, which is linked like any other; fewer words than a
    shingle are one shingle; repeated rows share a fingerprint and so a component; a null id stays null and is never
    the smallest (a component of null ids only has a null one); other columns of `docs` are not read; an empty table
    gives an empty one."""
    made = stored(fingerprints(docs, doc_id, text, shingle))
    classes = stored(made.groupBy("bits").agg(F.min("doc_id").alias("least")))
    linked = stored(components(fingerprint_links(classes.select("bits"), radius)))
    of = classes.join(linked, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    smallest = of.groupBy(F.col("component").alias("whole")).agg(F.min("least").alias("component_id"))
    named = of.join(smallest, F.col("component") == F.col("whole")).select(F.col("bits").alias("its_bits"), "component_id")
    out = made.join(named, F.col("bits") == F.col("its_bits"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text with A-Z lowered; fewer words are one shingle."""
    hashes = Layout([text.translate(ASCII_LOWER)]).hashes
    return np.unique(rolling(hashes, min(width, len(hashes)))) if len(hashes) else hashes


@lru_cache(maxsize=4)
def _factors(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def band_keys(shingles: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One key for each band of `width` MinHashes of a set; none for an empty set."""
    if not len(shingles):
        return shingles
    factors = _factors(bands * width)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for part in range(0, len(shingles), 1024):
        np.minimum(least, (factors[:, None] * shingles[part : part + 1024]).min(1), out=least)
    sums = (mixed(least).reshape(bands, width) * _factors(width)).sum(1, dtype=np.uint64)
    return mixed(sums + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(BASE))


def _verified(candidates: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The candidates whose texts have that Jaccard similarity of their shingles; `texts` are (id, t)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "ta"):
                sets = ([shingle_set(x, width) for x in utf8(part.column(c))] for c in ("ta", "tb"))
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and both >= similarity * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return candidates.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(make, "a long, b long").distinct()


def _cell(width: int, similarity: float):
    """Links from the left texts of a cell to the right ones: one for each two components that have any."""

    def work(table: pa.Table) -> pa.Table:
        left = table["left"].to_numpy()
        ids, whole = table["id"].to_numpy(), table["whole"].to_numpy()
        sets = [shingle_set(x, width) for x in utf8(table["t"].combine_chunks())]
        right = np.flatnonzero(~left)
        sizes = np.array([len(sets[r]) for r in right], np.int64)
        keys, owner = np.concatenate([sets[r] for r in right]), np.repeat(np.arange(len(right)), sizes)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        parent = {int(w): int(w) for w in whole}

        def root(w: int) -> int:
            while parent[w] != w:
                parent[w] = w = parent[parent[w]]
            return w

        a, b = [], []
        for n in np.flatnonzero(left):
            first, last = (np.searchsorted(keys, sets[n], side) for side in ("left", "right"))
            runs = last - first
            at = np.repeat(first - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            both = np.bincount(owner[at], minlength=len(right))
            hit = (both > 0) & (both >= similarity * (len(sets[n]) + sizes - both)) & (whole[right] != whole[n])
            for r in right[hit]:
                x, y = root(int(whole[n])), root(int(whole[r]))
                if x != y:
                    parent[x] = y
                    a.append(ids[n])
                    b.append(ids[r])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def _links_of_the_rest(live: DataFrame, open_shards: DataFrame, texts: DataFrame, width: int, similarity: float, most: int, most_bytes: int) -> DataFrame:
    """(a, b): links between different components of a shard; `live` are (shard, id, whole), `open_shards` are (s). The
    members outside the largest component of a shard (left) meet all members (right), in cells of about `most` texts a
    side."""
    rows = live.join(texts.select(F.col("id").alias("ti"), F.octet_length("t").alias("bytes")), F.col("id") == F.col("ti")).drop("ti")

    def blocks(n, size):
        return F.ceil(F.greatest(n / most, size / most_bytes, F.lit(1.0)))

    parts = rows.groupBy(F.col("shard").alias("of"), "whole").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    totals = parts.groupBy("of").agg(F.max(F.struct("n", "whole", "size")).alias("major"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    totals = totals.join(open_shards, F.col("of") == F.col("s")).filter("n > major.n")
    cells = totals.select("s", "major.whole", blocks(F.col("n") - F.col("major.n"), F.col("size") - F.col("major.size")).alias("ni"), blocks(F.col("n"), F.col("size")).alias("nj"))
    cells = cells.withColumnRenamed("whole", "major")
    rows = rows.drop("bytes").join(cells, F.col("shard") == F.col("s")).withColumn("minor", F.col("whole") != F.col("major")).withColumn("h", F.xxhash64("id"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = rows.filter("minor").select("shard", "id", "whole", F.lit(True).alias("left"), F.pmod("h", "ni").alias("i"), every("nj").alias("j"))
    right = rows.select("shard", "id", "whole", F.lit(False).alias("left"), every("ni").alias("i"), F.pmod("h", "nj").alias("j"))
    dealt = left.unionByName(right).join(texts.toDF("ti", "t"), F.col("id") == F.col("ti")).drop("ti")
    return dealt.groupBy("shard", "i", "j").applyInArrow(_cell(width, similarity), "a long, b long").distinct()


def linked_in_shards(shards: DataFrame, texts: DataFrame, width: int, similarity: float, rounds: int = 3, most: int = 256, most_bytes: int = 8 << 20) -> DataFrame:
    """(node, component) of all pairs of texts that share a shard and have that similarity: every such pair is either
    compared or joined by other compared pairs. `shards` are distinct (shard, id), `texts` are (id, t); texts with
    one id are copies.

    In a round the next hub of each shard, by the company that members have in all their shards, is compared with the
    members that are not joined to it yet; earlier hubs have met it. That settles the copies of one text. What is left
    after the rounds is compared whole. Shards with the same members are one. Only members that differ from the hub, and
    in the end the members of shards that are still open, are rows of a join by shard; the others are counted."""
    n, x, y = F.count("*"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.lit(1), "id"))
    kept = shards.groupBy("shard").agg(n.alias("n"), x.alias("x"), y.alias("y")).filter("n > 1").groupBy("n", "x", "y").agg(F.min("shard").alias("s"))
    own = stored(shards.join(kept.select("s", "n"), F.col("shard") == F.col("s")).groupBy("id").agg(F.collect_list(F.struct("shard", "n")).alias("shards"), F.sum("n").alias("company")))
    if own.isEmpty():
        return components(texts.sparkSession.createDataFrame([], "a long, b long"))
    texts = stored(texts.join(own.select(F.col("id").alias("wanted")), F.col("id") == F.col("wanted"), "left_semi").groupBy("id").agg(F.min("t").alias("t")))
    members = own.select("id", "company", F.inline("shards"))
    place = F.row_number().over(W.partitionBy("shard").orderBy(F.desc("company"), F.desc("id")))
    ranked = members.withColumn("place", place).filter(F.col("place") <= max(rounds, 1))
    hubs = stored(ranked.groupBy(F.col("shard").alias("s")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "id")))["id"].alias("hubs")))
    links = texts.sparkSession.createDataFrame([], "a long, b long")
    linked = links.toDF("node", "component")

    def with_whole(rows: DataFrame, of: str, name: str) -> DataFrame:
        """The rows with the component of a text, which is itself if nothing is linked to it."""
        return rows.join(linked, F.col(of) == F.col("node"), "left").withColumn(name, F.coalesce("component", of)).drop("node", "component")

    def live() -> DataFrame:
        # an id meets its component once, not in each of its shards (at most one for each band)
        return with_whole(own, "id", "whole").select(F.explode("shards.shard").alias("shard"), "id", "whole")

    def different(rows: DataFrame) -> DataFrame:
        return with_whole(with_whole(rows, "id", "whole"), "hub", "hub_whole").filter("whole <> hub_whole")

    open_shards = hubs.select("s", "n")
    for turn in range(rounds):
        hub = with_whole(hubs.filter(F.size("hubs") > turn).select("s", F.col("hubs")[turn].alias("hub"), F.slice("hubs", 1, turn).alias("met")), "hub", "hub_whole")
        new = (F.col("whole") != F.col("hub_whole")) & ~F.array_contains("met", F.col("id"))
        met = Stored(live().join(hub, (F.col("shard") == F.col("s")) & new).select("shard", "id", "hub"))
        candidates = met.df.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
        links = links.unionByName(stored(_verified(candidates, texts, width, similarity)))
        linked = stored(components(links))
        # of n members the first hubs have met all others: a pair that is left takes two more
        left = different(met.df).select(F.col("shard").alias("s")).distinct()
        open_shards = stored(left.join(hubs.select("s", "n"), "s").filter(F.col("n") > turn + 2))
        met.drop()
        if open_shards.isEmpty():
            return linked
        hubs = hubs.join(open_shards.select("s"), "s", "left_semi")
    found = _links_of_the_rest(live(), open_shards.select("s"), texts, width, similarity, most, most_bytes)
    return components(links.unionByName(stored(found)))


def dedup_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 44, width: int = 7) -> DataFrame:
    """(doc_id, component_id) for every row: the smallest id reachable by links. `doc_id` is an integer.

    Texts with the same set of shingles (of `shingle` words, A-Z lowered; by 64 bits of hash) are copies, so texts
    without words (null, empty, blank) are copies of each other. Others are linked if they share one of `bands` bands of
    `width` MinHashes and their sets have a Jaccard similarity of at least `similarity`; nothing below it is linked. A
    pair at exactly 0.8 shares no band with a chance of 3.2e-5 ((1 - 0.8^7)^44), one above it with a smaller one. Every
    row counts by its text, also if it repeats an id; a null id stays null and is never the smallest (a component of
    null ids only has a null one); other columns of `docs` are not read; an empty table gives an empty one."""
    kind = docs.schema[doc_id].dataType.simpleString()
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "t"):
                sets = [shingle_set(x, shingle) for x in utf8(part.column("t"))]
                copies = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                keys = pa.array([band_keys(x, bands, width).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.record_batch([part.column("id"), part.column("t"), pa.array(copies), keys], ["id", "t", "copies", "keys"])

    made = stored(plain.mapInArrow(make, "id long, t string, copies long, keys array<long>"))
    classes = stored(made.groupBy("copies").agg(F.min("id").alias("least"), F.min("keys").alias("keys")))
    shards = classes.select(F.explode("keys").alias("shard"), F.col("copies").alias("id"))
    linked = stored(linked_in_shards(shards, made.select(F.col("copies").alias("id"), "t"), shingle, similarity))
    whole = classes.join(linked, F.col("copies") == F.col("node"), "left").select("copies", "least", F.coalesce("component", "copies").alias("whole"))
    smallest = whole.groupBy(F.col("whole").alias("w")).agg(F.min("least").alias("component_id"))
    named = whole.join(smallest, F.col("whole") == F.col("w")).select(F.col("copies").alias("c"), "component_id")
    out = made.join(named, F.col("copies") == F.col("c"))
    return out.select(F.col("id").cast(kind).alias("doc_id"), F.col("component_id").cast(kind).alias("component_id"))
