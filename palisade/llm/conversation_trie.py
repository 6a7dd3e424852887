"""The prefix trie of conversations, built by van Emde Boas recursion.

A conversation is a sequence of turns, and a prefix of it is a node. Sequences of up to `h` turns are cut at half the
depth: the first halves make an upper trie, and the rests behind each cut prefix make a lower forest, which has the
prefix's name. Both have half the height, so one round cuts all upper tries and lower forests at once, and after
log2(h) rounds every piece is one turn: a node below the node that its forest is named after. Equal pieces of a forest
are merged in every round with the number of conversations that they stand for, so a beginning that many conversations
share is one row from its first cut on.

Totals are grafted upward in the same cuts: a node below a cut adds to the total of its forest, and a forest's total
is added to the nodes of the upper trie on the path to the cut. A node is behind at most log2(h) cuts, and the paths
of one cut are as long as the rows of its round, so both are one aggregation for all cuts together.

A row holds `WIDTH` turns at most. Of a longer conversation each full block of `WIDTH` turns is one symbol of a
shorter sequence, whose trie is built the same way; it names the blocks' forests and grafts their totals. So neither a
row nor a task has to hold a conversation.

Names are 128 bits of SHA-256 of what they stand for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import shuffle_parts, stored, with_rank

#: Turns in a row (a power of two), and characters of ids in a row.
WIDTH, CHUNK = 64, 4096
ROOT = "0" * 32
WORD = r"[^\x20\x09-\x0D]+"


def _hash(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(32))


def _symbols(arr: Column) -> Column:
    return F.transform(arr, lambda x: x["sym"])


def _prefix(forest: Column, symbols: Column) -> Column:
    return _hash(F.concat(forest, F.array_join(symbols, "")))


def _prefix_names(forest: Column, symbols: Column) -> Column:
    """Names of the prefixes of a piece: prefix i is cut off where its lowest set bit is half a height, so its name
    comes from the prefix without that bit and the symbols behind it."""

    def add(names: Column, i: Column) -> Column:
        low = i.bitwiseAND(-i)
        return F.concat(names, F.array(_prefix(F.get(names, i - low), F.slice(symbols, i - low + 1, low))))

    names = F.aggregate(F.sequence(F.lit(1), F.size(symbols)), F.array(forest).cast("array<string>"), add)
    return F.slice(names, F.lit(2), F.size(symbols))


@dataclass
class Trie:
    """`nodes`: name, parent, depth, words, n, least, roots (forests it is in, one for each cut above it). `paths`: end,
    forest, symbols from the forest to a cut. `above`: the trie over blocks, if some sequence has several."""

    nodes: DataFrame
    paths: DataFrame
    above: Trie | None

    def totals(self, valued: DataFrame) -> DataFrame:
        """(name, leaves, saved): sums over subtrees; `valued` has the nodes' own values (name, roots, leaves, saved)."""
        of = valued.select(F.explode("roots").alias("root"), "leaves", "saved").groupBy("root").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        if self.above is not None:
            of = stored(of)
            own = self.above.nodes.select("name", "roots").join(of, F.col("name") == F.col("root"), "left").fillna(0, ["leaves", "saved"])
            higher = self.above.totals(stored(own.select("name", "roots", "leaves", "saved"))).toDF("name", "more_leaves", "more_saved")
            of = of.join(higher, F.col("root") == F.col("name"), "left").select("root", F.coalesce("more_leaves", "leaves").alias("leaves"), F.coalesce("more_saved", "saved").alias("saved"))
        on_path = F.concat(F.slice(_prefix_names(F.col("forest"), F.col("symbols")), F.lit(1), F.size("symbols") - 1), F.array("end"))
        added = self.paths.join(of, F.col("end") == F.col("root")).select(F.explode(on_path).alias("added"), "leaves", "saved")
        added = added.groupBy("added").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        joined = valued.join(added, F.col("name") == F.col("added"), "left")
        return joined.select("name", *((F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")))


def _blocks(elements: DataFrame, width: int) -> DataFrame:
    """(seq, block, arr, total) of elements (seq, place, sym, words, total)."""
    items = F.array_sort(F.collect_list(F.struct("place", "sym", "words")))  # at most `width`
    rows = elements.groupBy("seq", F.floor(F.col("place") / width).alias("block")).agg(items.alias("items"), F.max("total").alias("total"))
    return rows.select("seq", "block", F.transform("items", lambda x: F.struct(x["sym"].alias("sym"), x["words"].alias("words"))).alias("arr"), "total")


def _named(blocks: DataFrame, width: int) -> tuple[DataFrame, Trie | None, int]:
    """The blocks with the name of their forest and, for full ones, of their end; the trie over blocks; the height."""
    most = blocks.agg(F.max("block").alias("block"), F.max(F.size("arr")).alias("size")).first()
    if not most.block:
        height = 1
        while height < (most.size or 1):
            height *= 2
        whole = F.when(F.size("arr") == height, _prefix(F.lit(ROOT), _symbols(F.col("arr"))))
        return blocks.withColumns({"forest": F.lit(ROOT), "end": whole}), None, height
    full = F.size("arr") == width
    symbol = _hash(F.concat(F.lit("block"), F.array_join(_symbols(F.col("arr")), "")))
    count = F.floor(F.col("total") / width)
    shorter = blocks.filter(full).select("seq", F.col("block").alias("place"), symbol.alias("sym"), F.lit(0).cast("long").alias("words"), count.alias("total"))
    larger, above = _grown(stored(_blocks(shorter, width)), width)
    names = F.concat(F.array("forest"), F.col("names"))
    edges = larger.select("seq", F.posexplode(F.arrays_zip(names.alias("start"), F.col("names").alias("stop"))).alias("k", "edge"), (F.col("block") * width).alias("first"))
    edges = edges.select(F.col("seq").alias("eseq"), (F.col("first") + F.col("k")).alias("eblock"), "edge.start", "edge.stop")
    edges = edges.groupBy("eseq", "eblock").agg(F.max("start").alias("start"), F.max("stop").alias("stop"))
    joined = blocks.join(edges, (F.col("seq") == F.col("eseq")) & (F.col("block") == F.col("eblock")), "left")
    named = joined.select("seq", "block", "arr", "total", F.coalesce("start", F.lit(ROOT)).alias("forest"), F.when(full, F.col("stop")).alias("end"))
    return named, above, width


def _grown(blocks: DataFrame, width: int) -> tuple[DataFrame, Trie]:
    """The blocks with `forest` and `names`, those of all their prefixes, and the trie of their sequences."""
    rows, above, height = _named(blocks, width)
    rows = stored(rows)
    plain = _prefix_names(F.col("forest"), _symbols(F.col("arr")))
    last = F.when(F.col("end").isNotNull(), F.array("end")).otherwise(F.slice(plain, -1, 1))
    named = rows.withColumn("names", F.concat(F.slice(plain, F.lit(1), F.size("arr") - 1), last))
    depth = F.col("block") * width
    now = _merged(rows.select("forest", "arr", F.lit(1).cast("long").alias("n"), F.col("seq").alias("least"), "end", depth.alias("depth"), F.array("forest").alias("roots")))
    paths = [] if above is None else [_paths(now.filter(F.size("arr") == width))]
    half = height // 2
    while half:
        now = _merged(_cut(now, half))
        paths.append(_paths(now.filter(F.col("end") == F.col("part"))))
        half //= 2
    node = F.coalesce("end", "part").alias("name")
    nodes = now.select(node, F.col("forest").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("arr")[0]["words"].alias("words"), "n", "least", "roots")
    return named, Trie(nodes, reduce(DataFrame.unionByName, paths or [_paths(now.limit(0))]), above)


def _paths(rows: DataFrame) -> DataFrame:
    return rows.select("end", "forest", _symbols(F.col("arr")).alias("symbols"))


def _merged(rows: DataFrame) -> DataFrame:
    """One row for equal pieces of a forest; `part` is the piece's name."""
    same = [F.first(c).alias(c) for c in ("forest", "arr", "depth", "roots")]
    keyed = rows.withColumn("part", _prefix(F.col("forest"), _symbols(F.col("arr"))))
    return stored(keyed.groupBy("part").agg(*same, F.sum("n").alias("n"), F.min("least").alias("least"), F.max("end").alias("end")))


def _cut(rows: DataFrame, half: int) -> DataFrame:
    """Pieces of at most twice `half` turns, cut there: an upper one that ends at the cut, a lower one behind it."""
    size, cut = F.size("arr"), _prefix(F.col("forest"), F.slice(_symbols(F.col("arr")), 1, half))

    def piece(forest: Column, arr: Column, end: Column, depth: Column, roots: Column) -> Column:
        return F.struct(forest.alias("forest"), arr.alias("arr"), end.alias("end"), depth.alias("depth"), roots.alias("roots"))

    cut_rows = rows.withColumn("cut", F.when(size >= half, cut))
    upper = piece(F.col("forest"), F.slice("arr", 1, half), F.col("cut"), F.col("depth"), F.col("roots"))
    lower = piece(F.col("cut"), F.slice("arr", F.lit(half + 1), F.greatest(size - half, F.lit(0))), F.col("end"), F.col("depth") + half, F.concat("roots", F.array("cut")))
    pieces = F.when(size > half, F.array(upper, lower)).otherwise(F.array(upper))
    return cut_rows.select("n", "least", F.explode(pieces).alias("piece")).select("piece.*", "n", "least")


def rebuilt_turns(conversations: DataFrame, group: int = 20, most_shared: int = 3, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (seq, place, sym, words, total) of the rebuilt conversations, and all of these (seq, total).

    Conversation c begins with the first h = crc32(c as text) % (most_shared + 1) turns of conversation c - c % group;
    then come its own turns after the first h. `sym` stands for role and text."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    symbol = _hash(F.concat(F.lit("turn"), F.length(whole(role)).cast("string"), F.lit(":"), whole(role), whole(text)))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("seq"), F.col(turn).alias("turn"), symbol.alias("sym"), F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("words")
    )
    # texts are read once; equal turns are dealt by row, so that a task gets no more of them than of others
    ranked = with_rank(stored(rows.withColumn("row", F.monotonically_increasing_id())), F.col("seq"), F.col("turn").asc_nulls_first(), F.col("sym"), F.col("row")).select("seq", "rank", "sym", "words")
    own = stored(ranked.groupBy("seq").agg(F.min("rank").alias("first"), F.count("*").alias("size")))
    shared = F.crc32(F.col("seq").cast("string").cast("binary")) % (most_shared + 1)
    heads = own.select(F.col("seq").alias("source"), F.col("size").alias("source_size"))
    kept = own.withColumns({"shared": shared, "of": F.col("seq") - F.col("seq") % group}).join(heads, F.col("of") == F.col("source"), "left")
    borrowed = F.least("shared", F.coalesce("source_size", F.lit(0)))
    kept = stored(kept.select("seq", "of", "first", "shared", borrowed.alias("borrowed"), (borrowed + F.greatest(F.col("size") - F.col("shared"), F.lit(0))).alias("total")))
    places = ranked.join(kept, "seq").withColumn("place", F.col("rank") - F.col("first"))
    after = places.filter("place >= shared").select("seq", (F.col("place") - F.col("shared") + F.col("borrowed")).alias("place"), "sym", "words", "total")
    sources = own.filter(F.col("seq") % group == 0).select(F.col("seq").alias("source"), "first")
    lent = ranked.filter(F.col("seq") % group == 0).join(sources, F.col("seq") == F.col("source")).select("source", (F.col("rank") - F.col("first")).alias("place"), "sym", "words").filter(F.col("place") < most_shared)
    # a source lends to the ids of its group only
    before = kept.filter("borrowed > 0").select("seq", "of", "borrowed", "total").join(lent, F.col("of") == F.col("source")).filter("place < borrowed")
    return after.unionByName(before.select("seq", "place", "sym", "words", "total")), kept.select("seq", "total")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(end, ends_sha256) of (end, seq): SHA-256 of the ids, ascending, joined by commas. Sorted ids are packed where they
    are; a hash has to read a node's ids in order, and does so pack by pack."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("end", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
        end, ids, length = None, [], 0
        for batch in batches:
            out = []
            for name, seq in zip(batch.column("end").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                if ids and (name != end or length >= CHUNK):
                    out.append({"end": end, "first": ids[0], "ids": ",".join(map(str, ids))})
                    ids, length = [], 0
                end = name
                ids.append(seq)
                length += len(str(seq)) + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if ids:
            yield pa.RecordBatch.from_pylist([{"end": end, "first": ids[0], "ids": ",".join(map(str, ids))}], schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("end", pa.string()), ("ends_sha256", pa.string())])
        end, state = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name != end:
                    if state is not None:
                        out.append({"end": end, "ends_sha256": state.hexdigest()})
                    end, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"end": end, "ends_sha256": state.hexdigest()}], schema)

    parts = shuffle_parts(ends.sparkSession)
    packed = ends.select("end", "seq").repartitionByRange(parts, "end", "seq").sortWithinPartitions("end", "seq").mapInArrow(pack, "end string, first long, ids string")
    return packed.repartition(parts, "end").sortWithinPartitions("end", "first").mapInArrow(digest, "end string, ends_sha256 string")


def conversation_trie(conversations: DataFrame, group: int = 20, most_shared: int = 3, width: int = WIDTH, **columns: str) -> DataFrame:
    """One row for each node of the trie over the rebuilt conversations (`rebuilt_turns`): conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows with a null conv_id are in no conversation. A null turn comes first; turns with one number come in the order
    of a hash of role and text, so repeated rows are repeated turns. A null role or text is an empty one. A conversation
    that is left without turns is a member of the root alone. An empty table has no node, not even the root; other
    columns are not read. `columns` renames conv_id, turn, role and text."""
    elements, convs = rebuilt_turns(conversations, group, most_shared, **columns)
    blocks, trie = _grown(stored(_blocks(elements, width)), width)
    last = blocks.filter(F.col("block") * width + F.size("arr") == F.col("total"))
    ends = last.select(F.element_at("names", -1).alias("end"), "seq").unionByName(convs.filter("total = 0").select(F.lit(ROOT).alias("end"), "seq"))
    root = convs.agg(F.count("*").alias("n"), F.min("seq").alias("least")).filter("n > 0")
    root = root.select(F.lit(ROOT).alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n", "least", F.array().cast("array<string>").alias("roots"))
    children = trie.nodes.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    nodes = trie.nodes.unionByName(root).join(children, F.col("name") == F.col("of"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("of")
    nodes = stored(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("words")}))
    below = trie.totals(nodes.filter(F.col("name") != ROOT).select("name", "roots", "leaves", "saved"))
    everything = nodes.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(F.lit(ROOT).alias("name"), "leaves", "saved")
    totals = below.unionByName(everything).toDF("total_of", "n_leaves", "saved_tokens")
    parents = nodes.select(F.col("name").alias("up"), F.col("least").alias("parent_conv_id"))
    out = nodes.join(totals, F.col("name") == F.col("total_of")).join(parents, F.col("parent") == F.col("up"), "left").join(end_hashes(ends), F.col("name") == F.col("end"), "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
