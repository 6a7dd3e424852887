"""The trie of conversations against brute force, with rows so narrow that long conversations take several levels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from palisade.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, seq string, depth string, `end` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows) -> Counter:
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            symbol = hashlib.sha256(f"turn{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append((turn is not None, turn or 0, symbol, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        source = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = turns.get(source, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    )


def made(seed: int, longest: int = 9) -> list[tuple]:
    rng = random.Random(seed)
    says = ["", "a", "a b", "b  c\td", "é ü", "x" * 3000, None, "0", "word " * 40]
    rows = []
    for c in [*range(0, 260), -1, -19, -20, -25, 10**15, 2**62]:
        for t in range(rng.choice([1, 2, 3, rng.randint(1, longest)])):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t else "user", says[rng.randrange(2 + t % 7)], "n", "s", "d", "e"))
    same = [("user", "hello"), ("assistant", "a b c"), ("user", None)]
    rows += [(c, t, *turn, "n", "s", "d", "e") for c in range(1000, 3000) for t, turn in enumerate(same)]  # one common conversation
    rows += [rows[3]] * 4 + [(5, None, "user", "first", *"nsde"), (5, None, "user", "also first", *"nsde"), (None, 0, "user", "x", *"nsde"), (6, 1, None, None, *"nsde")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "longest"), [(64, 9), (4, 9), (2, 30)])
def test_against_brute_force(spark, width, longest):
    rows = made(width, longest)
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), width=width)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_long_conversation(spark):
    """Conversations of many blocks of blocks that part late, and one that is all but one turn of the table."""
    rows = [(c, t, "user", f"t {t % 5}" if t < 130 + c else f"own {c} {t}", *"nsde") for c in (0, 20, 40) for t in range(150)]
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), width=4)
    assert Counter(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x", *"nsde")], [(7, 0, "user", "x y", *"nsde")], [(0, 0, "user", "x y", *"nsde")]])
def test_small(spark, rows):
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_hash_of_many_ids(spark):
    """Ids of a node that fill many packs and partitions."""
    ids = spark.range(0, 30_000).selectExpr("id as seq", "case when id % 3 = 0 then 'a' else concat('b', cast(id % 2 as string)) end as `end`")
    want = defaultdict(list)
    for r in ids.collect():
        want[r.end].append(r.seq)
    assert dict(map(tuple, conversation_trie.end_hashes(ids).collect())) == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
