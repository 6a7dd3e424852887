"""Secrets against plain regular expressions and windows counted one by one."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections import Counter
from math import log2

import pytest

from palisade.llm import secret_entropy
from palisade.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, spans string, kind string"
ANY = str.maketrans({c: f"[{c}{c.upper()}]" for c in string.ascii_lowercase})
ASSIGN = re.compile("(" + "|".join(w.translate(ANY) for w in ("password", "passwd", "secret", "token")) + "|" + "api".translate(ANY) + "_?" + "key".translate(ANY) + r""")["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def base(text: str) -> list[tuple]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_entropy.KNOWN.index(s[0])))


def entropy(window: str) -> float:
    return log2(len(window)) - sum(round(c * log2(c) * secret_entropy.UNIT) for c in Counter(window).values()) / len(window) / secret_entropy.UNIT


def brute(text: str) -> list[tuple]:
    known, found = base(text), []
    for of in secret_entropy.CLASSES:
        added = []
        for m in re.finditer(f"[{of.chars}]+", text):
            run = m.group()
            if len(run) < of.window or any(re.search(p, run) for p in secret_entropy.ALLOWED):
                continue
            covered = set()
            for k in range(len(run) - of.window + 1):
                if entropy(run[k : k + of.window]) >= of.bits:
                    covered |= set(range(m.start() + k, m.start() + k + of.window))
            for p in sorted(covered):
                if added and added[-1][2] == p and added[-1][1] >= m.start():
                    added[-1] = (of.kind, added[-1][1], p + 1)
                else:
                    added.append((of.kind, p, p + 1))
        added = [s for s in added if not any(a < s[2] and s[1] < b for _, a, b in known)]
        found += [s for s in added if not any(a <= s[1] and s[2] <= b for _, a, b in found)]
    order = [*secret_entropy.KNOWN, *(c.kind for c in secret_entropy.CLASSES)]
    return sorted(known + found, key=lambda s: (s[1], order.index(s[0])))


def texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    b64 = string.ascii_letters + string.digits + "+/"
    some = [
        lambda: pick("abcdefgh tion the ", 60), lambda: pick(b64, rng.randint(10, 90)), lambda: pick("0123456789abcdef", rng.randint(20, 70)), lambda: pick("0123456789ABCDEF", 40),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, rng.randint(0, 30)), lambda: f'Api_Key = "{pick(b64, rng.randint(4, 30))}"', lambda: "TOKEN:secret=" + pick("a=b", 9),
        lambda: "passwd='short' password==", lambda: "é ü ſecret: K 🙂", lambda: "a1" * 30 + pick(b64, 25) + "b" * 40, lambda: "123e4567-e89b-12d3-a456-426614174000",
        lambda: "some-long-identifier_with_words/and/path", lambda: "EXAMPLE" + pick(b64, 30), lambda: "01234567890123456789012345", lambda: base64.b64encode(rng.randbytes(60)).decode(),
    ]
    out = [None, "", " ", "\n", "a" * 70_000, pick(b64, 5000), "abc " * 20_000 + pick(b64, 40)]
    return out + [rng.choice([" ", "\n", "é", ",", ""]).join(rng.choice(some)() for _ in range(rng.randint(1, 12))) for _ in range(400)]


def test_against_brute_force(spark):
    made = texts(1)
    rows = [(k, t, "x", "y") for k, t in enumerate(made)] + [(None, made[9], "x", "y"), (3, made[10], None, None), (3, made[10], None, None)]
    got = secret_entropy.find_secrets(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = Counter((r[0], tuple(brute(r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.stop) for s in r.spans)) for r in got) == want
    kinds = Counter(s.kind for r in got for s in r.spans)
    assert min(kinds[k] for k in [*secret_entropy.KNOWN, *(c.kind for c in secret_entropy.CLASSES)]) > 0
    assert all(s.known == (s.kind in secret_entropy.KNOWN) for r in got for s in r.spans)
    assert secret_entropy.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_windows_by_incremental_counts(seed):
    rng = random.Random(seed)
    runs = ["".join(rng.choices("abcdefgh"[: rng.randint(1, 8)], k=rng.randint(1, 60))) for _ in range(50)]
    window = rng.randint(1, 12)
    want = [sum(int(secret_entropy.table(window)[c]) for c in Counter(r[max(0, k - window + 1) : k + 1]).values()) for r in runs for k in range(len(r))]
    assert secret_entropy.windows([r.encode() for r in runs], window).tolist() == want


def test_allow_list_is_a_parameter(spark):
    key = "q9ZkP2xW7vB4nT6yRmL8"
    docs = spark.createDataFrame([(1, f"see {key} there", None, None)], SCHEMA)
    assert len(secret_entropy.find_secrets(docs).first().spans) == 1
    assert secret_entropy.find_secrets(docs, allowed=[*secret_entropy.ALLOWED, "^q9Zk"]).first().spans == []


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op11_secret_entropy"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for r in rows:
        known = base(r.text or "")
        counts = Counter(k for k, _, _ in known)
        want = (r.doc_id, *(counts[k] for k in secret_entropy.KNOWN), hashlib.sha256(join(known).encode()).hexdigest(), join(brute(r.text or "")))
        assert tuple(got[r.doc_id]) == want
    assert len(got) == len(rows)
    assert sum(r.n_assign for r in got.values()) > 0
