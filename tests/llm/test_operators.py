"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, no rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product
from math import log, log10

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm import embedding_forest, hamming_search, lattice_lm, mixing, packing, simhash, substring, token_counts, toxicity, warc
from palisade.llm.components import components
from palisade.llm.words import Layout

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, source string, score string, size string, text_n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int = 1) -> list[str | None]:
    """Texts with copies, near copies, shared passages and odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeén", k=rng.randint(1, 6))) for _ in range(400)]

    def prose(n: int) -> str:
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\n", "\t", ". "]) for _ in range(n))

    passage = prose(70)
    out: list[str | None] = [None, "", " ", "\n\n", "a", "a b", "x" * 5000, "a " * 3000, "Ünï▁cödé <s> </s> <|endoftext|> 🙂 ok", " lead", "trail  ", " odd space\x0b"]
    out += [prose(rng.randint(1, 160)) for _ in range(40)]
    out += [prose(20) + passage + prose(15) for _ in range(6)] + [passage, passage]
    base = prose(300)
    out += [base] * 5 + [base.replace(vocabulary[k], "zz", 1) for k in range(8)]
    return out


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    made = texts()
    random.Random(3).shuffle(made)
    sources = [None, "a", "b", "é", "Z"]
    out = [(7 * k + 3, t, sources[min(k % 7, 4)], "x", "y", 1) for k, t in enumerate(made)]
    return out + [out[20], out[20], (None, made[21], "a", None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def bag(found) -> Counter:
    return Counter(map(tuple, found))


def test_tokens(docs, rows, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = bag((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 100) for r in rows)
    assert bag(token_counts.count_tokens(docs, MODEL, limit=100).collect()) == want
    assert token_counts.count_tokens(nothing, MODEL).count() == 0


def test_whole_words_are_proven():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words = token_counts.proven(MODEL)
    assert len(words) > 5000 and all(len(model.encode(w)) == 1 for w in list(words)[:500])


def test_packing(docs, rows, nothing):
    tokenizer, capacity = Tokenizer.from_file(BPE), 64
    found = packing.pack_sequences(docs, BPE, 2, capacity).collect()
    ids = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    want = Counter()
    for doc, x in ids:
        cuts = [0, *range(len(x) % capacity or capacity, len(x), capacity), len(x)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(doc, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))] += 1
    assert bag(r[:5] for r in found) == want
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(x) for _, x in ids)
    assert len(held) <= -(-total // capacity) * 1.03 + 1
    assert packing.pack_sequences(nothing, BPE, 2).count() == 0


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(20):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 200))]
        gaps: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(50 - n)
        plan = packing.best_fit(dict(Counter(lengths)), 50)
        used = set()
        ranked = sorted(lengths)
        for (rank, sequence, _), after in zip(plan, [*plan[1:, 0], len(ranked)]):
            used |= set(range(sequence, sequence + after - rank))
        assert len(used) == len(gaps)


def brute_substring(rows, window):
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    first: dict = {}
    for doc, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if doc is None else doc)
    for doc, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (float("inf") if doc is None else doc):
                gone |= set(range(s, s + window))
        yield doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize(("window", "chunk"), [(50, 8 << 20), (50, 3000), (7, 2000), (2, 4000)])
def test_substring(docs, rows, nothing, window, chunk):
    found = substring.dedup_substrings(docs, window=window, chunk_bytes=chunk, bucket_words=500)
    want = bag(brute_substring(rows, window))
    assert any(n for _, _, n, _ in want)
    assert bag(found.collect()) == want
    assert substring.dedup_substrings(nothing).count() == 0


def test_word_hashes():
    made = [(t or "").encode() for t in texts(9)]
    layout = Layout(made)
    words = [w for t in made for w in t.split()]
    assert [len(t.split()) for t in made] == list(layout.last - layout.first)
    by_hash = defaultdict(set)
    for w, h in zip(words, layout.hashes.tolist()):
        by_hash[h].add(w)
    assert len(words) == len(layout.hashes) and len(by_hash) == len(set(words))


def reach(links: dict) -> dict:
    out = {}
    for start in sorted(links):
        if start not in out:
            todo = [start]
            while todo:
                n = todo.pop()
                if n not in out:
                    out[n] = start
                    todo += links[n]
    return out


def brute_simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash(docs, rows, nothing):
    prints = [(r[0], brute_simhash(r[1])) for r in rows]
    distinct = sorted({p for _, p in prints})
    part = reach({a: [b for b in distinct if (a ^ b).bit_count() <= 3] for a in distinct})
    least: dict = {}
    for doc, p in prints:
        if doc is not None:
            least[part[p]] = min(least.get(part[p], doc), doc)
    want = bag((doc, f"{p:016x}", least.get(part[p])) for doc, p in prints)
    assert bag(simhash.dedup_simhash(docs).collect()) == want
    assert simhash.dedup_simhash(nothing).count() == 0


def test_fingerprint_links_reach_all_pairs(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1, 1 << 63}
    for v in list(values):
        for _ in range(5):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in values}
    table = spark.createDataFrame([(x,) for x in signed], "bits long")
    found = components(simhash.fingerprint_links(table)).collect()
    part = reach({a: [b for b in values if (a ^ b).bit_count() <= 3] for a in values})
    groups = defaultdict(set)
    for x, whole in part.items():
        groups[whole].add(x)
    mine = defaultdict(set)
    for r in found:
        mine[r.component].add(signed[r.node])
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(g) for g in mine.values()}


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(50)}


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = sum(w for s, w in weight.items() if s not in full)
        if not open_:
            return {s: most * sizes[s] for s in names}
        level = left / open_
        over = {s for s in names if s not in full and weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_mixing(docs, rows, nothing):
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    found = mixing.mix_sources(docs).collect()
    assert bag((r.doc_id, r.source, r["size"], r.source_size) for r in found) == bag((r[0], r[2], len(WORD.findall(r[1] or "")), sizes[r[2]]) for r in rows)
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s, target in want.items():
        sums = {0}
        for r in rows:
            if r[2] == s:
                sums = {x + k * len(WORD.findall(r[1] or "")) for x in sums for k in range(3)}
        assert max(x for x in sums if x <= target) - 10 <= taken[s] <= target
    assert bag(found) == bag(mixing.mix_sources(docs.repartition(7)).collect())
    assert mixing.mix_sources(nothing).count() == 0


def test_fill_reaches_the_best_sum():
    rng = random.Random(4)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), 5)
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        took = mixing.reachable(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert sum(n * k for n, k in took.items()) == max(s for s in sums if s <= budget)
        assert all(k <= dict(zip(lengths, counts))[n] for n, k in took.items())
        both = mixing.fill(lengths, counts, budget)
        assert sum(n * k for n, k in both.items()) <= budget and all(k <= dict(zip(lengths, counts))[n] for n, k in both.items())


def brute_lm(rows, train, n_anchors):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or "") for r in rows]
    words = [WORD.findall(w) for w in words]
    counts = Counter(w for r, ws in zip(rows, words) if train(r) for w in ws)
    ends = sum(map(train, rows))
    n, v = sum(counts.values()) + ends, len(counts) + bool(ends)
    base = lambda c: log10((c + 0.5) / (n + 0.5 * (v + 1)))
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = {model.id_to_piece(i): i for i in range(3, model.get_piece_size()) if not model.is_byte(i)}
    anchors = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:n_anchors]

    def kind_of(ws):
        most = max((ws.count(a) for a in anchors), default=0)
        return next(a for a in anchors if ws.count(a) == most) if most else None

    kinds = [kind_of(ws) for ws in words]
    by_kind, ends_of = {k: Counter() for k in [None, *anchors]}, Counter(k for r, k in zip(rows, kinds) if train(r))
    for r, ws, k in zip(rows, words, kinds):
        if train(r):
            by_kind[k].update(ws)

    def of_types(types):
        made = np.zeros(model.get_piece_size())
        for w in types:
            for i in model.encode(w):
                made[i] += 1
        return made

    whole = of_types(counts) + 0.5
    logs = {}
    for k, c in by_kind.items():
        each = of_types(c) + 300 * whole / whole.sum()
        logs[k] = np.log(each / each.sum())

    @lru_cache(None)
    def word(w, k):
        s, alpha = "▁" + w, [0.0]
        for j in range(1, len(s) + 1):
            arcs = [alpha[i] + logs[k][pieces[s[i:j]]] for i in range(j) if s[i:j] in pieces]
            if s[j - 1] not in pieces:
                arcs.append(alpha[j - 1] + sum(logs[k][model.piece_to_id(f"<0x{b:02X}>")] for b in s[j - 1].encode()))
            alpha.append(np.logaddexp.reduce(arcs))
        out = alpha[-1]
        for c in (counts, by_kind[k]):
            total = sum(c.values())
            if total:
                rest = log(0.75 * len(c) / total) + out
                out = np.logaddexp(log((c[w] - 0.75) / total), rest) if c[w] else rest
        return out

    for r, ws, k in zip(rows, words, kinds):
        stop = (ends_of[k] + (ends + 0.5) / (n + 1)) / (sum(by_kind[k].values()) + ends_of[k] + 1)
        score = log((ends_of[k] + 0.5) / (ends + 0.5 * len(by_kind))) + sum(word(w, k) for w in ws) + len(ws) * log(1 - stop) + log(stop)
        yield r[0], len(ws) + 1, sum(counts[w] > 0 for w in ws) + bool(ends), n, sum(base(counts[w]) for w in ws) + base(ends), score / log(10)


@pytest.mark.parametrize("chunk, anchors", [(8 << 20, 32), (3000, 3), (3000, 0)])
def test_lattice(docs, rows, nothing, chunk, anchors):
    rows = [r for r in rows if len(r[1] or "") < 2000]
    docs = docs.filter("length(coalesce(text, '')) < 2000")
    train = F.col("doc_id") % 3 != 1
    found = lattice_lm.score_documents(docs, MODEL, train, anchors=anchors, chunk_bytes=chunk, bucket_words=300).collect()
    want = sorted(brute_lm(rows, lambda r: r[0] is not None and r[0] % 3 != 1, anchors), key=str)
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=str)
    assert [x[:4] for x in mine] == [x[:4] for x in want]
    for a, b in zip(mine, want):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert lattice_lm.score_documents(nothing, MODEL, train).count() == 0


def test_lattice_of_long_words_and_side_by_side_agree():
    rng = np.random.default_rng(1)
    lattice = lattice_lm.Lattice(MODEL, np.log(rng.dirichlet(np.ones(32000), 2)))
    words = ["the", "therefore", "ünïcödé", "🙂🙂", "x" * 40, "▁▁", "a", "<s>", "0x3f"]
    kinds = np.arange(len(words)) % 2
    assert lattice.score(words, kinds) == pytest.approx([lattice.one(w, k) for w, k in zip(words, kinds)], rel=1e-12)


def test_words_of_a_class_share_one_probability():
    """With one-letter strings alone, all words over two letters up to a length, and the rest, make one."""
    size = sentencepiece.SentencePieceProcessor(model_file=MODEL).get_piece_size()
    strings = lattice_lm._strings(MODEL)[0]
    weights = np.full((1, size), -np.inf)
    for piece in ("▁", "a", "b"):
        weights[0, strings.index(piece)] = log(1 / 3)
    model = lattice_lm.Learned(weights, np.array([6, 6]), np.array([2, 2]), np.array([1, 1]))
    words = ["".join(x) for n in range(1, 9) for x in product("ab", repeat=n)]
    counts = np.array([{"a": 4, "ab": 2}.get(w, 0) for w in words])
    found = np.exp(lattice_lm.word_scores(model, MODEL, [b"@" + w.encode() for w in words], counts, counts, 0.75))
    left = (1 / 3 + (2 / 3) ** 9) * (0.75 * 2 / 6) ** 2  # the empty word, and words of nine letters or more
    assert found.sum() == pytest.approx(1 - left, rel=1e-9)


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, tmp_path, least):
    html = ["<p>same</p>", "", None, "x\r\n\r\ny", "é" * 3000, "abc", "<p>same</p>", "", "abc", "<p>same</p>"]
    pages = [(k, f"http://a/{k}\n", h, "clash") for k, h in enumerate(html * 30)] + [(None, None, "<p>same</p>", None), (None, "u", "lone", None), (299, "again", "<p>same</p>", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/{least}"
    manifest = warc.write_warc(df.repartition(3), folder, least, archive_bytes=20_000)
    found = warc.read_warc(spark, folder, manifest).collect()
    top: dict = {}
    for p in pages:
        if p[0] is not None:
            top[p[2] or ""] = max(top.get(p[2] or "", -1), p[0])
    want = Counter()
    for i, _, h, _ in pages:
        data = (h or "").encode()
        same = len(data) < least or (h or "") not in top or top[h or ""] == i
        want[(i, len(data), warc.base32_digest(data), "response" if same else "revisit", None if same else top[h or ""])] += 1
    assert bag((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    assert bag(bytes(r.payload) for r in found if r.record_type == "response") == bag_of(pages, want)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(pages)
    empty = df.limit(0)
    assert warc.read_warc(spark, folder + "-none", warc.write_warc(empty, folder + "-none")).count() == 0


def bag_of(pages, want) -> Counter:
    by_digest = {warc.base32_digest((h or "").encode()): (h or "").encode() for _, _, h, _ in pages}
    out = Counter()
    for (_, _, digest, kind, _), n in want.items():
        if kind == "response":
            out[tuple(by_digest[digest])] += n
    return out


def test_archive_has_its_dictionary_in_front():
    archive = warc.Archive(3)
    for k in range(200):
        payload = f"<html><p>{k}</p>{'word ' * 300}</html>".encode()
        archive.add(warc.record(k, "u", payload, warc.base32_digest(payload), None, False))
    data = archive.bytes()
    assert data[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(data[8:12], "little") == warc.DICTIONARY
    assert len(list(warc.read_archive(data))) == 200
    broken = warc.Archive(3)
    broken.add(warc.record(1, "u", b"abc", warc.base32_digest(b"abd"), None, False))
    with pytest.raises(ValueError):
        list(warc.read_archive(broken.bytes()))


def vectors(seed: int = 1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(120):
        base = rng.standard_normal(8)
        for _ in range(int(rng.integers(1, 6))):
            out.append((base + rng.normal(0, 0.07, 8), k % 3))
    out += [(out[0][0], 0)] * 30 + [(out[0][0] * 2, 0), (out[0][0], None)]
    rows = [(i, [float(x) for x in v], None if g is None else int(g), "x") for i, (v, g) in enumerate(out)]
    n = len(rows)
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]
    rows += [(n + k, v, 0, None) for k, v in enumerate(odd)]
    return rows + [rows[3], (None, rows[4][1], rows[4][2], None), (None, None, None, None)]


VEC = "vec_id long, embedding array<double>, label int, node string"


def brute_embeddings(rows):
    good = []
    for k, (_, v, g, _) in enumerate(rows):
        if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((k, np.array(v) / np.linalg.norm(v), g))
    links = {k: [] for k in range(len(rows))}
    for a, va, ga in good:
        for b, vb, gb in good:
            if a != b and ga == gb and len(va) == len(vb) and va @ vb >= 0.98:
                links[a].append(b)
    part = reach(links)
    least: dict = {}
    for k, p in part.items():
        if rows[k][0] is not None:
            least[p] = min(least.get(p, rows[k][0]), rows[k][0])
    for k, r in enumerate(rows):
        whole = least.get(part[k])
        yield r[0], len(links[k]), whole, r[0] is not None and r[0] == whole


def test_embeddings_in_one_leaf(spark):
    rows = vectors()
    found = embedding_forest.dedup_embeddings(spark.createDataFrame(rows, VEC)).collect()
    assert bag(found) == bag(brute_embeddings(rows))
    assert embedding_forest.dedup_embeddings(spark.createDataFrame([], VEC)).count() == 0


def test_embeddings_in_many_leaves(spark):
    """Small leaves: nothing but true links, and nearly all of them."""
    rows = [r for r in vectors(4) if r[0] is not None]
    found = {r.vec_id: r for r in embedding_forest.dedup_embeddings(spark.createDataFrame(rows, VEC), leaf=24, trees=10).collect()}
    want = {r[0]: r for r in brute_embeddings(rows)}
    assert all(found[k].n_links <= want[k][1] for k in want)
    assert sum(r.n_links for r in found.values()) >= 0.9 * sum(r[1] for r in want.values())


def test_embeddings_that_no_split_parts(spark):
    """Distinct vectors with equal projections in all but scale of noise: leaves stay large and go in blocks."""
    rng = np.random.default_rng(0)
    rows = [(k, [1.0, *(1e-9 * rng.standard_normal(7)).tolist()], 1, "") for k in range(150)]
    found = embedding_forest.dedup_embeddings(spark.createDataFrame(rows, VEC), leaf=20, trees=2, spill=0.5).collect()
    assert all(r.n_links == 149 and r.component_id == 0 for r in found)


def test_hamming_search(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 64))
    rows = [(i, [float(x) for x in v], None, "x") for i, v in enumerate(np.concatenate([base, base[:20], np.repeat(base[:1], 25, 0)]))]
    n = len(rows)
    rows += [(n, None, 1, ""), (n + 1, [None] * 64, 1, ""), (n + 2, [float("nan")] * 64, 1, ""), (40, rows[40][1], 1, "")]
    df = spark.createDataFrame(rows, VEC)
    found = hamming_search.search_codes(df, F.col("vec_id") % 20 == 0, k=10).collect()
    codes = [(r[0], None if r[1] is None or r[1][0] is None or np.isnan(r[1][0]) else np.array(r[1]) > 0) for r in rows]
    want = Counter()
    for a, (i, x) in enumerate(codes):
        if x is not None and i % 20 == 0:
            near = sorted(((int((x != y).sum()), j) for b, (j, y) in enumerate(codes) if b != a and y is not None))[:10]
            want.update((i, k + 1, j, d) for k, (d, j) in enumerate(near))
    assert bag((r.vec_id, r["rank"], r.neighbor_id, r.distance) for r in found) == want
    few = hamming_search.search_codes(df.filter("vec_id < 4"), F.lit(True), k=10)
    assert few.count() == 12
    assert hamming_search.search_codes(df.limit(0), F.lit(True)).count() == 0


def char_model() -> toxicity.CharModel:
    words = "the of and this that idiot moron scum clown loser stupid worthless trash pathetic disgusting nation thing other".split()
    return toxicity.CharModel({w: 10 for w in words})


@pytest.mark.parametrize(
    ("token", "word"),
    [("1d10t", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("c1own", "clown"), ("l0oooser", "loser"), ("i.d.i.o.t", "idiot"), ("st*pid", "stupid"), ("w0rthle55", "worthless"), ("p@thet1c!!", "pathetic"), ("idiot", "idiot"), ('"trash."', "trash"), ("2024", "2024")],
)
def test_restore(token, word):
    assert toxicity.Reader(char_model()).token(token) == word


def test_restored_text_and_words():
    reader = toxicity.Reader(char_model())
    assert reader.text("You  1d10t, s t u p i d\nm0r0n") == "you  idiot stupid\nmoron"
    found = reader.words([b"", b"an i d i o t here", b"Scum! and tr@sh", "é ü".encode(), b"a"])
    assert found[0] == set() and b"idiot" in found[1] and {b"scum", b"trash"} <= found[2] and found[4] == {b"a"}


def test_toxicity(spark, docs, nothing):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdeno", k=5)) for _ in range(300)]
    bad = ["idiot", "moron", "scum"]
    hidden = {"idiot": "1d10t", "moron": "m o r o n", "scum": "$cuuum"}
    rows, labels = [], []
    for k in range(600):
        words = rng.choices(vocabulary, k=30)
        toxic = k % 8 == 0
        if toxic:
            word = rng.choice(bad)
            words[rng.randrange(30)] = hidden[word] if k % 16 == 0 and k > 300 else word
        rows.append((k, " ".join(words), "s", "x", "y", 1))
        labels.append((k, int(toxic), "clash"))
    table = spark.createDataFrame(rows, DOC)
    marks = spark.createDataFrame([*labels, (None, 1, ""), (5, None, ""), (6, 0, "")], "doc_id long, toxic int, text string")
    model = toxicity.fit(table, marks, F.col("doc_id") % 4 != 2)
    assert set(model.features) >= {b.encode() for b in bad}
    found = toxicity.score_toxicity(table, model, restored=True).collect()
    assert all(r.predicted == (r.doc_id % 8 == 0) and 0 <= r.score <= 1 for r in found)
    assert next(r for r in found if r.doc_id == 304).restored.split() and len(found) == 600
    assert toxicity.score_toxicity(docs, model).count() == docs.count()
    assert toxicity.score_toxicity(nothing, model).count() == 0
    blank = toxicity.fit(nothing, marks.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score_toxicity(docs, blank).collect()} == {0.5}


def test_pipeline_stages(spark, rows, nothing, tmp_path):
    import corpus_pipeline

    table = spark.createDataFrame(rows, DOC)
    marks = spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (table, nothing):
        start.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, kept, str(tmp_path))
            assert out.columns == table.columns
            out.write.mode("overwrite").parquet(f"{tmp_path}/stage{n}.parquet")
            kept = spark.read.parquet(f"{tmp_path}/stage{n}.parquet")
        packed = corpus_pipeline.run(spark, str(tmp_path))
        assert {"doc_id", "sequence_id", "offset"} <= set(packed.columns)
        assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_sha_of_kept_words(docs, rows):
    out = substring.dedup_substrings(docs).select("doc_id", F.sha2(F.col("kept").cast("binary"), 256).alias("h"))
    assert bag(out.collect()) == bag((d, hashlib.sha256(k.encode()).hexdigest()) for d, _, _, k in brute_substring(rows, 50))


def brute_similar(rows, width, similarity):
    """Texts whose shingle sets are that alike, and copies, as a map from text to the smallest id of its component."""
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        n = min(width, len(w))
        return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    component = list(range(len(rows)))

    def top(k):
        while component[k] != k:
            k = component[k]
        return k

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= similarity * len(x | y):
                component[top(i)] = top(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[top(k)] = min(least.get(top(k), r[0]), r[0])
    return [(r[0], least.get(top(k))) for k, r in enumerate(rows)]


def test_similar_texts(spark):
    """Near copies with some words changed, copies, unlike texts of one topic, texts without words, null ids."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(60):
        text = rng.choices(words, k=rng.randint(150, 600))
        rows.append((n := n + 1, " ".join(text)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(text)
            for at in rng.sample(range(len(copy)), len(copy) // 80):
                copy[at] = rng.choice(words)
            rows.append((n := n + 1, " ".join(copy)))
        half = text[: len(text) // 2] + rng.choices(words, k=len(text) // 2)
        rows.append((n := n + 1, " ".join(half)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \t"), (n + 4, "one"), (n + 5, "ONE"), (n + 6, "one two"), (None, "null id"), (None, None)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    want = brute_similar(rows, 5, 0.8)
    found = [(r.doc_id, r.component_id) for r in simhash.dedup_similar(df).collect()]
    assert len(found) == len(rows)
    gone, should = {a for a, b in found if a != b}, {a for a, b in want if a != b}
    assert gone <= should  # nothing is linked that is less alike
    assert len(gone) >= 0.9 * len(should) > 30
    assert dict(found)[n + 3] == n + 1 and dict(found)[n + 5] == n + 4 and dict(found)[n + 6] == n + 6
    assert simhash.dedup_similar(df.limit(0)).count() == 0


def edited_copies(rng, words: int, copies: int, edits: int) -> list[tuple]:
    """A text of distinct words, and copies with some of them changed."""
    text = [f"v{rng.randrange(1 << 40)}" for _ in range(words)]
    rows = [(copies, " ".join(text))]
    for n in range(copies):
        copy = list(text)
        for at in rng.sample(range(words), edits):
            copy[at] = f"e{rng.randrange(1 << 40)}"
        rows.append((n, " ".join(copy)))
    return rows


def test_many_edited_copies_of_one_text(spark):
    """Copies that are alike to the original only, not to each other: 0.87 and 0.82 against 0.76 and 0.67."""
    for edits in (4, 6):
        rows = edited_copies(random.Random(edits), 300, 300, edits)
        assert {b for _, b in brute_similar(rows, 5, 0.8)} == {0}
        found = simhash.dedup_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert len(found) == len(rows) and len({r.component_id for r in found}) <= 80


def test_shards_are_compared_whole(spark):
    """One shard holds several groups; without rounds, and in cells of few texts, every pair must meet."""
    rng = random.Random(5)
    rows = [(1000 * g + a, t) for g in range(3) for a, t in edited_copies(rng, 100, 25, 2)] + [(9000 + k, f"one text {k} of its own kind") for k in range(20)]
    texts = spark.createDataFrame(rows, "id long, t string")
    shards = texts.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("shard"), "id")
    want = {a: b for a, b in brute_similar(rows, 5, 0.8) if a < 9000}
    for rounds, most in ((0, 256), (0, 7), (2, 7)):
        found = simhash.linked_in_shards(shards, texts, 5, 0.8, rounds, most).collect()
        assert {r.node: r.component for r in found} == want


def test_joined_copies_are_not_carried_on_in_shards(spark, monkeypatch):
    """Copies that are joined to their hub are no rows of later joins by shard, however many shards they share."""
    rows = edited_copies(random.Random(4), 300, 150, 4)
    texts = spark.createDataFrame(rows, "id long, t string")
    shards = spark.createDataFrame([(s, n) for s in range(20) for n in range(151) if n != s], "shard long, id long")
    made = []

    class Counted(simhash.Stored):
        def __init__(self, df):
            super().__init__(df)
            made.extend([self.df.count()] * ("shard" in self.df.columns))

    monkeypatch.setattr(simhash, "Stored", Counted)
    found = simhash.linked_in_shards(shards, texts, 5, 0.8).collect()
    assert {r.node for r in found} == set(range(151)) and {r.component for r in found} == {0}
    assert 0 < sum(made) <= shards.count()


def test_repeated_lines_make_no_copies(spark):
    """Texts that share only an often repeated line have the same fingerprints, and nothing else in common."""
    rng, rows = random.Random(9), []
    for k in range(30):
        line = " ".join(f"r{rng.randrange(1 << 30)}" for _ in range((1, 5, 7)[k % 3]))
        rows += [(2 * k + side, " ".join([line] * 200 + [f"o{rng.randrange(1 << 40)}" for _ in range(80)])) for side in range(2)]
    rows += [(60, rows[0][1].upper()), (None, rows[1][1])]
    prints = {(simhash.fingerprint(t.encode(), 1), simhash.fingerprint(t.encode())) for _, t in rows}
    assert len(prints) < 40
    found = simhash.dedup_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert bag(found) == Counter([(n, n) for n in range(60)] + [(60, 0), (None, 1)])


def test_pairs_just_above_the_similarity(spark):
    """Pairs with as many scattered edits as 0.8 allows, texts of 30 to 600 words, and groups of such copies."""
    rng, rows = random.Random(11), []

    def shingles(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for n in [30] * 60 + [60] * 60 + [150] * 60 + [600] * 20:
        text = [f"v{rng.randrange(1 << 40)}" for _ in range(n)]
        copy, more = text, text
        while len(shingles(text) & shingles(more)) >= 0.8 * len(shingles(text) | shingles(more)):
            copy, more = more, list(more)
            more[rng.randrange(n)] = f"e{rng.randrange(1 << 40)}"
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
    rows += [(10_000 + a, t) for a, t in edited_copies(rng, 300, 200, 6)]
    found = simhash.dedup_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert bag(found) == Counter([(n, n - n % 2) for n in range(400)] + [(10_000 + n, 10_000) for n in range(201)])


def test_embeddings_of_a_tight_group(spark):
    """A group of near-copy vectors that is larger than a leaf, among others of its label, with the usual parameters."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    tight = centre + rng.standard_normal((2500, 64)) * 0.14
    v = np.concatenate([tight, rng.standard_normal((1500, 64))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    assert want.sum() > 2_000_000
    table = spark.createDataFrame([(k, x, 1, "n") for k, x in enumerate(v.tolist())], VEC).repartition(4)
    found = {r.vec_id: r.n_links for r in embedding_forest.dedup_embeddings(table).collect()}
    assert sum(found.values()) >= 0.999 * want.sum() and all(found[k] <= want[k] for k in found)
