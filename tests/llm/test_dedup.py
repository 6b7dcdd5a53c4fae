import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import exact_dedup, graph, simhash, suffix_dedup


def groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return by


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.pmod(F.length(c), F.lit(60))], ids=["strong", "colliding"])
def test_exact_groups(make, corpus, key):
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(make(corpus), key=key, capacity=16).collect()}
    for text, ids in groups(corpus).items():
        for i in ids:
            r = found.pop(i)
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    assert not found


def test_exact_awkward(awkward, nothing):
    found = exact_dedup.exact_duplicates(awkward).collect()
    assert len(found) == 12
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.keep_id, r.group_size, r.kept) for r in by[6]] == [(6, 3, True)] * 2  # repeated rows stay together
    assert by[2][0].keep_id == 1 and by[3][0].keep_id == 3 and by[5][0].keep_id == 4
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_directory_splits_overfull_buckets(spark):
    slots = spark.range(4000).select(F.xxhash64("id").alias("key"))
    cells, depth = exact_dedup.directory(slots, 100)
    held = slots.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("cell")).count().join(cells, "cell").groupBy("bucket").agg(F.sum("count").alias("n"))
    assert held.agg(F.max("n"), F.sum("n")).head()[0] <= 100 and held.agg(F.sum("n")).head()[0] == 4000


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (4, 5), (9, 8), (8, 8), (9, 8), (100, 7), (7, 6)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 4000 + i) for i in range(50)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found | {1: 1} == found and {found[i] for i in (1, 2, 3, 4, 5)} == {1} and found[9] == 8 and found[100] == 6
    assert {found[1000 + i] for i in range(61)} == {1000} and found[5000] == 4000 and found[4049] == 4000
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(p.encode(), 42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    """Smallest id reachable by links of at most 2 differing bits."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, values = list(fps), np.array(list(fps.values()), np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 2):
            a, b = sorted((find(i), find(ids[j])))
            root[b] = a
    return {i: find(i) for i in ids}


def test_covering_masks():
    rng = np.random.default_rng(2)
    for radius in (2, 3):
        tables = np.array(simhash.masks(radius), np.int64)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            differ = 0
            for b in rng.choice(64, rng.integers(1, radius + 1), replace=False):
                differ |= 1 << int(b)
            signed = differ - (1 << 64) if differ >> 63 else differ
            assert (tables & signed == 0).any()


def test_simhash(make, corpus):
    found = {r.doc_id: r for r in simhash.similar(make(corpus)).select("doc_id", simhash.as_hex().alias("h"), "component_id").collect()}
    fps = {i: fingerprint(t) for i, t in corpus}
    assert {i: int(r.h, 16) for i, r in found.items()} == fps
    assert {i: r.component_id for i, r in found.items()} == linked(fps)


@pytest.mark.parametrize("small", [0, 48])
def test_links_in_large_buckets(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(3)
    fps = {}
    for c in range(6):
        base = int(rng.integers(0, 1 << 63))
        for k in range(60):
            value = base
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                value ^= 1 << int(b)
            fps[c * 100 + k] = value
    values = list(dict.fromkeys(fps.values()))
    nodes = dict(enumerate(values))
    signed = [(v - (1 << 64) if v >> 63 else v, n) for n, v in nodes.items()]
    found = {r.node: r.component for r in graph.components(simhash.linked_classes(spark.createDataFrame(signed, "fp long, node long"))).collect()}
    assert {n: found.get(n, n) for n in nodes} == linked(nodes)


def test_simhash_awkward(awkward, nothing):
    found = simhash.similar(awkward).collect()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == 12 and by[1].fp == by[2].fp == by[3].fp == 0 and by[2].component_id == 1 and by[5].component_id == 4
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert simhash.similar(nothing).count() == 0


def test_near_copies(make, awkward, nothing):
    import random

    rng = random.Random(4)
    rows, originals = [], {}
    for i in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
        rows.append((i, " ".join(words)))
        if i < 40:
            changed = list(words)
            changed[rng.randrange(200)] = "changed"
            rows.append((100 + i, " ".join(changed)))
            originals[100 + i] = i
    found = {r.doc_id: r.component_id for r in simhash.near_copies(make(rows)).collect()}
    assert all(found[i] == i for i in range(60))  # clean documents stay
    assert sum(found[c] == o for c, o in originals.items()) >= 39
    assert simhash.near_copies(nothing).count() == 0
    assert {r.doc_id: r.component_id for r in simhash.near_copies(awkward).collect()}[5] == 4


def jaccard_components(rows, similarity=0.8):
    """Smallest id reachable by links of that similarity, by plain comparison of all pairs."""
    sets = {}
    for i, t in rows:
        words = t.lower().split()
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def copies(rng, n, length, changes):
    """n texts of random words, and as many copies with some words changed."""
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(length)]
        changed = list(words)
        for at in rng.sample(range(0, length, 6), changes):
            changed[at] = "".join(rng.choice("stuvwxyz") for _ in range(5))
        rows += [(i, " ".join(words)), (10_000 + i, " ".join(changed))]
    return rows


def test_near_copies_whose_words_differ_much(make):
    import random

    rng = random.Random(8)
    rows = copies(rng, 60, 200, 4) + [(i + 1000, t) for i, t in copies(rng, 20, 60, 1)] + [(i + 2000, t) for i, t in copies(rng, 20, 60, 2)]
    wanted = jaccard_components(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(make(rows)).collect()} == wanted and sum(i != c for i, c in wanted.items()) >= 80


def test_near_copies_in_large_buckets(make, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "SMALL", 3)
    monkeypatch.setattr(simhash, "BLOCK", 8, raising=False)
    rng = random.Random(9)
    passage = " ".join("".join(rng.choice("ijklmn") for _ in range(5)) for _ in range(60))
    rows = [(i, f"{passage} {t}") for i, t in copies(rng, 40, 40, 1)]  # alike by the passage, copies or not, at about 0.4
    chain, texts = copies(rng, 1, 150, 0)[0][1].split(), []
    for k in range(60):  # each is like the one before, and hardly like those far before
        chain[k * 2 % 150] = f"new{k}"
        texts.append((20_000 + k * 3000, " ".join(chain)))
    rows += texts
    assert {r.doc_id: r.component_id for r in simhash.near_copies(make(rows)).collect()} == jaccard_components(rows)


def test_near_copies_behind_an_unrelated_least_member(make):
    import random

    rng = random.Random(10)
    passage = " ".join(["same"] * 3)
    rows = [(i, f"{passage} {t}") for i, t in copies(rng, 80, 30, 0)]
    rows = [(i, t + (" end" if i >= 10_000 else "")) for i, t in rows]  # copies over 1,024 ids apart
    found = {r.doc_id: r.component_id for r in simhash.near_copies(make(rows)).collect()}
    assert found == jaccard_components(rows) == {i: i % 10_000 for i, _ in rows}


def test_near_copies_go_by_fingerprints_first(make, spark, monkeypatch):
    import random

    rng = random.Random(14)
    rows = copies(rng, 30, 200, 1) + [(i + 1000, t) for i, t in copies(rng, 20, 60, 2)] + [(500, "a b"), (501, "A  b")]
    ids = [i for i, _ in rows if i != 501]
    found = {tuple(sorted(r)) for r in simhash.fingerprint_pairs(make(rows), spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    fp = {i: simhash.majority(simhash.hashes(simhash.shingles(t, 3))) for i, t in rows}
    wanted = {(a, b) for a in ids for b in ids if a < b and ((fp[a] ^ fp[b]) & (1 << 64) - 1).bit_count() <= 2}
    assert found == wanted and len(wanted) >= 10  # no two have equal fingerprints here
    seen, candidates = [], simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda *x: seen.append(candidates(*x)) or seen[-1])
    wanted_components = jaccard_components(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(make(rows)).collect()} == wanted_components
    left = {tuple(r) for r in seen[0].collect()}
    alike = {(i, i + 10_000) for i, _ in rows if wanted_components.get(i + 10_000) == i}
    assert not left & found and alike <= left | found  # what fingerprints join isn't compared again, the rest is


def test_near_copies_compare_no_pairs_of_unlike_sizes_or_places(make, monkeypatch):
    import random

    rng = random.Random(15)
    passage = " ".join("".join(rng.choice("ijklmn") for _ in range(5)) for _ in range(6))
    rows = [(i, f"{passage} {' '.join(''.join(rng.choice('abcdefgh') for _ in range(5)) for _ in range(40 + 6 * i))}") for i in range(40)]
    seen, candidates = [], simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda *x: seen.append(candidates(*x)) or seen[-1])
    assert {r.doc_id: r.component_id for r in simhash.near_copies(make(rows)).collect()} == jaccard_components(rows)
    sizes = [len(t.split()) - 4 for _, t in rows]
    assert all(sizes[a] >= 0.8 * sizes[b] - 1e-6 for a, b in seen[0].collect())


def test_near_copies_at_the_similarity(make):
    import random

    rng = random.Random(12)
    rows = []
    for i in range(0, 90, 3):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(105)]
        rows += [(i, " ".join(words[:84])), (i + 1, " ".join(words[:104]))] if i % 2 else [(i, " ".join(words[:84])), (i + 2, " ".join(words))]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(make(rows)).collect()}
    assert found == {i: i - 1 if i % 3 == 1 else i for i, _ in rows}  # 80 of 100 shingles are enough, 80 of 101 aren't


def repeats(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            least[b[p : p + 50]] = min(least.get(b[p : p + 50], 1 << 70), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeated_passages(make, corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 20_000)  # several chunks a task
    rows = [*corpus, (5000, "z" * 200), (5001, "z" * 60), (5002, corpus[0][1][:49]), (5003, "ab" * 100)]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(make(rows)).collect()}
    assert found == repeats(rows)


def test_repeats_awkward(awkward, nothing):
    found = suffix_dedup.remove_repeats(awkward).collect()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == 12 and by[1].n_bytes == 0 and by[4].n_removed == 0 and by[5].n_removed == by[5].n_bytes and by[9].n_removed == 0
    assert [(s.start, s.past) for s in by[5].spans] == [(0, by[5].n_bytes)]
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_anchors_meet_whatever_surrounds_them():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 50, dtype=np.uint8)
    for _ in range(200):
        texts = [np.concatenate([rng.integers(97, 123, rng.integers(0, 200), dtype=np.uint8), passage, rng.integers(97, 123, rng.integers(0, 200), dtype=np.uint8)]) for _ in range(2)]
        found = []
        for t in texts:
            at = bytes(t).index(bytes(passage))
            places = suffix_dedup.anchors(t, np.array([0, len(t)]))
            found.append({int(p - at) for p in places if 0 <= p - at <= 25})
        assert found[0] & found[1]
