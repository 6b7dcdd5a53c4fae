"""SimHash fingerprints and near copies by covering locality-sensitive hashing.

Each of the 64 bits gets a vector of r + 1 bits, not zero, dealt round robin; table v (any nonzero vector)
keeps the bits whose vector has an odd product with v. The vectors of at most r differing bits span at most
2 ** r of the 2 ** (r + 1) vectors, so some v is orthogonal to all of them: that table masks out every
differing bit, and the two fingerprints have equal keys in it (Pagh, 2016). Every pair within the radius
collides in some table; there are 2 ** (r + 1) - 1.

Documents with equal fingerprints are one class. Only classes are hashed into tables. Buckets of at most
SMALL classes are compared pair by pair. In larger buckets no pairs are made: for radius 2 each class emits
itself and each fingerprint one free bit away, and classes that share one of these are linked to the least
of them; two classes share one exactly when they differ in at most 2 free bits. Nothing is capped.

Defined results of ``similar``: null text counts as empty; texts without words have the fingerprint zero and
are linked like any other. Rows with null doc_id get a fingerprint and no component (null) and link nothing.
Repeated rows give repeated results. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import repeat
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .store import BROADCAST_IDS, drop, save
from .words import LOWER, coded, parts, words

SMALL = 48


def masks(radius: int) -> list[int]:
    """For each table the fingerprint bits that it keeps, as a signed long."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    found = (sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1)))
    return [m - (1 << 64) if m >> 63 else m for m in found]


def shingles(text: str | None, n: int) -> list[bytes]:
    own = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(own) <= n:
        return [b" ".join(own)] if own else []
    return list(map(b" ".join, zip(*(own[i:] for i in range(n)), strict=False)))


def hashes(own: list[bytes], seed: int = 42) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(seed)), np.uint64, len(own))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of h, as a signed long; zero if h is empty."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):  # bounded memory for texts of any length
        ones += np.unpackbits(h[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp: SimHash of every whole text over word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            fp = [majority(hashes(shingles(t, shingle))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _crowded(classes: DataFrame, tables: list[int], fp: str = "fp") -> DataFrame:
    """classes (fp, ...) once per table (t, k) whose bucket holds others too, with the bucket's size."""
    keyed = classes.withColumn("e", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(tables)))))
    keyed = keyed.select(*classes.columns, "e.t", "e.k")
    full, _ = save(keyed.groupBy("t", "k").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    return keyed.join(full, ["t", "k"])


def linked_classes(classes: DataFrame) -> DataFrame:
    """Links (a, b) that join all classes (long columns fp, node) which differ in at most 2 bits."""
    tables = masks(2)
    met, _ = save(_crowded(classes, tables), "met")
    few, many = met.where(F.col("size") <= SMALL), met.where(F.col("size") > SMALL)
    other = few.select("t", "k", F.col("fp").alias("fp2"), F.col("node").alias("b"))
    pairs = few.join(other, ["t", "k"]).where("node < b and bit_count(fp ^ fp2) <= 2").select(F.col("node").alias("a"), "b")
    free = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64) if not m >> i & 1)) for m in tables))
    star = many.select("t", "node", "fp", F.explode(F.element_at(free, F.col("t") + 1)).alias("flip"))
    star = star.groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).agg(F.min("node").alias("a"), F.collect_list("node").alias("all"))  # at most 65 nodes, one a bit
    return pairs.union(star.where("size(all) > 1").select("a", F.explode("all").alias("b")).where("a <> b"))


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: documents whose fingerprints differ in at most 2 bits are linked."""
    marked, _ = save(fingerprints(docs), "fingerprints")
    classes, _ = save(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = components(linked_classes(classes))
    named, _ = save(classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    return marked.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# Near copies by a similarity of shingle sets, for the pipeline

SHINGLE, SAMPLE, FREQUENT, BLOCK, BLOCK_SHINGLES = 5, 10_000, 200_000, 512, 1 << 20


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct word shingles as sorted 64-bit hashes; a short text is one shingle."""
    bounds, flat = words(texts)
    codes, names = coded(flat)
    h = hashes([w.encode("utf-8", "surrogatepass") for w in names])[codes]
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = h[a:b]
        width = min(SHINGLE, len(own))
        mixed = np.zeros(len(own) - width + 1 if width else 0, np.uint64)
        for i in range(width):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[i : i + len(mixed)]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield np.unique(mixed ^ (mixed >> np.uint64(29)))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several of about SAMPLE texts have, at most FREQUENT, and their counts.

    They only order shingles, which makes buckets smaller; results are the same for any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            own = np.concatenate([np.empty(0, np.uint64), *shingle_sets(batch.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["key"])

    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // SAMPLE))) == 0
    counted = docs.where(part).select("text").mapInArrow(run, "key long").groupBy("key").count().where("count > 2")
    rows = counted.orderBy(F.desc("count"), "key").limit(FREQUENT).toArrow()
    keys, counts = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefixes(docs: DataFrame, similarity: float, known: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, digest (of the set), size, rest, keys: all but rest of a set's shingles, rarest first.

    Sets of that similarity share at least rest + 1 of either's shingles, so each has one of those among its keys.
    known (sorted) are shingles that come last, by their counts; the others come in order of their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            digests, sizes, rests, keys = [], [], [], []
            for own in shingle_sets(batch.column(1)):
                digests.append(blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(own))
                rests.append(max(0, ceil(similarity * len(own) - 1e-6) - 1))
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.lexsort((own, np.where(known[at] == own, counts[at], 0)))]
                keys.append(own[: sizes[-1] - rests[-1]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(rests, pa.int32()), held], ["doc_id", "digest", "size", "rest", "keys"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("digest binary, size int, rest int, keys array<long>")])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, own: the shingle sets of the documents named in nodes (one column, node), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())], ["node", "own"])

    nodes, _ = save(nodes, "nodes")
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "node", "left_semi")
    return texts.mapInArrow(run, "node long, own binary")


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (positions in sets) that join all sets of that similarity; at most one less than sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    has, fresh, found = np.zeros(len(distinct), bool), np.ones(len(sets), bool), []
    for first in range(len(sets)):
        waiting = [first] if fresh[first] else []
        fresh[first] = False
        while waiting:
            x = waiting.pop()
            mine = ids[starts[x] : starts[x + 1]]
            has[mine] = True
            common = np.add.reduceat(has[ids], starts[:-1], dtype=np.int64)
            has[mine] = False
            hit = np.flatnonzero(fresh & (common / (sizes[x] + sizes - common) >= similarity)).tolist()
            fresh[hit] = False
            found += [(x, y) for y in hit]
            waiting += hit
    return found


def crowded_links(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among members of large buckets. crowd: key, node, size.

    Members are split by size, each into two classes, so that two of that similarity are in one. Buckets of a class
    that share members are one group, so that a pair isn't compared in each of its buckets. A group's members are
    dealt into blocks, and every two blocks meet in one cell, which compares all its members.
    """
    level = F.floor(F.log("size") / (log(1 / similarity) + 1e-6))
    split = crowd.withColumn("level", F.explode(F.array(level, level + 1))).withColumn("vertex", F.xxhash64("node", "level"))
    named = components(split.select(F.xxhash64("key", "level", F.lit("bucket")).alias("a"), F.col("vertex").alias("b")))
    grouped, _ = save(named.select(F.col("node").alias("vertex"), F.col("component").alias("grp")).join(split.select("vertex", "node", "size").distinct(), "vertex").drop("vertex"), "grouped")
    blocks = grouped.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("n"), F.count("*").alias("members")).where("members > 1")
    dealt = grouped.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("node"), "n")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.where("n = 1 or block <> other").select("node", "grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def cell(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_pylist()
        found = alike([np.frombuffer(s, np.uint64) for s in rows.column("own").to_pylist()], similarity)
        return pa.table({"a": pa.array([nodes[x] for x, _ in found], pa.int64()), "b": pa.array([nodes[y] for _, y in found], pa.int64())})

    return dealt.join(sets, "node").select("grp", "i", "j", "node", "own").groupBy("grp", "i", "j").applyInArrow(cell, "a long, b long")


def fingerprint_pairs(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the documents named in nodes (one column, doc_id): what covering hashing of their fingerprints links.

    Those of one fingerprint form a class and meet its least member; least members of classes that differ in at most
    2 bits meet as in ``similar``. Pairs are as many as documents and linked classes, whatever the classes hold.
    """
    marked, _ = save(fingerprints(docs).join(nodes, "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "fp"), "fingerprints")
    classes, _ = save(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    within = marked.join(classes.where("n > 1").select("fp", "node"), "fp").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    return within.union(linked_classes(classes.select("fp", "node"))).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets (node, own) have that similarity."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("own").alias("sa")), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                right.append(common / (len(x) + len(y) - common) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(right, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long")


def candidates(few: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of one bucket whose sets can have that similarity. few: key, node, size, rest, pos, part; held: node, held.

    Nodes of one part are linked already and don't meet. The rest needs a share of na + nb common shingles. A key at
    places pa and pb leaves room for no more than lie behind it in either set, and before it in both; before the first
    common key lie none. Keys of large buckets (held) and what stands behind the keys (rest) may be common too.
    """
    needed = (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-6
    behind = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    own = lambda x: few.select("key", F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("rest").alias(f"r{x}"), F.col("pos").alias(f"p{x}"), F.col("part").alias(f"part_{x}"))
    met = own("a").join(own("b"), "key").where((F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & (behind + F.least("pa", "pb") >= needed))
    met = met.groupBy("a", "b").agg(F.count("*").alias("common"), F.max(behind).alias("room"), *(F.first(c).alias(c) for c in ("na", "nb", "ra", "rb"))).where(F.col("room") >= needed)
    near = F.col("common") + F.greatest("ra", "rb")
    met = met.join(held.select(F.col("node").alias("a"), F.col("held").alias("ha")), "a", "left").join(held.select(F.col("node").alias("b"), F.col("held").alias("hb")), "b", "left")
    return met.where(near + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= needed).select("a", "b")


def _keyed(first: DataFrame) -> DataFrame:
    return first.select(F.col("doc_id").alias("node"), "size", "rest", "part", F.posexplode("keys").alias("pos", "key"))


def _shared(first: DataFrame) -> DataFrame:
    return first.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: documents linked by a similarity (Jaccard) of their sets of five-word shingles.

    Fingerprints and covering tables (as in ``similar``) give the first pairs; those whose whole sets have the
    similarity are links, and what they join isn't compared again. Copies beyond the radius share one of their rarest
    shingles (prefix filter), which every similar pair does. Buckets of at most SMALL members are compared pair by
    pair; pairs whose sizes, places or numbers of common keys rule the similarity out are dropped, and the rest is
    decided on the whole sets. Larger buckets are compared in cells. Nothing is capped or estimated, but shingles are
    known by 64-bit hashes. Equal sets are one class. Texts without words, and rows with null doc_id, have no copies.
    """
    docs = docs.where("doc_id is not null")
    known, counts = frequent_shingles(docs)
    marked, _ = save(prefixes(docs, similarity, known, counts), "prefixes")
    classes, _ = save(marked.where("size > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "size", "rest")).alias("c"), F.count("*").alias("n")).select("digest", F.col("c.doc_id").alias("node"), "c.size", "c.rest", "n"), "classes")
    same, _ = save(marked.select("doc_id", "digest").join(classes.where("n > 1").select("digest", "node"), "digest").where("doc_id <> node").select("doc_id", "digest"), "same")
    first = marked.where("size > 0").join(F.broadcast(same) if same.count() <= BROADCAST_IDS else same, ["doc_id", "digest"], "left_anti")
    hashed, _ = save(fingerprint_pairs(docs, classes.select(F.col("node").alias("doc_id"))), "fingerprint-pairs")
    hashed_sets, path = save(whole_sets(docs, hashed.select(F.col("a").alias("node")).union(hashed.select("b")).distinct()), "sets")
    near, _ = save(verified(hashed, hashed_sets, similarity), "fingerprint-links")
    drop(docs.sparkSession, path)
    joined = components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
    joined, _ = save(joined, "parts")
    joined = F.broadcast(joined) if joined.count() * 2 <= BROADCAST_IDS else joined
    first = first.join(joined, "doc_id", "left").select("doc_id", "size", "rest", F.coalesce("part", F.col("doc_id").cast("long")).alias("part"), "keys")
    full, _ = save(_shared(first), "buckets")
    hot, _ = save(full.where(F.col("n") > SMALL).orderBy(F.desc("n"), "key").limit(FREQUENT), "hot")
    if (rows := hot.toArrow()).num_rows:
        # keys of large buckets come last from here on; texts without them among their keys keep these
        moved, more = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy() + (1 << 40)
        stay = ~np.isin(known, moved)
        known, counts = np.concatenate([known[stay], moved]), np.concatenate([counts[stay], more])
        order = np.argsort(known)
        ids, _ = save(_keyed(first).join(F.broadcast(hot), "key", "left_semi").select(F.col("node").alias("doc_id")).distinct(), "reordered")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        again = prefixes(docs.join(ids, "doc_id", "left_semi"), similarity, known[order], counts[order])
        first, _ = save(first.join(ids, "doc_id", "left_anti").union(again.join(joined, "doc_id", "left").select("doc_id", "size", "rest", F.coalesce("part", F.col("doc_id").cast("long")).alias("part"), "keys")), "prefixes")
        full, _ = save(_shared(first), "buckets")
    keyed = _keyed(first)
    met, _ = save(keyed.join(full, "key"), "met")
    few, many = met.where(F.col("n") <= SMALL), met.where(F.col("n") > SMALL)
    crowd, _ = save(many.select("key", "node", "size"), "crowd")
    pairs, _ = save(candidates(few, crowd.groupBy("node").agg(F.count("*").alias("held")), similarity), "pairs")
    sets, _ = save(whole_sets(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd.select("node")).distinct()), "sets")
    links = near.union(verified(pairs, sets, similarity)).union(crowded_links(crowd, sets, similarity))
    found = components(links)
    named, _ = save(classes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id")), "named")
    return marked.join(named, "digest", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
