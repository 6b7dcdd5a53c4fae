"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

Documents longer than a bin are cut into full bins and a rest. The pieces are dealt into shards by a hash of
doc_id, about SHARD pieces each (a hash of the id, so a hot source or cluster spreads over all shards), and
each shard is packed longest piece first. A bin carries a bitmap of the sources and one of the duplicate
clusters in it; a piece may not join a bin that has its source or its cluster. Bins are kept by residual; a
bitmap of the residuals in use gives the successor of a piece's size, and the search goes on to the next
residual until the tightest compatible bin is found, or a new bin is opened. At equal residuals the bin
opened first wins. Bins of one residual are grouped by their bitmaps, so one test serves a group.

Defined results: a document without tokens gets one piece of 0 tokens. Null source is a source of its own
kind that conflicts with nothing. Null text counts as empty. Rows with null doc_id are packed by their
cluster. Repeated rows are packed as copies, each in another bin. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 4096
TOKEN = r"[^\x20\x09-\x0D]+"


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, source, cluster, piece, start, n_tokens: narrow rows, made in one scan of the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", "source", F.xxhash64(F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))).alias("cluster"), F.regexp_count(text, F.lit(TOKEN)).alias("total"))
    cut = own.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("total") - 1) / capacity)).cast("int"))))
    start = F.col("piece") * capacity
    return cut.select("doc_id", "source", "cluster", "piece", start.cast("long").alias("start"), F.least(F.lit(capacity), F.col("total") - start).cast("int").alias("n_tokens"))


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, in the given order. sources, clusters: bitmaps (0: conflicts with nothing)."""
    in_use = 0  # bit r: some bin has the residual r
    held: dict[int, dict[tuple[int, int], list[int]]] = {}  # residual: bitmaps: bins, oldest first
    out, opened = [], 0
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        rest, found = in_use >> size << size, None
        while rest and found is None:
            r = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            fits = [(bins[0], maps) for maps, bins in held[r].items() if not maps[0] & source and not maps[1] & cluster]
            if fits:
                number, maps = min(fits)
                found = (number, r, maps)
        if found is None:
            number, r, maps = opened, capacity, (0, 0)
            opened += 1
        else:
            number, r, maps = found
            group = held[r]
            group[maps].pop(0)
            if not group[maps]:
                del group[maps]
            if not group:
                del held[r]
                in_use &= ~(1 << r)
        insort(held.setdefault(r - size, {}).setdefault((maps[0] | source, maps[1] | cluster), []), number)
        in_use |= 1 << (r - size)
        out.append(number)
    return out


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value; 0 for null, and for a value that only one row has."""
    count = values.value_counts()
    place = {v: i for i, v in enumerate(sorted(count[count > 1].index))}
    return [1 << place[v] if v in place else 0 for v in values]


def pack(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """doc_id, source, piece, start, n_tokens, bin_id (shard and bin in it), for every piece."""
    n_shards = max(1, -(-docs.count() // SHARD))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], ignore_index=True)
        number = best_fit(rows.n_tokens.tolist(), _bits(rows.source), _bits(rows.cluster), capacity)
        rows["bin_id"] = rows.shard * (1 << 32) + pd.Series(number, dtype="int64")
        return rows[["doc_id", "source", "piece", "start", "n_tokens", "bin_id"]]

    dealt = pieces(docs, capacity).withColumn("shard", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("cluster").cast("string"))), F.lit(n_shards)))
    return dealt.groupBy("shard").applyInPandas(shard, f"doc_id {kind}, source string, piece int, start long, n_tokens int, bin_id long")


def bins(packed: DataFrame) -> DataFrame:
    """One row per bin: bin_id, n_tokens, n_pieces; a bin has at most capacity tokens."""
    return packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
