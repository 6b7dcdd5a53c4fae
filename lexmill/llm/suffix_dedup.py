"""Removal of passages of SPAN bytes or more that a document with a smaller id has too.

An enhanced suffix array of all texts is sampled and dealt out, so that equal passages meet:

1. Chunks. Documents are written in chunks with their anchors: of any ANCHORS consecutive strings of KEY bytes
   the one with the least hash is an anchor. SPAN bytes hold ANCHORS such strings, so equal passages have
   equal anchors at equal places, whatever surrounds them.
2. Repeated anchors. A chunk sends 32 bits of each distinct anchor, with its number of documents, to the
   owner of its hash range and hears whether other documents have it. Chance matches cost work, not results.
3. Windows. Around each repeated anchor stand at most KEY bytes more on either side. A chunk sends each
   distinct window once, with the smallest id that has it. The owner sorts the windows by what follows from
   the anchor's start (a suffix array) with the lengths of common prefixes of neighbours, and by what
   precedes it, read backwards. Runs of neighbours with common prefixes of depth KEY + r are the nodes of the
   common-prefix interval tree at that depth; within a node, windows are told apart by their left extension of
   KEY - r bytes. What is left is a group of all occurrences of one SPAN-byte string, and every window
   learns for each of its ANCHORS strings whether a smaller id has it. Bytes are compared, not hashes.
4. Hot anchors, which more than HOT documents have, are dealt by their SPAN-byte strings instead of by anchor:
   a chunk sends each distinct string once, so a passage in a third of all rows is one record a chunk, and
   its surroundings, however varied, spread over all owners.
5. Each chunk marks the covered bytes and counts, hashes and lists what is left.

Defined results: null and empty texts have no bytes and no spans. Rows with null doc_id rank after all others.
Rows with the same doc_id don't remove each other's bytes, nor does a document its own. An empty table gives an
empty result. Only doc_id (whole numbers) and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, save, spread
from .words import parts

SPAN, KEY = 50, 25
ANCHORS = SPAN - KEY + 1
HOT, CHUNK_BYTES, BLOCK, LAST = 4096, 8_000_000, 1 << 15, (1 << 63) - 1
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def expand(x: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), dtype) if x else np.zeros(0, dtype)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * MIX[2]
    return h ^ (h >> np.uint64(32))


def _extremes(h: np.ndarray, width: int, f) -> np.ndarray:
    """The least or largest (f) of each width consecutive values."""
    m = h
    w = 1
    while w * 2 <= width:
        m, w = f(m[:-w], m[w:]), w * 2
    return f(m[: len(m) - (width - w)], m[width - w :])


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of each KEY consecutive bytes, from hashes of runs of 1, 2, 4 ... bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * MIX[1]
    h ^= h >> np.uint64(32)
    n, step, size, at, left = len(data) - KEY + 1, MIX[0], 1, 0, KEY
    total = np.zeros(n, np.uint64)
    while left:
        if left & 1:
            total = total * step + h[at : at + n]
            at += size
        left >>= 1
        if left:
            with np.errstate(over="ignore"):  # modulo 2 ** 64
                h, step, size = h[:-size] * step + h[size:], step * step, size * 2
    return _mixed(total)


def anchors(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the anchors in the documents data[bounds[i]:bounds[i + 1]], ascending. Works in blocks."""
    found = []
    width = 2 * ANCHORS + KEY
    for start in range(0, max(0, len(data) - KEY + 1), BLOCK):
        low = max(0, start - ANCHORS + 1)
        part = data[low : start + BLOCK + width]
        if len(part) < SPAN:
            continue
        h = _rolling(part)
        least = _extremes(h, ANCHORS, np.minimum)
        edge = np.zeros(ANCHORS - 1, np.uint64)
        mine = _extremes(np.concatenate([edge, least, edge]), ANCHORS, np.maximum)
        at = np.flatnonzero(h == mine) + low
        found.append(at[(at >= start) & (at < start + BLOCK)])
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    owner = np.searchsorted(bounds, places, "right") - 1
    return places[places + KEY <= bounds[owner + 1]]


def keys(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of the KEY bytes at each place."""
    if not len(places):
        return np.zeros(0, np.uint64)
    own = np.zeros((len(places), 32), np.uint8)
    own[:, :KEY] = sliding_window_view(data, KEY)[places]
    h = np.zeros(len(places), np.uint64)
    for w, m in zip(own.view("<u8").T, MIX, strict=True):
        h = (h ^ (w * m)) * MIX[0]
        h ^= h >> np.uint64(31)
    return _mixed(h)


class Chunk:
    """The documents of one row of the table of chunks."""

    def __init__(self, row: dict) -> None:
        self.g = row["g"]
        self.ids = np.array([LAST if d is None else d for d in row["doc_ids"]], np.int64)
        self.doc_ids = row["doc_ids"]
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<i8"))])
        self.data = expand(row["texts"], "u1")
        self.places = np.cumsum(expand(row["anchors"], "<u4").astype(np.int64))
        self.owner = np.searchsorted(self.bounds, self.places, "right") - 1

    def records(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors: owners, 32-bit remainders and documents of each, by owner; and each anchor's number."""
        h = keys(self.data, self.places)
        to = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        key = to << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        order = np.argsort(key, kind="stable")  # equal keys stand by place, so by document
        by, doc = key[order], self.owner[order]
        new = np.ones(len(by), bool)
        new[1:] = by[1:] != by[:-1]
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        number = np.empty(len(by), np.int64)
        number[order] = np.cumsum(new) - 1
        known, docs = by[new], np.bincount(number[order], other, int(new.sum())).astype(np.int64)
        return (known >> np.uint64(32)).astype(np.int64), (known & np.uint64(0xFFFFFFFF)).astype("<u4"), docs, number

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of the chosen anchors as rows of bytes, the smallest id of each, each anchor's number.

        Of the SPAN + KEY + 2 bytes of a row the last two tell how many on the left and right are in the document.
        """
        at, owner = self.places[chosen], self.owner[chosen]
        left = np.minimum(KEY, at - self.bounds[owner]).astype(np.uint8)
        right = np.minimum(KEY, self.bounds[owner + 1] - at - KEY).astype(np.uint8)
        padded = np.concatenate([np.zeros(KEY, np.uint8), self.data, np.zeros(KEY + SPAN, np.uint8)])
        own = np.empty((len(at), SPAN + KEY + 2), np.uint8)
        own[:, : SPAN + KEY] = sliding_window_view(padded, SPAN + KEY)[at] if len(at) else 0
        own[:, -2], own[:, -1] = left, right
        side = np.arange(KEY)
        own[:, :KEY][side < KEY - left[:, None]] = 0
        own[:, SPAN : SPAN + KEY][side >= right[:, None]] = 0
        return distinct(own, self.ids[owner])


def distinct(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the smallest id of each, and each row's number among them."""
    n, width = rows.shape
    if not n:
        return rows, ids, np.zeros(0, np.int64)
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    words = wide.view("<u8")
    h = np.zeros(n, np.uint64)
    for w, m in zip(words.T, MIX * width, strict=False):
        h = (h ^ (w * m)) * MIX[0]
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], (words[order[1:]] != words[order[:-1]]).any(1)])
    if (new[1:] & (h[order[1:]] == h[order[:-1]])).any():  # different rows with one hash: sort by all bytes
        order = np.lexsort(words.T)
        new = np.concatenate([[True], (words[order[1:]] != words[order[:-1]]).any(1)])
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), LAST, np.int64)
    np.minimum.at(least, number, ids)
    return rows[order[new]], least, number


def repeated(windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window a mask: bit l is set if a window with a smaller id has its SPAN-byte string that starts
    l bytes before the anchor.

    Equal windows are settled at once; the tree is built over different windows that share their anchor.
    """
    rows, least, number = distinct(windows, ids)
    if not len(rows):
        return np.zeros(0, np.uint32)
    left, right = rows[:, -2].astype(np.uint32), rows[:, -1].astype(np.uint32)
    one = np.uint32(1)
    whole = np.where(left + right >= KEY, ((one << (left + one)) - one) & ~((one << (np.uint32(KEY) - right)) - one), 0).astype(np.uint32)
    _, anchor, met = np.unique(keys(np.ascontiguousarray(rows[:, KEY:SPAN]).ravel(), np.arange(len(rows)) * KEY), return_inverse=True, return_counts=True)
    some = np.flatnonzero(met[anchor] > 1)
    told = np.zeros(len(rows), np.uint32)
    told[some] = _tree_masks(rows[some], least[some])
    return np.where(ids > least[number], whole[number], told[number])


def _tree_masks(windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """repeated() for windows that are all different."""
    n = len(windows)
    left, right = windows[:, -2].astype(np.int64), windows[:, -1].astype(np.int64)
    after = np.zeros((n, 56), np.uint8)
    after[:, :SPAN] = windows[:, KEY : KEY + SPAN]
    before = np.zeros((n, 32), np.uint8)
    before[:, :KEY] = windows[:, KEY - 1 :: -1][:, :KEY]

    order = np.lexsort(after.view(">u8").astype(np.uint64).T[::-1])  # the suffix array
    sorted_after = after[order]
    common = np.full(n, -1)  # of each suffix with the one before it
    common[1:] = _common(sorted_after[1:], sorted_after[:-1], SPAN)
    anchor = np.empty(n, np.int64)
    anchor[order] = np.cumsum(common < KEY)
    back = np.lexsort([*before.view(">u8").astype(np.uint64).T[::-1], anchor])
    shared = np.full(n, -1)
    shared[1:] = np.where(anchor[back[1:]] == anchor[back[:-1]], _common(before[back[1:]], before[back[:-1]], KEY), -1)

    mask = np.zeros(n, np.uint32)
    for extension in range(KEY + 1):
        depth = SPAN - extension
        valid = np.flatnonzero((left >= extension) & (right >= KEY - extension))
        if not len(valid):
            continue
        node, side = np.empty(n, np.int64), np.empty(n, np.int64)
        node[order] = np.cumsum(common < depth)
        side[back] = np.cumsum(shared < extension)
        group = node[valid] * (n + 1) + side[valid]
        by = np.argsort(group, kind="stable")
        group = group[by]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        if len(first) == len(group):
            continue
        own = ids[valid][by]
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.concatenate([first, [len(group)]])))
        mask[valid[by[own > least]]] |= np.uint32(1 << extension)
    return mask


def _common(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Number of equal leading bytes of each pair of rows, width at most."""
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 1 << 16):
        differ = a[k : k + (1 << 16), :width] != b[k : k + (1 << 16), :width]
        out[k : k + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), width)
    return out


def pack(docs: DataFrame) -> DataFrame:
    """Documents in chunks of about CHUNK_BYTES, with their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in parts(batches, 1, CHUNK_BYTES):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            lengths = np.array([len(t) for t in texts], "<i8")
            joined = b"".join(texts)
            places = anchors(np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
            columns = [pa.array([number], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (lengths.tobytes(), zstandard.compress(joined, 3), squeeze(np.diff(places, prepend=0).astype("<u4")))), pa.array([len(places)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["g", "doc_ids", "lengths", "texts", "anchors", "n_anchors"])
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, "g long, doc_ids array<long>, lengths binary, texts binary, anchors binary, n_anchors long")


PARCEL = "owner int, g long, hot boolean, ids binary, rows binary"


def _parcels(chunk: Chunk, hot: bool, to: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each owner; ids and rows must stand by owner."""
    cuts = [*np.flatnonzero(np.diff(to, prepend=-1)).tolist(), len(to)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield pa.RecordBatch.from_arrays([pa.array([int(to[a])], pa.int32()), pa.array([chunk.g], pa.int64()), pa.array([hot]), *(pa.array([squeeze(x[a:b])], pa.binary()) for x in (ids, rows))], ["owner", "g", "hot", "ids", "rows"])


def repeated_anchors(packed: DataFrame, n: int) -> DataFrame:
    """g, owner, found: 0, 1 (another document has it) or 2 (hot) for each of the chunk's records."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                to, rest, docs, _ = chunk.records(n)
                yield from _parcels(chunk, False, to, np.minimum(docs, 65535).astype("<u2"), rest)

    def meet(table: pa.Table) -> pa.Table:
        rest = [expand(x, "<u4") for x in table.column("rows").to_pylist()]
        docs = [expand(x, "<u2") for x in table.column("ids").to_pylist()]
        known, number = np.unique(np.concatenate(rest), return_inverse=True)
        total = np.bincount(number, np.concatenate(docs), len(known))
        found = ((total > 1).astype(np.uint8) + (total > HOT))[number]
        cuts = np.cumsum([len(x) for x in rest])[:-1]
        return pa.table({"g": table.column("g"), "owner": table.column("owner"), "found": pa.array([squeeze(x) for x in np.split(found, cuts)], pa.binary())})

    dealt = packed.select("g", "doc_ids", "lengths", "texts", "anchors").mapInArrow(deal, PARCEL)
    return dealt.groupBy("owner").applyInArrow(meet, "g long, owner int, found binary")


def _window_owner(rows: np.ndarray, n: int) -> np.ndarray:
    return (keys(np.ascontiguousarray(rows[:, KEY:SPAN]).ravel(), np.arange(len(rows)) * KEY) % np.uint64(n)).astype(np.int64)


def _string_owner(strings: np.ndarray, n: int) -> np.ndarray:
    flat = np.ascontiguousarray(strings).ravel()
    at = np.arange(len(strings)) * SPAN
    return ((keys(flat, at) ^ keys(flat, at + KEY) * MIX[3]) % np.uint64(n)).astype(np.int64) if len(strings) else np.zeros(0, np.int64)


class Asked:
    """What a chunk asks the owners in the second round, in the same order whenever it is worked out."""

    def __init__(self, chunk: Chunk, found: bytes, n: int) -> None:
        *_, number = chunk.records(n)
        self.chunk, kind = chunk, found[number] if len(found) else np.zeros(0, np.uint8)
        self.chosen = np.flatnonzero(kind == 1)
        rows, ids, self.number = chunk.windows(self.chosen)
        to = _window_owner(rows, n) if len(rows) else np.zeros(0, np.int64)
        self.order = np.argsort(to, kind="stable")
        self.to, self.rows, self.ids = to[self.order], rows[self.order], ids[self.order]
        # hot anchors: their strings
        self.hot = np.flatnonzero(kind == 2)
        wide, wide_ids, self.hot_number = chunk.windows(self.hot)
        strings, string_ids, self.string_of = [], [], np.full((len(wide), KEY + 1), -1, np.int64)
        total = 0
        for extension in range(KEY + 1):
            valid = np.flatnonzero((wide[:, -2] >= extension) & (wide[:, -1] >= KEY - extension))
            own, least, which = distinct(np.ascontiguousarray(wide[valid, KEY - extension : KEY - extension + SPAN]), wide_ids[valid])
            self.string_of[valid, extension] = which + total
            strings.append(own)
            string_ids.append(least)
            total += len(own)
        strings, string_ids = np.concatenate(strings), np.concatenate(string_ids)
        to = _string_owner(strings, n)
        self.hot_order = np.argsort(to, kind="stable")
        self.hot_to, self.hot_rows, self.hot_ids = to[self.hot_order], strings[self.hot_order], string_ids[self.hot_order]

    def removed(self, masks: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Which bytes of the chunk go. masks, flags: the owners' answers in the order of rows and hot_rows."""
        chunk, start = self.chunk, np.zeros(len(self.chunk.data), bool)
        by_row, least = np.empty(len(masks), np.uint32), np.empty(len(masks), np.int64)
        by_row[self.order], least[self.order] = masks, self.ids
        at, ids = chunk.places[self.chosen], chunk.ids[chunk.owner[self.chosen]]
        own = by_row[self.number]
        # a window that a smaller id in this chunk has: all its strings go that are wholly in the document
        low = np.minimum(KEY, at - chunk.bounds[chunk.owner[self.chosen]])
        high = np.minimum(KEY, chunk.bounds[chunk.owner[self.chosen] + 1] - at - KEY)
        later = ids > least[self.number]
        flag, string_least = np.empty(len(flags), bool), np.empty(len(flags), np.int64)
        flag[self.hot_order], string_least[self.hot_order] = flags, self.hot_ids
        hot_at, hot_ids = chunk.places[self.hot], chunk.ids[chunk.owner[self.hot]]
        for extension in range(KEY + 1):
            go = (own >> np.uint32(extension) & np.uint32(1)).astype(bool) | later & (low >= extension) & (high >= KEY - extension)
            start[at[go] - extension] = True
            which = self.string_of[self.hot_number, extension] if len(self.hot) else np.zeros(0, np.int64)
            some = which >= 0
            go = np.zeros(len(which), bool)
            go[some] = flag[which[some]] | (hot_ids[some] > string_least[which[some]])
            start[hot_at[go] - extension] = True
        so_far = np.cumsum(start, dtype=np.int32)
        so_far[SPAN:] -= so_far[:-SPAN].copy()
        return so_far > 0


def _found(table: pa.Table) -> np.ndarray:
    parts = sorted(zip(table.column("owner").to_pylist(), table.column("found").to_pylist(), strict=True))
    return np.concatenate([expand(x, "u1") for _, x in parts]) if parts else np.zeros(0, np.uint8)


def answers(packed: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """g, owner, hot, answer: for each parcel of windows their masks, of strings whether a smaller id has them."""

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            asked = Asked(Chunk(row), _found(right), n)
            out += _parcels(asked.chunk, False, asked.to, asked.ids, asked.rows)
            out += _parcels(asked.chunk, True, asked.hot_to, asked.hot_ids, asked.hot_rows)
        return pa.Table.from_batches(out) if out else EMPTY

    def meet(table: pa.Table) -> pa.Table:
        out = {"g": [], "owner": [], "hot": [], "answer": []}
        for hot in (False, True):
            own = table.filter(pc.equal(table.column("hot"), hot))
            if not own.num_rows:
                continue
            ids = [expand(x, "<i8") for x in own.column("ids").to_pylist()]
            width = SPAN if hot else SPAN + KEY + 2
            rows = np.concatenate([expand(x, "u1").reshape(-1, width) for x in own.column("rows").to_pylist()])
            joined = np.concatenate(ids)
            if hot:
                _, least, number = distinct(rows, joined)
                answer = (joined > least[number]).astype(np.uint8)
            else:
                answer = repeated(rows, joined).astype("<u4")
            for column in ("g", "owner", "hot"):
                out[column] += own.column(column).to_pylist()
            out["answer"] += [squeeze(x) for x in np.split(answer, np.cumsum([len(x) for x in ids])[:-1])]
        return pa.table({"g": pa.array(out["g"], pa.int64()), "owner": pa.array(out["owner"], pa.int32()), "hot": pa.array(out["hot"], pa.bool_()), "answer": pa.array(out["answer"], pa.binary())})

    a = packed.select("g", "doc_ids", "lengths", "texts", "anchors")
    dealt = a.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(deal, PARCEL)
    return dealt.groupBy("owner").applyInArrow(meet, "g long, owner int, hot boolean, answer binary")


EMPTY = pa.table({"owner": pa.array([], pa.int32()), "g": pa.array([], pa.int64()), "hot": pa.array([], pa.bool_()), "ids": pa.array([], pa.binary()), "rows": pa.array([], pa.binary())})


def finished(packed: DataFrame, found: DataFrame, answered: DataFrame, n: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for every document."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, past: long>>"
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("past", pa.int64())]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for row in left.to_pylist():
            first = right.filter(pc.is_null(right.column("hot")))
            asked = Asked(chunk := Chunk(row), _found(first.rename_columns(["g", "owner", "hot", "found"])), n)
            parts = {hot: sorted((r["owner"], r["found"]) for r in right.to_pylist() if r["hot"] is hot) for hot in (False, True)}
            masks = np.concatenate([np.zeros(0, np.uint32), *(expand(x, "<u4") for _, x in parts[False])])
            flags = np.concatenate([np.zeros(0, np.uint8), *(expand(x, "u1") for _, x in parts[True])]).astype(bool)
            gone = asked.removed(masks, flags)
            for i, doc in enumerate(chunk.doc_ids):
                a, b = chunk.bounds[i], chunk.bounds[i + 1]
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2)
                out["doc_id"].append(doc)
                out["n_bytes"].append(int(b - a))
                out["n_removed"].append(int(own.sum()))
                out["n_spans"].append(len(edges))
                out["kept_sha256"].append(hashlib.sha256(chunk.data[a:b][~own] if len(edges) else chunk.data[a:b]).hexdigest())
                out["spans"].append([{"start": int(s), "past": int(p)} for s, p in edges])
        return pa.table({k: pa.array(v, spans_type if k == "spans" else pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})

    a = packed.select("g", "doc_ids", "lengths", "texts", "anchors")
    said = found.select("g", "owner", F.lit(None).cast("boolean").alias("hot"), "found").unionByName(answered.select("g", "owner", "hot", F.col("answer").alias("found")))
    return a.groupBy("g").cogroup(said.groupBy("g")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed bytes)."""
    spark = docs.sparkSession
    packed, _ = save(pack(docs), "repeat-chunks")
    n_anchors = packed.agg(F.sum("n_anchors")).head()[0] or 0
    n = max(spread(spark), -(-n_anchors // 2_000_000))
    found, _ = save(repeated_anchors(packed, n), "repeat-anchors")
    release(spark)
    answered, _ = save(answers(packed, found, n), "repeat-answers")
    release(spark)
    return finished(packed, found, answered, n)

