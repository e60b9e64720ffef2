"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint maps to the vector of bit counts of its 2-bit segments. The Manhattan
distance of two vectors never exceeds the Hamming distance of the fingerprints, so a range join of
the vectors loses no link: with the segments in two halves, a pair within MAX_BITS = 4 has one half
within Manhattan distance 2, and two grid points within 2 have a common grid point within 1 of both.
Each fingerprint is therefore listed in the cells within 1 of its two half vectors, cells meet in
one sort-based exchange, and the exact Hamming distance decides.

Defined results: null or word-less text has fingerprint 0 and links like any other; rows with a
null doc_id keep their row, their component is the smallest known doc_id or null; rows of one doc_id
with different texts are judged each by its own text; repeated rows stay repeated; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, join_hot, shared_folder, stage, utf8_of
from .graph import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Cells with more fingerprints than this are searched breadth first instead of by shifted comparison: the same links, and
#: memory linear in the cell. The search takes a comparison of each fingerprint reached with the rest.
SMALL_CELL = 48

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FIELDS = 0x5555555555555555


def fingerprint(text: bytes) -> int:
    """Fingerprint of one text, unsigned."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    counts = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _digest() -> Column:
    """128 bits that tell rows apart by doc_id and text; never null, so that a join and a removal of repeated rows share one exchange."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), F.lit(":").cast("binary"), utf8_of()))


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long); one row for each input row. digest: with h, the digest of the row."""
    stay = ["doc_id", "h"] if digest else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in stay], pa.array(fps)], names=[*stay, "fp"])

    cols = [F.col("doc_id").cast("long"), *([_digest().alias("h")] if digest else []), utf8_of().alias("text")]
    return docs.select(*cols).mapInArrow(run, "doc_id long, " + "h string, " * digest + "fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """The 32 segment counts of each fingerprint, packed in 2-bit fields of a uint64."""
    x = fps.astype(np.uint64)
    return x - ((x >> np.uint64(1)) & np.uint64(_FIELDS))


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell key) of the grid cells within Manhattan distance 1 of both half vectors."""
    v = embed(fps)
    rows, keys = [], []
    every = np.arange(len(fps))
    for half in range(2):
        part = (v >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half << 32)
        rows.append(every)
        keys.append(part | tag)
        for s in range(0, 32, 2):
            field = (part >> np.uint64(s)) & np.uint64(3)
            for step in (1, -1):
                ok = np.flatnonzero(field < 2 if step > 0 else field > 0)
                rows.append(ok)
                moved = part[ok] + np.uint64(1 << s) if step > 0 else part[ok] - np.uint64(1 << s)
                keys.append(moved | tag)
    return np.concatenate(rows), np.concatenate(keys)


def _tree_of_cell(fp: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among the fingerprints of one cell: breadth first, memory linear in the cell."""
    rest, out = fp.copy(), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                out += [(x, y) for y in found]
                queue += list(found)
    return out


def _forest(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of the edge list, so that what leaves a task grows with its fingerprints."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.uint64).reshape(-1, 2)


def links_of_cells(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links within whole cells; key is sorted. Rows of the result are pairs of fingerprints."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(start, len(key)))
    found = []
    for i in np.flatnonzero(count > SMALL_CELL):
        found.append(np.array(_tree_of_cell(np.unique(fp[start[i] : start[i] + count[i]])), np.uint64).reshape(-1, 2))
    small = np.repeat((count > 1) & (count <= SMALL_CELL), count)
    k, f = key[small], fp[small]
    for d in range(1, SMALL_CELL):
        if d >= len(k):
            break
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        a, b = f[same], f[same + d]
        near = np.bitwise_count(a ^ b) <= MAX_BITS
        found.append(np.stack([a[near], b[near]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return _forest(np.unique(np.sort(pairs, axis=1), axis=0))


def links(fps: DataFrame) -> DataFrame:
    """fps(fp long, distinct) -> (a long, b long): links that connect every pair within MAX_BITS."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                fp = b.slice(i, 20_000).column(0).to_numpy(zero_copy_only=False)
                rows, keys = cells_of(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[rows])], names=["cell", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last cell, which the next batch may go on with

        def both() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])

        for b in batches:
            if not b.num_rows:
                continue
            key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held.append((key, fp))
            if held[0][0][0] == key[-1]:
                continue
            key, fp = both()
            whole = int(np.searchsorted(key, key[-1]))
            yield out(links_of_cells(key[:whole], fp[:whole].view(np.uint64)))
            held = [(key[whole:], fp[whole:])]
        if held:
            key, fp = both()
            yield out(links_of_cells(key, fp.view(np.uint64)))

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        two = pairs.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=["a", "b"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        fps.select("fp")
        .mapInArrow(spread, "cell long, fp long")
        .repartition(n, "cell")
        .sortWithinPartitions("cell", "fp")
        .mapInArrow(meet, "a long, b long")
        .distinct()
    )


def _linked(own: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """own(doc_id, fp) -> each(fp, least), one row for each fingerprint, and rooted(fp, root) of those that have a link."""
    each = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "each")
    roots = connected_components(links(each), folder)
    return each, stage(roots.select(F.col("node").alias("fp"), "root"), folder, "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id long, fp long, component_id long), one row for each input row."""
    folder = shared_folder(docs.sparkSession)
    own = stage(fingerprints(docs), folder, "fps")
    each, rooted = _linked(own, folder)
    linked = stage(each.join(rooted, "fp"), folder, "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # a component may hold most of the linked fingerprints
    named = join_hot(linked.select("fp", "root"), least, ["root"], F.xxhash64("fp")).select("fp", "component_id")
    every = each.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return own.join(every, "fp").select("doc_id", "fp", "component_id")


def unique_documents(docs: DataFrame) -> DataFrame:
    """One document of each group stays, with all its columns: the one of the smallest doc_id, null last, and among the
    rows of that doc_id the one of the smallest digest. Rows of one doc_id whose texts aren't near-duplicates stay each in
    its own group; of rows that repeat a doc_id and text one stays."""
    folder = shared_folder(docs.sparkSession)
    own = stage(fingerprints(docs, digest=True), folder, "fps")
    _, rooted = _linked(own, folder)
    row = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    first = stage(own.groupBy("fp").agg(F.min(row).alias("row")), folder, "first")
    # what has no link is its own group
    kept = first.join(rooted, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row"))
    chosen = docs.withColumn("__h", _digest()).join(kept.select(F.col("row.h").alias("__h")), "__h", "left_semi")
    return chosen.dropDuplicates(["__h"]).select(*docs.columns)
