"""Media payloads in a content-addressed chunk store.

A payload is cut where a rolling gear hash has its low bits zero, between MIN_CHUNK and MAX_CHUNK bytes, so equal
stretches give equal chunks wherever they stand. Chunks are known by digest; Spark counts digests and so finds those that
stand in more than one document. Every payload is stored alike: `payloads` has a row for each document with its manifest
(magic, number of chunks, length and digest of each), the chunks that are its own as 8-bit samples, and the ordered digests
of the others; `chunks` has one row for each digest that documents share. So only shared chunks meet a shuffle. Workers know
a shared digest by a bitmap whose size follows the number of shared digests up to MOST_BITS: a false hit only puts a chunk
into `chunks` that could have stayed with its payload. Samples that are shuffled travel as zstandard frames.

A shared chunk is sent by one document, which the counting elects; a bitmap of the elected tells workers, and a false hit
only sends a chunk again.

Reading back joins the ordered digests with the chunks, puts both kinds in the manifest's order, and checks every digest
and that of the payload. The stored form of a payload is its manifest as read, followed by its samples as read.

Defined results: null text is an empty payload and is padded to one unit; equal texts have equal values and share all their
chunks; repeated rows and null doc_ids keep their rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, shared_folder, stage, utf8_of

UNIT, PAD = 576, b"\xff"
MIN_CHUNK, MAX_CHUNK = 512, 8192
#: Low bits of the gear hash that are zero at a cut: one in 2048 positions.
CUT_MASK = np.uint32(0x7FF)
WINDOW = 32
#: Least and most bits of the bitmap of shared digests, and bits for each of them: 32 MB are broadcast at most.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 28, 16
#: Compression of samples on their way.
LEVEL = 9
_BUCKET = 32768  # bits of a row of bitmap_construct_agg
MAGIC = b"CDC1"

#: Gear table: a 32-bit value for each byte, from its digest.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)


def payload_of(utf8: bytes) -> bytes:
    return utf8 + PAD * ((-len(utf8) % UNIT) or (0 if utf8 else UNIT))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the WINDOW bytes that end at each position: h[i] = 2 h[i-1] + GEAR[b[i]] mod 2**32, by doubling."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step)
        h = h + older
        step *= 2
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Chunk ends of each payload. The window is shorter than MIN_CHUNK, so payloads can be hashed in one array."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    spots = (np.flatnonzero((gear_hashes(joined) & CUT_MASK) == 0) + 1).tolist()
    out, base, k = [], 0, 0
    for p in payloads:
        end, at, ends = base + len(p), base, []
        while at < end:
            low, high = at + MIN_CHUNK, min(at + MAX_CHUNK, end)
            while k < len(spots) and spots[k] < low:
                k += 1
            at = spots[k] if k < len(spots) and spots[k] < high else high
            ends.append(at - base)
        out.append(ends)
        base = end
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def manifest(lengths: list[int], digests: list[bytes]) -> bytes:
    return b"".join([MAGIC, len(lengths).to_bytes(4, "little"), *[n.to_bytes(4, "little") + d for n, d in zip(lengths, digests)]])


def read_manifest(head: bytes) -> tuple[list[int], list[bytes]]:
    """Lengths and digests of a manifest."""
    if head[:4] != MAGIC or len(head) != 8 + 20 * int.from_bytes(head[4:8], "little"):
        raise ValueError("not a manifest")
    rows = [head[i : i + 20] for i in range(8, len(head), 20)]
    return [int.from_bytes(x[:4], "little") for x in rows], [x[4:] for x in rows]


def chunked(payloads: list[bytes]) -> list[list[bytes]]:
    return [[p[i:j] for i, j in zip([0, *e], e)] for p, e in zip(payloads, cuts(payloads))]


RESULT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _result(key: bytes, head: bytes, parts: list[bytes]) -> tuple:
    """Verified values of one payload that was read back."""
    lengths, digests = read_manifest(head)
    payload = b"".join(parts)
    if digest_of(payload) != key or [digest_of(p) for p in parts] != digests or [*map(len, parts)] != lengths:
        raise ValueError(f"stored media of payload {key.hex()} is damaged")
    samples = np.frombuffer(payload, np.uint8)
    feature = f"chunks={len(parts)};mean={samples.mean():.4f};rms={np.sqrt(np.square(samples, dtype=np.float64).mean()):.4f}"
    feature += f";turns={int(np.count_nonzero(np.diff(samples >= 128)))}"
    both = hashlib.sha256(head)
    both.update(payload)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(head) + len(payload), both.hexdigest(), feature


def _results(out: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]


_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _elector(doc_id: int | None, key: bytes) -> int:
    """What stands for a document when one is elected to send a chunk."""
    return int.from_bytes(hashlib.blake2b(repr(doc_id).encode() + key, digest_size=7).digest(), "big")


def counted_digests(rows: DataFrame, folder: str) -> DataFrame:
    """rows(doc_id, text binary) -> (digest, refs, sender): all chunks with the number of documents that have them and the least
    elector among those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            payloads = [payload_of(t) for t in b.column("text").to_pylist()]
            found, by = [], []
            for doc_id, p, parts in zip(b.column("doc_id").to_pylist(), payloads, chunked(payloads)):
                own = {digest_of(x) for x in parts}
                found += own
                by += [_elector(doc_id, digest_of(p))] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(by, pa.int64())], names=["digest", "by"])

    each = rows.select("doc_id", "text").mapInArrow(run, "digest binary, by long").groupBy("digest")
    return stage(each.agg(F.count("*").alias("refs"), F.min("by").alias("sender")), folder, "digests")


def bitmap_of(spots: DataFrame, bits: int) -> bytes:
    """Bitmap of the numbers spot modulo bits: at most MOST_BITS / 32768 rows of 4 KB come to the driver."""
    each = spots.select((F.pmod("spot", F.lit(bits).cast("long")) + 1).alias("bit")).distinct()  # buckets of numbers above 0 count from 1
    rows = each.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("x"))
    out = bytearray(-(-bits // 8) + _BUCKET // 8)
    for r in rows.collect():
        at = (r["k"] - 1) * (_BUCKET // 8)
        out[at : at + _BUCKET // 8] = bytes(r["x"])
    return bytes(out)


def _mapped(df: DataFrame, column: str, f: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """df with a binary column put through a function that is made in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = f()
        for b in batches:
            at = b.schema.get_field_index(column)
            yield b.set_column(at, column, pa.array([g(x) for x in b.column(at).to_pylist()], pa.binary()))

    return df.mapInArrow(run, df.schema)


def framed(df: DataFrame, column: str) -> DataFrame:
    return _mapped(df, column, lambda: zstandard.ZstdCompressor(level=LEVEL).compress)


def unframed(df: DataFrame, column: str) -> DataFrame:
    return _mapped(df, column, lambda: zstandard.ZstdDecompressor().decompress)


def store(docs: DataFrame, folder: str) -> None:
    """Write `payloads` and `chunks` of docs(doc_id, text) below folder."""
    rows = docs.select(F.col("doc_id").cast("long"), utf8_of().alias("text"))
    counted = counted_digests(rows, folder)
    shared = counted.where("refs > 1")
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * shared.count()):
        bits *= 2
    number = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(bitmap_of(shared.select(number.alias("spot")), bits))

    def hit(bitmap: bytes, number: int) -> bool:
        k = number % bits
        return bool(bitmap[k >> 3] >> (k & 7) & 1)

    def is_shared(digest: bytes) -> bool:
        return hit(known.value, int.from_bytes(digest[:7], "big"))

    def electors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the digests that workers take for shared, those that only one document has included."""
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([s for d, s in zip(*[c.to_pylist() for c in b.columns]) if is_shared(d)], pa.int64())], names=["spot"])

    elected = spark.sparkContext.broadcast(bitmap_of(counted.select("digest", "sender").mapInArrow(electors, "spot long"), bits))

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            texts = b.column("text").to_pylist()
            whole = [payload_of(t) for t in texts]
            cols: list[list] = [[], [], [], []]
            for p, parts in zip(whole, chunked(whole)):
                digests = [digest_of(x) for x in parts]
                common = [is_shared(d) for d in digests]
                cols[0].append(digest_of(p))
                cols[1].append(manifest([*map(len, parts)], digests))
                cols[2].append(b"".join([x for x, c in zip(parts, common) if not c]))
                cols[3].append([(i, d) for i, (d, c) in enumerate(zip(digests, common)) if c])
            refs = pa.array([[{"at": i, "digest": d} for i, d in x] for x in cols[3]], pa.list_(pa.struct([("at", pa.int32()), ("digest", pa.binary())])))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), refs],
                names=["doc_id", "n_bytes", "key", "manifest", "own", "refs"],
            )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            payloads = [payload_of(t) for t in b.column("text").to_pylist()]
            senders = [p for i, p in zip(b.column("doc_id").to_pylist(), payloads) if hit(elected.value, _elector(i, digest_of(p)))]
            parts = {d: x for ps in chunked(senders) for x in ps if is_shared(d := digest_of(x))}
            frames = map(zstandard.ZstdCompressor(level=LEVEL).compress, parts.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.binary()), pa.array(list(frames), pa.binary())], names=["digest", "samples"])

    schema = "doc_id long, n_bytes long, key binary, manifest binary, own binary, refs array<struct<at:int,digest:binary>>"
    rows.mapInArrow(payloads, schema).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    once = rows.mapInArrow(chunks, "digest binary, samples binary").groupBy("digest").agg(F.first("samples").alias("samples"))
    unframed(once, "samples").write.option("compression", "zstd").parquet(f"{folder}/chunks")


def read(spark, folder: str) -> DataFrame:
    """The media of all documents of a store: doc_id, n_bytes and RESULT."""
    rows = spark.read.parquet(f"{folder}/payloads")
    chunks = spark.read.parquet(f"{folder}/chunks")

    def placed(head: bytes, own: bytes, others: dict[int, bytes]) -> list[bytes]:
        """The chunks in the manifest's order."""
        out, at = [], 0
        for i, n in enumerate(read_manifest(head)[0]):
            if i in others:
                out.append(others[i])
            else:
                out.append(own[at : at + n])
                at += n
        return out

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "own"):
            found = [_result(key, head, placed(head, own, {})) for key, head, own in zip(*[b.column(c).to_pylist() for c in ("key", "manifest", "own")])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *_results(found)], names=["doc_id", "n_bytes", *_NAMES])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            found, keys = [], b.column("key")
            for key, head, own, n, parts in zip(*[b.column(c).to_pylist() for c in ("key", "manifest", "own", "n", "parts")]):
                others = {x["at"]: open_(x["samples"]) for x in parts}
                if len(others) != n:
                    raise ValueError(f"{n - len(others)} chunks of payload {key.hex()} are missing")
                found.append(_result(key, head, placed(head, open_(own), others)))
            yield pa.RecordBatch.from_arrays([keys, *_results(found)], names=["key", *_NAMES])

    solo = rows.where(F.size("refs") == 0).select("doc_id", "n_bytes", "key", "manifest", "own").mapInArrow(alone, f"doc_id long, n_bytes long, {RESULT}")
    linked = rows.where(F.size("refs") > 0)
    refs = linked.groupBy("key").agg(F.first("refs").alias("refs")).select("key", F.inline("refs"))
    # a payload with samples of its own is the only one of its text
    packed = framed(linked.select("key", "manifest", "own", F.size("refs").alias("n")), "own")
    each = packed.groupBy("key").agg(*[F.first(c).alias(c) for c in ("manifest", "own", "n")])
    parts = refs.join(framed(chunks, "samples"), "digest").groupBy("key").agg(F.collect_list(F.struct("at", "samples")).alias("parts"))
    # a chunk that the store lacks leaves its payload without it: found out by the number of parts
    whole = each.join(parts, "key", "left")
    whole = whole.withColumn("parts", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)))
    media = whole.select("key", "manifest", "own", "n", "parts").mapInArrow(together, f"key binary, {RESULT}")
    joined = linked.select("doc_id", "n_bytes", "key").join(media, "key")
    return solo.unionByName(joined.select("doc_id", "n_bytes", *_NAMES))


def media(docs: DataFrame) -> DataFrame:
    folder = shared_folder(docs.sparkSession)
    store(docs, folder)
    return read(docs.sparkSession, folder)
