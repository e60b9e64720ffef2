"""Token ids in fixed-width bit-packed blocks.

File format: Parquet rows, one for each block: `part` and `block` order the blocks by document id, `first`
is the number of ids of the part before the block, `doc_ids` and `ends` (ids up to the end of each document)
give random access, `width` the bits of an id and `packed` the ids, most significant bit first, without gaps:
id k of a block is in bits k*width to (k+1)*width. Width is the least that holds the vocabulary.

Defined results: null or empty text holds the end id alone; null doc_id sorts first; rows that share a
doc_id follow each other by text; an empty table gives no blocks and an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BLOCK, PieceTable, Pieces
from .common import blocks, text_of

#: Ids of a block at which it is closed.
BLOCK_IDS = 1 << 18
#: Pieces that are encoded as one text.
JOINT = 400


def width_for(vocabulary: int) -> int:
    """Bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):  # whole bytes: the same layout without the detour over single bits
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def unpack(packed: bytes, width: int, count: int, first: int = 0) -> np.ndarray:
    """Ids first to first + count of a block, read from their own bytes alone."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f">u{width // 8}", count, first * width // 8).astype("<u4")
    at = first * width
    part = np.frombuffer(packed, np.uint8)[at // 8 : -(-(at + count * width) // 8)]
    bits = np.unpackbits(part)[at % 8 : at % 8 + count * width].reshape(count, width)
    wide = np.concatenate([np.zeros((count, 32 - width), np.uint8), bits], axis=1)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


class LibraryEncoder:
    """The tokenizers library behind a cache of blank-led pieces; see bpe.Encoder for where that is exact."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = PieceTable()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = r"^(?:$|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}])" + "".join("|" + re.escape(x) for x in added)
        first = np.zeros(self.vocabulary, bool)  # tokens that begin with a blank, which byte-level vocabularies write as U+0120
        for token, at in self.tokenizer.get_vocab(with_added_tokens=False).items():
            first[at] = token.startswith("\u0120")
        self.blank_first = first

    def _call(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, names: pa.Array) -> pa.Array:
        """Pieces are encoded many to a text: each begins with the only blank it has, so the ids part again at the tokens
        that begin with a blank. Pieces that are empty, begin with white space or hold an added token are encoded alone."""
        odd = pc.match_substring_regex(names, self.odd)
        places = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        some = names.take(pa.array(places)).to_pylist()
        texts = [" " + " ".join(some[i : i + JOINT]) for i in range(0, len(some), JOINT)]
        flat, ends, order = [], [], []
        for k, ids in enumerate(self._call(texts)):
            own = places[k * JOINT : (k + 1) * JOINT]
            starts = np.flatnonzero(self.blank_first[np.frombuffer(ids, "<u4")])
            if len(starts) != len(own) or starts[0]:
                alone += own.tolist()
                continue
            flat.append(ids)
            ends.append(np.diff(np.append(starts, len(ids) // 4)))
            order.append(own)
        single = self._call([" " + x for x in names.take(pa.array(alone, pa.int64())).to_pylist()])
        flat += single
        ends.append(np.array([len(x) // 4 for x in single], np.int64))
        order.append(np.array(alone, np.int64))
        offsets = np.concatenate([[0], np.cumsum(4 * np.concatenate(ends))]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(flat))])
        return found.take(pa.array(np.argsort(np.concatenate(order))))

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the places where texts begin and end."""
        cut = Pieces(texts)
        return cut.encoded(self.pieces, self._learn, self._call(cut.heads))

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode_block(pa.array(texts, pa.string()))
        return [ids[i:j].tobytes() for i, j in zip(ends, ends[1:])]


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_blocks(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> None:
    """Encode docs(doc_id, text), append end_id to each, write blocks in ascending doc_id order below folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(tokenizer)
        width = width_for(max(enc.vocabulary, end_id + 1))
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []  # ids of whole documents with their end ids
        docs_held: list = []
        ends_held: list[int] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([block], pa.int64()),
                    "first": pa.array([first], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "width": pa.array([width], pa.int32()),
                    "doc_ids": pa.array([docs_held], pa.list_(pa.int64())),
                    "ends": pa.array([ends_held], pa.list_(pa.int64())),
                    "packed": pa.array([pack(ids, width)], pa.binary()),
                }
            )

        for b in blocks(batches, "text", BLOCK):
            ids, ends = enc.encode_block(b.column("text"))
            ids = np.insert(ids, ends[1:], end_id)  # after each document
            ends = ends + np.arange(len(ends))
            names, i = b.column("doc_id").to_pylist(), 0
            while i < len(names):
                base = ends_held[-1] if ends_held else 0
                j = min(len(names), int(np.searchsorted(ends, ends[i] + BLOCK_IDS - base)))  # the document that fills the block is its last
                j = max(j, i + 1)
                held.append(ids[ends[i] : ends[j]])
                docs_held += names[i:j]
                ends_held += (ends[i + 1 : j + 1] - ends[i] + base).tolist()
                i = j
                if ends_held[-1] >= BLOCK_IDS:
                    yield close()
                    block, first, held, docs_held, ends_held = block + 1, first + ends_held[-1], [], [], []
        if held:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, block long, first long, n_ids long, width int, doc_ids array<long>, ends array<long>, packed binary"
    ordered.mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(folder)
    each = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each written part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ends = np.array(r["ends"], np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                ids = unpack(r["packed"], r["width"], int(ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(starts + r["start"]),
                        pa.array(ends - starts),
                        pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts, ends)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # one row for each part: bounded by the number of partitions of the writing job
    placed = files.join(F.broadcast(base), "part").select(
        (F.col("base") + F.col("first")).alias("start"), "width", "doc_ids", "ends", "packed"
    )
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
