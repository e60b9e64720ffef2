"""Byte-level BPE by corpus-level merge replay.

An inverted index leads from the rank of a token pair to the word positions where the pair stands; ranks are taken in
ascending order from a heap, each merge is applied at all its positions at once, and only the two neighbours of a merged
position enter the index again. The corpus's most frequent words (VOCABULARY at most, counted by Spark over all texts)
are replayed together, once, and their ids are broadcast; rarer words are replayed where they stand, once for a worker
while they stay in its bounded cache. Neither bound changes a result. Texts meet no shuffle.

Defined results: null or empty text has no ids; lone or repeated rows are encoded row by row; texts of
any length are encoded whole; rows keep their doc_id, null included; an empty table gives an empty table; a column of keep named as one of the result's
own columns gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, stage, text_of

#: Entries of a worker's caches of pieces and of words; the latter has two generations.
CACHE, WORDS = 600_000, 60_000

#: Most words whose ids are broadcast, and the longest of them in bytes: some 10 MB.
VOCABULARY, LONGEST = 200_000, 48
#: Longest word in bytes that is swept; longer ones go by the index of lists, whose cost doesn't grow with the square of a word.
SHORT, NO_MERGE = 40, np.int32(2**31 - 1)
#: Bytes of text that are cut into pieces together.
BLOCK = 4_000_000

#: A blank before further white space: there the next blank-free piece depends on what precedes it.
_TANGLED = r" [\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}


class PairRanks(dict):
    """Rank of the merge of two tokens (left << 20 | right), -1 if there is none; filled as pairs are met."""

    def __init__(self, ranks: dict[bytes, int], tokens: list[bytes]) -> None:
        super().__init__()
        self.rank_of, self.tokens = ranks.get, tokens

    def __missing__(self, key: int) -> int:
        rank = self[key] = self.rank_of(self.tokens[key >> 20] + self.tokens[key & 0xFFFFF], -1)
        return rank

    def trim(self) -> None:
        if len(self) > 100_000:
            self.clear()


class MergeReplay:
    """Applies the merges of a rank table to many words together, in rank order."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs = PairRanks(ranks, self.tokens)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of tokens that merges (left << 20 | right), ascending, and its rank."""
        keys, ranks, of = array("q"), array("i"), self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := of(token[:i])) is not None and (b := of(token[i:])) is not None:
                    keys.append(a << 20 | b)
                    ranks.append(rank)
        order = np.argsort(np.frombuffer(keys, np.int64), kind="stable")
        return np.append(np.frombuffer(keys, np.int64)[order], 1 << 62), np.append(np.frombuffer(ranks, np.int32)[order], NO_MERGE)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks = self.table
        want = (left.astype(np.int64) << 20) | right
        at = np.searchsorted(keys, want)
        return np.where(keys[at] == want, ranks[at], NO_MERGE)

    def encode(self, words: Iterable[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32; words must be distinct for the index to pay, not for the result."""
        words = list(words)
        out: list[bytes] = [b""] * len(words)
        by_length: defaultdict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                by_length[len(w) if len(w) <= SHORT else 0].append(i)
        for n, places in by_length.items():
            found = self.swept([words[i] for i in places], n) if n else self.indexed([words[i] for i in places])
            for i, ids in zip(places, found):
                out[i] = ids
        return out

    def swept(self, words: list[bytes], n: int) -> list[bytes]:
        """Words of n bytes each: the index of their pairs is an array of ranks. In a sweep every word applies the merge of its
        lowest rank, the leftmost of equal ones, and only the two neighbours of the merged position are ranked anew."""
        out: list[bytes] = [b""] * len(words)
        rows = np.arange(len(words))
        tok = np.array(self.single, np.int32)[np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)]
        rank = self._rank(tok[:, :-1], tok[:, 1:])
        while len(rows):
            cols = tok.shape[1]
            at = rank.argmin(1) if cols > 1 else np.zeros(len(rows), int)
            best = rank[np.arange(len(rows)), at] if cols > 1 else np.full(len(rows), NO_MERGE, np.int32)
            if (done := best == NO_MERGE).any():
                data = tok[done].astype("<u4").tobytes()
                for k, i in enumerate(rows[done].tolist()):
                    out[i] = data[4 * cols * k : 4 * cols * (k + 1)]
                rows, tok, rank, at, best = rows[~done], tok[~done], rank[~done], at[~done], best[~done]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            tok[every, at] = best
            stay = np.ones(tok.shape, bool)
            stay[every, at + 1] = False
            tok = tok[stay].reshape(len(rows), cols - 1)
            rank = rank[stay[:, 1:]].reshape(len(rows), cols - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < cols - 2)
            rank[left, at[left] - 1] = self._rank(tok[left, at[left] - 1], best[left])
            rank[right, at[right]] = self._rank(best[right], tok[right, at[right] + 1])
        return out

    def indexed(self, words: list[bytes]) -> list[bytes]:
        """Words of any length: the index leads from a rank to the positions of its pair in all words."""
        tok: list[int] = []
        prv: list[int] = []
        nxt: list[int] = []
        heads: list[int] = []
        index: defaultdict[int, list[int]] = defaultdict(list)
        pairs, single = self.pairs, self.single
        pairs.trim()
        for word in words:
            at = len(tok)
            heads.append(at)
            ids = [single[x] for x in word]
            last = at + len(ids) - 1
            tok += ids
            prv.append(-1)
            prv += range(at, last)
            nxt += range(at + 1, last + 1)
            nxt.append(-1)
            for i, a, b in zip(range(at, last), ids, ids[1:]):
                if (rank := pairs[a << 20 | b]) >= 0:
                    index[rank].append(i)
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank)
            places.sort()
            left = rank << 20
            for k, i in enumerate(places):
                j = nxt[i]
                if j < 0 or (a := tok[i]) < 0 or pairs[a << 20 | tok[j]] != rank:
                    continue
                tok[i], tok[j] = rank, -1
                after, before, least = nxt[j], prv[i], rank
                nxt[i] = after
                if before >= 0 and (r := pairs[tok[before] << 20 | rank]) >= 0:
                    if not (there := index[r]):
                        heappush(heap, r)
                    there.append(before)
                    if r < least:
                        least = r
                if after >= 0:
                    prv[after] = i
                    if (r := pairs[left | tok[after]]) >= 0:
                        if not (there := index[r]):
                            heappush(heap, r)
                        there.append(i)
                        if r < least:
                            least = r
                if least < rank and k + 1 < len(places):
                    index[rank] = places[k + 1 :]  # a pair of lower rank has come up: it goes first
                    heappush(heap, rank)
                    break
        out = []
        for i in heads:
            ids = []
            while i >= 0:
                if tok[i] >= 0:
                    ids.append(tok[i])
                i = nxt[i]
            out.append(np.array(ids, "<u4").tobytes())
        return out


class WordCache(dict):
    """Ids of words as little-endian uint32, two generations of bounded size."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Keys without an entry; entries of the older generation are brought forward."""
        if len(self) > WORDS:
            self.old = dict(self)
            self.clear()
        lack = []
        for k in keys - self.keys():
            if (v := self.old.get(k)) is None:
                lack.append(k)
            else:
                self[k] = v
        return lack


class PieceTable:
    """Blank-led pieces and their ids as Arrow columns. Beyond CACHE entries those go that no block has used since the last
    time; the first `fixed` ones stay."""

    def __init__(self, names: pa.Array | None = None, ids: pa.Array | None = None) -> None:
        self.names = pa.array([], pa.large_string()) if names is None else names
        self.ids = pa.array([], pa.large_binary()) if ids is None else ids
        self.fixed = len(self.names)
        self.used = np.zeros(self.fixed, bool)

    def places(self, names: pa.Array) -> np.ndarray:
        """Row of each name, -1 where it has none."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False)
        self.used[at[at >= 0]] = True
        return at

    def add(self, names: pa.Array, ids: pa.Array) -> None:
        self.names, self.ids = pa.concat_arrays([self.names, names]), pa.concat_arrays([self.ids, ids])
        self.used = np.concatenate([self.used, np.ones(len(names), bool)])
        if len(self.names) - self.fixed > CACHE:
            self.used[: self.fixed] = True
            stay = pa.array(np.flatnonzero(self.used))
            self.names, self.ids = self.names.take(stay), self.ids.take(stay)
            self.used = np.zeros(len(stay), bool)


class Pieces:
    """A block of texts, cut at blanks. A piece with its blank can be encoded by itself, which is exact unless a blank
    stands before more white space; texts that have such a place, and what stands before a text's first blank, are heads
    and encoded as they are."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        tangled = pc.match_substring_regex(texts, _TANGLED)
        cut = pc.split_pattern(pc.if_else(tangled, "", texts), " ")
        self.offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        self.names = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        starts = self.offsets[:-1]
        first = self.names.take(pa.array(codes[starts], pa.int32()))
        self.heads = pc.if_else(tangled, texts, first).to_pylist()
        led = np.ones(len(codes), bool)
        led[starts] = False
        self.counts = np.bincount(codes[led], minlength=len(self.names))
        self.used = np.flatnonzero(self.counts)
        place = np.zeros(len(self.names), np.int32)
        place[self.used] = np.arange(len(self.used), dtype=np.int32)
        self.order = place[codes]  # of pieces in use, then of heads
        self.order[starts] = len(self.used) + np.arange(len(starts), dtype=np.int32)

    def encoded(self, table: PieceTable, learn: Callable[[pa.Array], pa.Array], heads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the places where texts begin and end. learn: names to ids."""
        names = self.names.take(pa.array(self.used))
        at = table.places(names).copy()
        lack = at < 0
        at[lack] = len(table.names) + np.arange(np.count_nonzero(lack), dtype=at.dtype)
        new = names.filter(pa.array(lack))
        learned = learn(new)
        whole = pa.concat_arrays([table.ids, learned, pa.array(heads, pa.large_binary())])
        at = np.concatenate([at, len(table.ids) + len(learned) + np.arange(len(heads), dtype=at.dtype)])
        every = whole.take(pa.array(at[self.order]))
        table.add(new, learned)
        _, offsets, data = every.buffers()
        ends = np.frombuffer(offsets, np.int64, len(every) + 1)
        ids = np.frombuffer(data, "<u4", int(ends[-1]) // 4) if len(every) and ends[-1] else np.zeros(0, "<u4")
        pa.default_memory_pool().release_unused()
        return ids, ends[self.offsets] // 4


class Vocabulary(NamedTuple):
    """Pieces and their ids as an Arrow stream; workers keep what they have read by the key."""

    key: str
    rows: Broadcast


class Encoder:
    """Texts to ids by merge replay; what a cache lacks is cut by the pattern and replayed."""

    def __init__(self, path: str, pattern: str) -> None:
        self.replay = MergeReplay(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.words, self.pieces = WordCache(), PieceTable()
        self.bytes_of = pa.array(self.replay.tokens, pa.large_binary())
        self.adopted = ""

    def adopt(self, known: Vocabulary | None) -> Encoder:
        """Use a broadcast vocabulary."""
        if known is not None and self.adopted != known.key:
            with pa.ipc.open_stream(known.rows.value) as source:
                t = source.read_all().combine_chunks()
            self.pieces = PieceTable(*[t[c].cast(k).combine_chunks() for c, k in (("piece", pa.large_string()), ("ids", pa.large_binary()))])
            self.adopted = known.key
        return self

    def parted(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, cut by the pattern; the words that the cache lacks are replayed together."""
        parts = list(map(self.find, texts))
        lack = self.words.missing(set().union(*parts))
        for w, ids in zip(lack, self.replay.encode(w.encode() for w in lack)):
            self.words[w] = ids
        get = self.words.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the places where texts begin and end."""
        cut = Pieces(texts)
        learn = lambda names: pa.array(self.parted([" " + x for x in names.to_pylist()]), pa.large_binary())
        return cut.encoded(self.pieces, learn, self.parted(cut.heads))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        ids, ends = self.encode_block(pa.array(texts, pa.string()))
        return [ids[i:j].tobytes() for i, j in zip(ends, ends[1:])]

    def decode_block(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
        """Bytes of all texts and the places where texts begin and end."""
        every = self.bytes_of.take(pa.array(ids))
        _, offsets, data = every.buffers()
        return memoryview(data or b"").cast("B"), np.frombuffer(offsets, np.int64, len(every) + 1)[ends].tolist()

    def decode(self, ids: bytes) -> bytes:
        data, (start, end) = self.decode_block(np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]))
        return bytes(data[start:end])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def frequent_pieces(docs: DataFrame, folder: str) -> DataFrame:
    """(piece): the blank-led pieces that stand most often in all texts, VOCABULARY at most.

    A block hands on the pieces that it has twice. Pieces that tie at the lowest count that doesn't fit stay out together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            cut = Pieces(b.column("text"))
            many = np.flatnonzero(cut.counts > 1)
            names = cut.names.take(pa.array(many)).cast(pa.string())
            short = pc.less_equal(pc.binary_length(names), LONGEST)
            out = pa.RecordBatch.from_arrays([names, pa.array(cut.counts[many], pa.int64())], names=["piece", "n"])
            yield out.filter(short)

    found = docs.select(text_of().alias("text")).mapInArrow(run, "piece string, n long")
    counted = stage(found.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 2"), folder, "pieces")
    # one row for each power of 1.02 that counts reach: bounded by the range of a long
    level = F.floor(F.log("n") / F.log(F.lit(1.02)))
    least, total = None, 0
    for r in counted.groupBy(level.alias("l")).agg(F.count("*").alias("c")).orderBy(F.desc("l")).collect():
        total += r["c"]
        if total > VOCABULARY:
            break
        least = r["l"]
    return counted.where(level >= least).select("piece") if least is not None else counted.limit(0).select("piece")


def vocabulary(docs: DataFrame, path: str, pattern: str, folder: str) -> Vocabulary:
    """Ids of the frequent pieces, replayed together, as a broadcast of VOCABULARY rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [x for b in batches for x in b.column(0).to_pylist()]  # at most VOCABULARY
        ids = encoder(path, pattern).parted([" " + x for x in pieces])
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(ids, pa.binary())], names=["piece", "ids"])

    known = frequent_pieces(docs, folder).mapInArrow(run, "piece string, ids binary").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    return Vocabulary(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()))


def _kept(df: DataFrame, keep: tuple[str, ...], own: str) -> tuple[list[str], str]:
    """Columns of keep that stay, and their schema with that of the operator's own column."""
    name = own.split()[0]
    stay = [c for c in keep if c.lower() != name]
    return stay, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*stay).schema] + [own])


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), known: Vocabulary | None = None) -> DataFrame:
    """docs(text, ...) -> the columns of keep and ids array<int>. known: see vocabulary."""
    stay, schema = _kept(docs, keep, "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern).adopt(known)
        for b in blocks(batches, "__text", BLOCK):
            ids, ends = enc.encode_block(b.column("__text"))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in stay] + [listed], names=[*stay, "ids"])

    return docs.select(*stay, text_of().alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encoded(ids, ...) -> the columns of keep and text; bytes that aren't UTF-8 become U+FFFD."""
    stay, schema = _kept(encoded, keep, "text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            texts = [enc.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in stay] + [pa.array(texts, pa.string())], names=[*stay, "text"])

    return encoded.select(*stay, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, known: Vocabulary | None = None) -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern).adopt(known)
        for b in blocks(batches, "text", BLOCK):
            ids, ends = enc.encode_block(b.column("text"))
            data, places = enc.decode_block(ids, ends)
            raw = memoryview(ids.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(ends, ends[1:])]),
                    pa.array([hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(places, places[1:])]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def count_tokens(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...], known: Vocabulary | None = None) -> DataFrame:
    """docs(text, ...) -> the columns of keep and n_tokens long."""
    stay, schema = _kept(docs, keep, "n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern).adopt(known)
        for b in blocks(batches, "__text", BLOCK):
            _, ends = enc.encode_block(b.column("__text"))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in stay] + [pa.array(np.diff(ends), pa.int64())], names=[*stay, "n_tokens"])

    return docs.select(*stay, text_of().alias("__text")).mapInArrow(run, schema)


def encode_verified(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), known: Vocabulary | None = None) -> DataFrame:
    """docs(text, ...) -> the columns of keep, ids array<int>, n_tokens long, decoded_sha256 string. The ids are decoded, and
    bytes that differ from the text's raise an error."""
    stay = [c for c in keep if c.lower() not in ("ids", "n_tokens", "decoded_sha256")]
    _, schema = _kept(docs, tuple(stay), "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern).adopt(known)
        for b in blocks(batches, "__text", BLOCK):
            texts = b.column("__text")
            ids, ends = enc.encode_block(texts)
            data, places = enc.decode_block(ids, ends)
            own = texts.cast(pa.large_binary()).to_pylist()
            if any(data[i:j] != t for i, j, t in zip(places, places[1:], own)):
                raise ValueError("ids don't decode to their text")
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
            shas = pa.array([hashlib.sha256(t).hexdigest() for t in own], pa.string())
            cols = [listed, pa.array(np.diff(ends), pa.int64()), shas]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in stay] + cols, names=[*stay, "ids", "n_tokens", "decoded_sha256"])

    return docs.select(*stay, text_of().alias("__text")).mapInArrow(run, schema + ", n_tokens long, decoded_sha256 string")
