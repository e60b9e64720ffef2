"""Secret scan with dictionary-primed zstandard novelty.

Fixed patterns give the base spans. Further candidates are all long tokens that stand shortly after a sensitive word,
whatever characters they are made of; a long word that is rare in code is reported with them. A candidate is measured by
the bytes it adds to a zstandard frame whose dictionary holds the parts of identifiers that are most frequent in all texts,
counted by Spark, beside some common words of code, and the text around the candidate without further copies of it: names,
paths and repeated parts cost little there, random key material costs about a byte for each character and is reported. A
candidate is coded in short pieces, each primed with those before, so that its length and the size of its alphabet do not
lower its cost. Each text is scanned whole; texts meet no shuffle.

Defined results: null or empty text has no spans; repeated rows and null doc_ids keep their rows; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_of

# Keywords, prefix and lengths of the base kinds.
_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is a match of [0-9a-f]+ as a whole
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows sensitive.
_SENSITIVE = re.compile(
    r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|private[_-]?key|credential|authorization|bearer|signature|session[_-]?id)",
    re.ASCII,
)
_HINTS = ("pass", "pwd", "secret", "token", "api", "private", "credential", "authorization", "bearer", "signature", "session")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_CUT_HEAD, _CUT_TAIL = re.compile(r"\A[A-Za-z0-9+/_=.~-]+"), re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=.~-]+\Z")
#: Characters after a sensitive word in which a candidate starts; text on either side that primes the dictionary.
REACH, AROUND = 48, 1024
#: Added bytes for each character from which a candidate is new material.
NOVELTY = 0.9
#: Characters coded at a time: zstandard stores so few literals as they are, so that length and alphabet do not matter.
PIECE = 60

#: Compound identifiers (joined by signs, or camel case) and their parts; most parts that the dictionary takes: some 30 KB.
COMPOUND = r"[A-Za-z][A-Za-z0-9]*+(?:[_.:/-][A-Za-z0-9]++)++|[A-Za-z][a-z]++(?:[A-Z][a-z]++)++"
PART, MOST_PARTS = r"[A-Z]?[a-z]{2,13}", 4096

#: Common words of code and configuration, which every dictionary begins with.
IDENTIFIERS = (
    "access account address admin algorithm application argument array async auth authorization await base64 bearer bool buffer "
    "byte cache callback certificate char class client code column config connection const content context cookie count "
    "credential data database date debug default delete description development directory document domain double email enable "
    "encode endpoint entity environment error event example exception export false file filter float folder format function "
    "generate group handler hash header host http https identifier import index info input insert instance integer interface "
    "internal item json key label language length level library limit link list local location login long manager message "
    "method model module name namespace node null number object offset option order output package page parameter parse password "
    "path pattern payload permission placeholder pointer port prefix private process production profile project property protected "
    "protocol proxy public query random record redirect region register release request resource response result return role "
    "root schema scope script secret select self server service session setting signature size source static status storage "
    "string struct style suffix system table target template test text thread time timeout timestamp title token true type "
    "unicode union update upload url user username utils value variable version view void window write"
).encode()


def identifiers(docs: DataFrame) -> bytes:
    """The dictionary: common words, then the parts of compound identifiers most frequent in docs(text), the most frequent
    last. A part is a short run of letters, so that random keys leave nothing of theirs in it, however often they are copied.
    """
    found = docs.select(F.explode(F.regexp_extract_all(text_of(), F.lit(COMPOUND), F.lit(0))).alias("x"))
    parts = found.select(F.explode(F.regexp_extract_all("x", F.lit(PART), F.lit(0))).alias("x")).groupBy(F.lower("x").alias("x")).count()
    top = parts.where("count > 1").orderBy(F.desc("count"), "x").limit(MOST_PARTS).collect()  # bounded: the dictionary's size
    return b" ".join([IDENTIFIERS, *[r["x"].encode() for r in reversed(top)]])


def marginal_bytes(candidate: str, around: str, words: bytes = IDENTIFIERS) -> int:
    """Bytes that candidate adds to an empty frame primed with the identifiers and the surrounding text."""
    primed = zstandard.ZstdCompressionDict(words + b" " + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)
    return len(frame.compress(candidate.encode())) - len(frame.compress(b""))


def novel(text: str, start: int, stop: int, words: bytes = IDENTIFIERS) -> bool:
    """Whether a candidate adds NOVELTY bytes a character, beside its surroundings without further copies of it."""
    token = text[start:stop]
    before, after = text[max(0, start - AROUND) : start], text[stop : stop + AROUND]
    if start > AROUND:  # a token that the window cuts may be a copy
        before = _CUT_HEAD.sub("", before)
    if stop + AROUND < len(text):
        after = _CUT_TAIL.sub("", after)
    around = f"{before} {after}".replace(token, " ")
    added = 0
    for at in range(0, len(token), PIECE):
        added += marginal_bytes(token[at : at + PIECE], f"{around} {token[max(0, at - AROUND) : at]}", words)
    return added >= NOVELTY * len(token)


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches."""
    out = []
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def novel_spans(text: str, low: str, taken: list[tuple[int, int, int]], words: bytes = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """Incompressible tokens in sensitive context that meet no base span."""
    if not any(h in low for h in _HINTS):
        return []
    taken = sorted(taken)
    out, done, k, reach = [], 0, 0, 0
    for word in _SENSITIVE.finditer(text):
        at = max(done, word.end())
        while (m := _TOKEN.search(text, at, word.end() + REACH + 16)) and m.start() <= word.end() + REACH:
            m = _TOKEN.match(text, m.start())  # whole, beyond the search window
            at = done = m.end()
            while k < len(taken) and taken[k][0] < m.end():
                reach = max(reach, taken[k][2])
                k += 1
            if reach > m.start():
                continue
            if novel(text, m.start(), m.end(), words):
                out.append((m.start(), 3, m.end()))
    return out


def scan(text: str, words: bytes = IDENTIFIERS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, by start, then kind."""
    low = text.lower()
    base = sorted(base_spans(text, low))
    return base, sorted(base + novel_spans(text, low, base, words))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


def digest(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the count of each kind, base_sha256 and spans."""
    words = identifiers(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            found = [scan(t, words) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in s) for _, s in found], pa.int64()) for k in range(len(KINDS))]
            base = pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x, _ in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, base, pa.array([written(s) for _, s in found])],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)
