"""Media payloads in a content-addressed chunk store.

A payload is cut where a rolling gear hash of its last 32 bytes has zero low bits (at least MIN_CHUNK, at most MAX_CHUNK
bytes). Chunks are known by a 128-bit BLAKE2b digest. Digests that occur more than once, found by a Spark aggregation over
all chunk lists, are put into a table of shared chunks, each stored once; the chunks of a payload that no other place uses
stay together in the payload's own row (`packs`). What is shared is told to the tasks as a Bloom filter of fixed size: a
false positive only moves a chunk to the shared table, so results do not depend on it, and a full filter only means that
all chunks go that way. Reading back joins the ordered chunk list of each distinct payload to the shared chunks, puts the
payload together, and checks every chunk digest.

The stored form of a media item is its recipe, a header (magic, number of chunks) and the ordered list (size, digest of each
chunk), then the chunks' bytes: 8-bit samples in order. Recipe and chunks are what the store holds; digests are taken of the
bytes as they are read from it.

Null text is empty; an empty text is a payload of 64 zero bytes. Null or repeated doc_ids keep one result row per input row. A
payload is put together in one row, whatever its length; a worker holds about 4 MB of them besides. An empty table gives an
empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, small, table, tidy, with_hot_keys, written

UNIT = 64
MIN_CHUNK, CUT_BITS, MAX_CHUNK = 256, 10, 4096
#: Bits of the filter that tells shared digests apart, a power of two; 2 MB.
FILTER_BITS = 1 << 24
MAGIC = b"FLMC"


def gear_table() -> np.ndarray:
    """256 pseudo-random words: SHA-256 of the byte value."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


_GEAR = gear_table()


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The hash at a byte is h = (h << 1) + gear[byte] in 32 bits, for all bytes at once by doubling."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if step < len(h):
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h = more
    ends, last, n = [], 0, len(data)
    for p in (np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1).tolist():
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if p - last >= MIN_CHUNK:
            ends.append(p)
            last = p
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def digest(chunk: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(chunk, digest_size=16).digest())


def split(data: bytes) -> list[tuple[int, int, bytes]]:
    out, at = [], 0
    for end in cuts(data):
        chunk = data[at:end]
        out.append((*digest(chunk), chunk))
        at = end
    return out


_ENTRY = struct.Struct("<Iqq")


def recipe_of(chunks: list[tuple[int, int, bytes]]) -> bytes:
    return b"".join([MAGIC, struct.pack("<I", len(chunks)), *[_ENTRY.pack(len(c), hi, lo) for hi, lo, c in chunks]])


def entries(recipe: bytes) -> list[tuple[int, int, int]]:
    """Size and digest of each chunk."""
    if recipe[:4] != MAGIC:
        raise ValueError("not a recipe")
    return list(_ENTRY.iter_unpack(recipe[8:]))


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy and zero share of the samples."""
    p = np.bincount(samples, minlength=256) / len(samples)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={entropy:.4f};zero={p[0]:.4f}"


_MANIFEST = "doc_id bigint, n_bytes bigint, p_hi bigint, p_lo bigint, hi array<bigint>, lo array<bigint>"


def manifest(docs: DataFrame) -> DataFrame:
    """The ordered chunk list of every document, without bytes."""

    def run(batches):
        for b in small(batches):
            rows = {"doc_id": b.column(0)} | {n: [] for n in ("n_bytes", "p_hi", "p_lo", "hi", "lo")}
            for text in b.column(1):
                t = text.as_py()
                data = payload_of(t)
                got = split(data)
                p = digest(data)
                rows["n_bytes"].append(len((t or "").encode()))
                rows["p_hi"].append(p[0])
                rows["p_lo"].append(p[1])
                rows["hi"].append([c[0] for c in got])
                rows["lo"].append([c[1] for c in got])
            yield batch_of(_MANIFEST, rows)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), _MANIFEST)


def shared_filter(lists: DataFrame) -> np.ndarray:
    """Words of a Bloom filter (two probes) over the digests that occur more than once. At most FILTER_BITS / 64 rows come to the driver."""
    each = lists.select(F.explode(F.arrays_zip("hi", "lo")).alias("c")).select("c.hi", "c.lo")
    twice = each.groupBy("hi", "lo").agg(F.count("*").alias("n")).filter("n > 1")
    bit = twice.select(F.explode(F.array("hi", "lo")).alias("h")).select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("b"))
    words = bit.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for w, v in words.collect():
        out[w] = v
    return out.view(np.uint64)


def _maybe_shared(words: np.ndarray, hi: int, lo: int) -> bool:
    a, b = hi & (FILTER_BITS - 1), lo & (FILTER_BITS - 1)
    return bool((int(words[a >> 6]) >> (a & 63)) & (int(words[b >> 6]) >> (b & 63)) & 1)


_PACK = "p_hi bigint, p_lo bigint, recipe binary, at array<int>, hi array<bigint>, lo array<bigint>, body binary"
_CHUNK = "hi bigint, lo bigint, body binary, uses bigint"


def packs(docs: DataFrame, words) -> DataFrame:
    """For every document its recipe, the bytes of the chunks that nothing else uses, and places and digests of the others."""

    def run(batches):
        bloom, names = words.value, ("p_hi", "p_lo", "recipe", "at", "hi", "lo", "body")
        for b in small(batches):
            rows = {n: [] for n in names}
            for text in b.column(0):
                data = payload_of(text.as_py())
                got = split(data)
                flags = [_maybe_shared(bloom, hi, lo) for hi, lo, _ in got]
                at = [i for i, f in enumerate(flags) if f]
                values = (*digest(data), recipe_of(got), at, [got[i][0] for i in at], [got[i][1] for i in at], b"".join(c[2] for c, f in zip(got, flags, strict=True) if not f))
                for n, v in zip(names, values, strict=True):
                    rows[n].append(v)
            yield batch_of(_PACK, rows)

    return docs.select("text").mapInArrow(tidy(run), _PACK)


def shared_chunks(docs: DataFrame, words) -> DataFrame:
    """Every chunk that may be shared, once, and how often it occurs."""

    def run(batches):
        bloom = words.value
        for b in small(batches):
            found, uses = {}, Counter()
            for text in b.column(0):
                for hi, lo, c in split(payload_of(text.as_py())):
                    if _maybe_shared(bloom, hi, lo):
                        found[hi, lo] = c
                        uses[hi, lo] += 1
            yield batch_of(_CHUNK, {"hi": [k[0] for k in found], "lo": [k[1] for k in found], "body": list(found.values()), "uses": [uses[k] for k in found]})

    return docs.select("text").mapInArrow(tidy(run), _CHUNK).groupBy("hi", "lo").agg(F.first("body").alias("body"), F.sum("uses").alias("uses"))


_MEDIA = "p_hi bigint, p_lo bigint, payload binary, media binary"
_DIGESTS = "p_hi bigint, p_lo bigint, copies bigint, payload_bytes bigint, payload_sha256 binary, tail_crc32 bigint, media_bytes bigint, media_sha256 binary, feature string"


def _digests(p_hi: int, p_lo: int, copies: int, data: bytes, form: bytes) -> tuple:
    sha = lambda x: hashlib.sha256(x).digest()
    return p_hi, p_lo, copies, len(data), sha(data), zlib.crc32(data[-UNIT:]), len(form), sha(form), features(np.frombuffer(data, np.uint8))


def read_back(pack: DataFrame, chunks: DataFrame, digests: bool = False) -> DataFrame:
    """Every distinct payload with its stored form, put together from the stored chunks and verified; or the digests of both and
    the number of its copies."""
    # bytes beside a recipe are of chunks that nothing else uses, so these payloads have no copies
    own = pack.filter(F.length("body") > 0).withColumn("copies", F.lit(1).cast("bigint"))
    bare = pack.filter(F.length("body") == 0)
    # copies of a payload share all their chunks, so their rows hold no bytes and are cheap to tell apart
    bare = bare.groupBy("p_hi", "p_lo").agg(*[F.first(c).alias(c) for c in ("recipe", "at", "hi", "lo", "body")], F.count("*").alias("copies"))
    stored = own.unionByName(bare)
    whole = stored.filter(F.size("at") == 0).withColumn("got", F.lit(None).cast("array<struct<i:int,body:binary>>"))
    part = stored.filter(F.size("at") > 0)
    refs = part.select("p_hi", "p_lo", F.explode(F.arrays_zip("at", "hi", "lo")).alias("c")).select("p_hi", "p_lo", F.col("c.at").alias("i"), "c.hi", "c.lo")
    got = with_hot_keys(refs, chunks, ["hi", "lo"], "uses").groupBy("p_hi", "p_lo").agg(F.collect_list(F.struct("i", "body")).alias("got"))
    rows = whole.unionByName(part.join(got, ["p_hi", "p_lo"]))
    schema = _DIGESTS if digests else _MEDIA

    def run(batches):
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for b in small(batches, 100):
            out = {n: [] for n in names}
            for r in zip(*b.columns, strict=True):
                p_hi, p_lo, copies, recipe, body, fetched = [x.as_py() for x in r]
                by_place, at, chunks_ = {g["i"]: g["body"] for g in fetched or []}, 0, []
                for i, (size, hi, lo) in enumerate(entries(recipe)):
                    c = by_place.get(i)
                    if c is None:
                        c, at = body[at : at + size], at + size
                    if len(c) != size or digest(c) != (hi, lo):
                        raise ValueError(f"chunk {i} of payload {p_hi:x}{p_lo:x} does not match its digest")
                    chunks_.append(c)
                data = b"".join(chunks_)
                if digest(data) != (p_hi, p_lo):
                    raise ValueError(f"payload {p_hi:x}{p_lo:x} does not match its digest")
                values = _digests(p_hi, p_lo, copies, data, recipe + data) if digests else (p_hi, p_lo, data, recipe + data)
                for n, v in zip(names, values, strict=True):
                    out[n].append(v)
            yield batch_of(schema, out)

    return rows.select("p_hi", "p_lo", "copies", "recipe", "body", "got").mapInArrow(tidy(run), schema)


class Store:
    """A chunk store over a table of texts: `documents` (chunk lists by doc_id), `packs`, `chunks`."""

    def __init__(self, docs: DataFrame) -> None:
        docs = docs.select("doc_id", "text")
        self.documents = written(manifest(docs), "media-lists")
        words = docs.sparkSession.sparkContext.broadcast(shared_filter(self.documents))
        self.packs = written(packs(docs, words), "media-packs")
        self.chunks = written(shared_chunks(docs, words), "media-chunks")

    def media(self) -> DataFrame:
        """p_hi, p_lo, payload, media of every distinct payload."""
        return read_back(self.packs, self.chunks)

    def digests(self) -> DataFrame:
        """What is read back of every document: doc_id, n_bytes, n_chunks, sizes and digests, feature."""
        key = ["p_hi", "p_lo"]
        docs = self.documents.select("doc_id", "n_bytes", *key, F.size("hi").cast("bigint").alias("n_chunks"))
        each = written(read_back(self.packs, self.chunks, digests=True), "media-digests")
        got = with_hot_keys(docs, each, key, "copies").drop(*key)
        return got.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(table(spark, sf_dir, "documents")).digests()
