"""Near-duplicate documents by SimHash and a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most RADIUS = 4 bits differ in at most 4 bytes, so at least 4
of their positional bytes are equal: the guaranteed minimum. Posting lists of single positional bytes would each hold 1/256
of all fingerprints, so the index is keyed by three positional bytes at once. Of the 56 triples of positions 20 are enough
(Turan's construction): every set of 4 positions contains one of them. Within a posting list equal positional bytes are
tallied for each pair, pairs below the minimum are dropped, the others are verified by their differing bits. A list of
fingerprints that all lie close together is explored from its members outward, each member dropping out once it is
reached, so what leaves a list are spanning links, not all pairs.

A list of more than MAX_LIST fingerprints is not compared pairwise. Its members are instead put under every fingerprint
within 2 bits of them; two members share such a midpoint exactly if they differ in at most 4 bits, so linking all members
of a midpoint to its least one gives the same components at a cost in proportion to the list.

Only distinct fingerprints are indexed; documents with the same one are brought together by an aggregation.

Null and empty texts and texts of white space have fingerprint zero. A null doc_id gets a row; it names no component unless
all of the component's doc_ids are null. Repeated rows and repeated doc_ids get a row each. Texts are read in pieces of about
128 kB, so a very long one takes no more memory than itself. An empty table gives an empty result. Only doc_id and text are
read, so other columns may have any name (`one_of_each` keeps them; only `_key` is its own).
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, partitions, removed, row_key, small, table, tidy, with_hot_keys, written
from .components import components

SEED, WORDS, RADIUS, BYTES = 42, 4, 4, 8
MAX_LIST = 20_000
#: Lists up to this length are compared pair by pair, longer ones are explored.
PAIRWISE = 64
#: Shingles hashed before votes are counted (at most 65535, for lanes of 16 bits), and bytes of a text read at a time.
BLOCK, PIECE = 1 << 14, 1 << 17
_LANES = np.uint64(0x0001000100010001)
_GAP = re.compile(rb"[\x09-\x0d\x20]")


def shingle_blocks(text: str, words: int = WORDS):
    """Hashes (uint64) of a text's shingles, repeats included, in order, in blocks of bounded size."""
    import xxhash

    h, raw, at, carry, some = xxhash.xxh64_intdigest, text.encode().lower(), 0, [], False
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE) if at + PIECE < len(raw) else None
        end = gap.start() if gap else len(raw)
        parts = carry + raw[at:end].split()
        at, n = end, len(parts) - words + 1
        carry = parts[max(n, 0) :]
        for lo in range(0, n, BLOCK):
            some, own = True, parts[lo : lo + BLOCK + words - 1]
            joined, ends = b" ".join(own), np.cumsum([len(p) + 1 for p in own])
            begins = np.append(0, ends[: -words]) if words < len(own) else np.zeros(1, np.int64)
            spans = zip(begins.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
            yield np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, len(begins))
    if carry and not some:
        yield np.array([h(b" ".join(carry), SEED)], np.uint64)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *shingle_blocks(text, words)])


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, by run of hashes (runs of at most 65535): four bits in a word at a time."""
    out = np.empty((len(starts), 64), np.int64)
    for k in range(16):
        lanes = np.add.reduceat(hashes >> np.uint64(k) & _LANES, starts)
        for j in range(4):
            out[:, k + 16 * j] = lanes >> np.uint64(16 * j) & np.uint64(0xFFFF)
    return out


def fingerprints_of_blocks(blocks, many: int) -> np.ndarray:
    """Fingerprints (uint64) of `many` texts from (index of the text, a block of its shingles' hashes): a bit is 1 if it is set in over
    half of a text's hashes."""
    ones, total = np.zeros((many, 64), np.int64), np.zeros(many, np.int64)
    held, who, size = [], [], 0

    def count():
        n = np.array([len(x) for x in held])
        np.add.at(ones, who, bit_counts(np.concatenate(held), np.cumsum(n) - n))
        np.add.at(total, who, n)

    for i, block in blocks:
        held.append(block)
        who.append(i)
        size += len(block)
        if size >= BLOCK:
            count()
            held, who, size = [], [], 0
    if held:
        count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(texts, words: int = WORDS) -> np.ndarray:
    """Fingerprints (uint64) of texts by their shingles, repeats included."""
    return fingerprints_of_blocks(((i, block) for i, t in enumerate(texts) for block in shingle_blocks(t or "", words)), len(texts))


def fingerprints_of_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (uint64) of sets of shingle hashes."""
    return fingerprints_of_blocks(((i, s[k : k + BLOCK].view(np.uint64)) for i, s in enumerate(sets) for k in range(0, len(s), BLOCK)), len(sets))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (bigint, the bits of the fingerprint) of every row."""
    schema = "doc_id bigint, fp bigint"

    def run(batches):
        for b in small(batches):
            yield batch_of(schema, {"doc_id": b.column(0), "fp": fingerprints_of(b.column(1).to_pylist(), words).view(np.int64)})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), schema)


def position_sets(matches: int = BYTES - RADIUS) -> list[tuple[int, ...]]:
    """Triples of byte positions such that every set of 4 positions contains one: within one of three parts of the
    positions, or two of a part and one of the next. With fewer guaranteed matches, all sets of that many positions."""
    if matches < 4:
        return list(combinations(range(BYTES), matches))
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for p in parts for t in combinations(p, 3)]
    for i, p in enumerate(parts):
        out += [(*two, one) for two in combinations(p, 2) for one in parts[(i + 1) % 3]]
    return out


def _links_of_lists(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Links within each run of equal keys (sorted)."""
    a, b = [], []
    edge = np.flatnonzero(np.diff(keys)) + 1
    first, size = np.append(0, edge), np.diff(np.concatenate([[0], edge, [len(keys)]]))
    short = np.repeat(size <= PAIRWISE, size)
    k, f = keys[short], fps[short]
    for d in range(1, PAIRWISE):
        if len(k) <= d:
            break
        at = np.flatnonzero(k[d:] == k[:-d])
        if not len(at):
            break
        x = f[at] ^ f[at + d]
        tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        at, x = at[tally >= BYTES - radius], x[tally >= BYTES - radius]
        at = at[np.bitwise_count(x) <= radius]
        a.append(f[at])
        b.append(f[at + d])
    for s, n in zip(first[size > PAIRWISE], size[size > PAIRWISE], strict=True):
        left = fps[s : s + n]
        while len(left):
            root, todo, left = left[0], [left[0]], left[1:]
            while todo and len(left):
                x = left ^ todo.pop()
                hit = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - radius
                hit &= np.bitwise_count(x) <= radius
                got, left = left[hit], left[~hit]
                todo += list(got)
                a.append(np.full(len(got), root))
                b.append(got)
    return a, b


_LINK = "u bigint, v bigint, long_list boolean"


def _scan(max_list: int, radius: int):
    def emit(a, b, flag):
        u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return batch_of(_LINK, {"u": u, "v": v, "long_list": np.full(len(u), flag)})

    def run(batches):
        """Posting lists as a stream: only the list at hand is kept, and no more of it than max_list."""
        keys, fps, long_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if long_key is not None:
                n = int(np.searchsorted(k, long_key, side="right"))
                if n:
                    yield emit([f[:n]], [f[:n]], True)
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                long_key = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            if not len(keys):
                continue
            tail = int(np.searchsorted(keys, keys[-1]))
            yield emit(*_lists(keys[:tail], fps[:tail]), False)
            for x in long_ones:
                yield emit([x], [x], True)
            long_ones.clear()
            keys, fps = keys[tail:], fps[tail:]
            if len(keys) > max_list:
                yield emit([fps], [fps], True)
                long_key, keys, fps = keys[0], keys[:0], fps[:0]
        if len(keys):
            yield emit(*_lists(keys, fps), False)

    long_ones: list = []

    def _lists(keys, fps):
        if not len(keys):
            return [], []
        edge = np.flatnonzero(np.diff(keys)) + 1
        size = np.diff(np.concatenate([[0], edge, [len(keys)]]))
        if (size > max_list).any():
            first = np.append(0, edge)
            long_ones.extend(fps[s : s + n] for s, n in zip(first[size > max_list], size[size > max_list], strict=True))
            keep = np.repeat(size <= max_list, size)
            keys, fps = keys[keep], fps[keep]
            if not len(keys):
                return [], []
        return _links_of_lists(keys, fps, radius)

    return run


def _around(radius: int):
    """Masks of at most radius bits."""
    return np.array([sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(64), n)], np.uint64)


def midpoint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links of distinct fingerprints (column fp) through midpoints, without comparing pairs. radius is even."""
    if radius % 2:
        raise ValueError("midpoints need an even radius")
    masks, schema = _around(radius // 2), "mid bigint, fp bigint"

    def run(batches):
        for b in batches:
            for part in np.array_split(b.column(0).to_numpy().view(np.uint64), max(1, len(b.column(0)) // 64)):
                mid = (part[:, None] ^ masks).ravel()
                yield batch_of(schema, {"mid": mid.view(np.int64), "fp": np.repeat(part, len(masks)).view(np.int64)})

    mids = written(fps.mapInArrow(tidy(run), schema), "simhash-midpoints")
    least = mids.groupBy("mid").agg(F.min("fp").alias("v"))
    return mids.join(least, "mid").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, max_list: int = MAX_LIST) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that have the components of all pairs within radius."""
    byte = [F.shiftright("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    keys = []
    for i, positions in enumerate(position_sets(BYTES - radius)):
        key = F.lit(i).cast("bigint")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    index = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    lists = index.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    found = written(lists.mapInArrow(tidy(_scan(max_list, radius)), _LINK), "simhash-links")
    out = found.filter("not long_list").select("u", "v")
    many = found.filter("long_list").select(F.col("u").alias("fp")).distinct()
    if many.head(1):
        out = out.unionByName(midpoint_links(many, radius))
    return out


def classes_of(fps: DataFrame, radius: int = RADIUS, max_list: int = MAX_LIST) -> DataFrame:
    """fp, root (the least fingerprint that links lead to), copies (how many rows have fp), of the distinct ones of fps."""
    classes = written(fps.groupBy("fp").agg(F.count("*").alias("copies")), "simhash-classes")
    roots = written(components(links(classes.select("fp"), radius, max_list)), "simhash-roots")
    return written(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "copies"), "simhash-groups")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, max_list: int = MAX_LIST) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of the documents that links lead to)."""
    fps = written(fingerprints(docs, words), "simhash-fingerprints")
    groups = classes_of(fps, radius, max_list)
    # the least doc_id of a fingerprint, then of a component; a fingerprint or a component may hold a large part of all rows
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups, "fp"), "simhash-least")
    names = written(least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-names")
    named = written(with_hot_keys(least.select("fp", "root", "copies"), names, ["root"], "n").drop("root"), "simhash-named")
    return with_hot_keys(fps, named, ["fp"], "copies").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without all but one of each group: the least by doc_id (null last), then by a digest of all columns.

    Rows are told apart by all their columns, so a doc_id may repeat with other texts; of equal rows one stays.
    """
    have = docs.withColumn("_key", row_key(docs))
    ids = written(have.select(F.col("doc_id").cast("bigint").alias("doc_id"), "_key", "text").dropDuplicates(["_key"]), "simhash-rows")
    schema = "doc_id bigint, key binary, fp bigint"

    def run(batches):
        for b in small(batches):
            yield batch_of(schema, {"doc_id": b.column(0), "key": b.column(1), "fp": fingerprints_of(b.column(2).to_pylist(), words).view(np.int64)})

    fps = written(ids.mapInArrow(tidy(run), schema), "simhash-fingerprints")
    removed(ids)
    groups = classes_of(fps, radius)
    best = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("row"))
    keep = best.join(groups, "fp").groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.key").alias("_key"))
    return have.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
