"""Near copies in the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

They are found by SimHash: the fingerprints of the sets go through op 4's index of positional bytes (count filtering, at most 4 differing
bits), and what it links is verified with the whole sets. SimHash can't give all pairs of that similarity, as their fingerprints differ
in about 10 bits on average. An exact check of the sets that SimHash has left apart follows.

It finds all of their pairs, by prefix filtering: in any one order of all shingles, two sets that are that similar share one of
their first n - ceil(0.8 n) + 1 shingles. The order puts rare shingles first, so that lists of common ones stay out of most
prefixes; frequencies come from a sample, which changes the length of lists only, never what is found. Pairs in a list that
sizes and places in the order allow are candidates. Parities of hashed shingles (as many bits as a set has shingles) bound the
difference of two sets from below and rule most candidates out; the others are verified with their whole sets.

Rows with equal sets are brought together first: of each set the least row is kept in a table that is bucketed by the hash
of the set (128 bits tell sets apart), so texts are exchanged once, and what comes later (verification, the choice of rows) joins that table where it
lies. A list of more than PAIRWISE sets is first compared between neighbours by size only. Then its pairs that lie in
different components are compared, in blocks that are dealt to tasks: first the closest few of each two components, then all
that are still apart. A list whose sets are all in one component is done.

Texts without words (null, empty, white space) have the empty set and are one group. Rows are told apart by all of their
columns: a doc_id may be null, or repeat with other texts; of equal rows one stays. Ties go to the least digest of all columns.
A very long text is hashed in pieces, its set is as large as itself. An empty table gives an empty result. Columns may have
any name.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, batch_of, partitions, row_key, small, tidy, with_hot_keys, work_dir, written
from .components import components
from .simhash import SEED, fingerprints_of_sets, shingle_hashes
from .simhash import links as simhash_links

WORDS = 5
#: Similar: OVER * |both| >= UNDER * (|a| + |b|), which is a Jaccard similarity of 0.8.
OVER, UNDER = 9, 4
PAIRWISE = 64
#: Sets in a block of a long list (about), and candidates of two components in a block that are tried first.
BLOCK, FEW = 2048, 4
#: Candidates of one set from which on the set goes to them instead (the HOT most frequent ones only).
MANY = 1000
#: Documents of the sample for frequencies (about), and common shingles that are known at most.
SAMPLE, COMMON, OFTEN = 6_000, 200_000, 4


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", WORDS)).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of at least n (a power of two) bits, packed."""
    bits = max(64, 1 << (max(len(shingles), 1) - 1).bit_length())
    return np.packbits(np.bincount(shingles & (bits - 1), minlength=bits) & 1)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """At least so many shingles are in one of two sets only, by their parities; longer ones fold onto shorter ones."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the global order: rare ones by value, then common ones, the rarer first."""
    n = len(shingles)
    place = np.full(n, -1, np.int64)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        hit = common[at] == shingles
        place[hit] = rank[at[hit]]
    return shingles[np.lexsort((shingles, place))[: n - (4 * n + 4) // 5 + 1 if n else 0]]


def distinct_sets(docs: DataFrame, bits: int = 64) -> DataFrame:
    """sid, n (size of the set), bits (its parities), fp (its SimHash fingerprint), text, no_id, doc_id, key, row (all columns, as c0, c1, ...) of the least row of
    each set: a table bucketed by sid.

    Sets are told apart by a hash of 64 + bits bits. sid is its first part; where different sets have the same one, which is rare, the
    least set by the second part keeps it, and the others are appended with their second part as sid.
    """
    import xxhash

    spark, names = docs.sparkSession, [f"c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")
    plain = docs.withColumn("_key", row_key(docs)).toDF(*names, "key")
    whole = [T.StructField("sid", T.LongType()), T.StructField("other", T.LongType())]
    schema = T.StructType([*plain.schema.fields, *whole, T.StructField("n", T.IntegerType()), T.StructField("bits", T.BinaryType()), T.StructField("fp", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in small(batches, 200):
            sid, other, n, parity = [], [], [], []
            sets = [shingle_set(t) for t in b.column(text).to_pylist()]
            for s in sets:
                h = xxhash.xxh3_128_intdigest(s.tobytes(), SEED)
                sid.append(((h >> 64) >> (64 - bits)) - (1 << 63) if len(s) else 0)
                other.append((h & ((1 << 64) - 1)) - (1 << 63) if len(s) else 0)
                n.append(len(s))
                parity.append(parities(s).tobytes())
            more = [pa.array(sid, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int32()), pa.array(parity, pa.binary()), pa.array(fingerprints_of_sets(sets).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "sid", "other", "n", "bits", "fp"])

    doc_id = F.col(f"c{docs.columns.index('doc_id')}").cast("bigint")
    order = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.col("key"))
    own, name = F.col(f"r.c{docs.columns.index('doc_id')}").cast("bigint"), f"copies_{uuid.uuid4().hex}"
    hashed, value = plain.mapInArrow(tidy(run), schema), F.struct("n", "bits", "fp", "key", *names)
    row = F.struct(*[F.col(f"r.{c}") for c in names if c != f"c{text}"]).alias("row")

    def append(one: DataFrame) -> None:
        one = one.select("sid", "other", "shared", "r.n", "r.bits", "r.fp", "r.key", F.col(f"r.c{text}").alias("text"), own.isNull().alias("no_id"), own.alias("doc_id"), row)
        path = f"{work_dir(spark).rstrip('/')}/{name}"
        one.write.mode("append").format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), "sid").saveAsTable(name)

    least = F.min_by(value, F.struct("other", order)).alias("r")
    append(hashed.groupBy("sid").agg(least, F.min("other").alias("other"), (F.min("other") < F.max("other")).alias("shared")))
    shared = spark.table(name).filter("shared").select("sid", F.col("other").alias("first"))
    if shared.head(1):
        rest = hashed.join(written(shared, "copies-shared"), "sid").filter("other <> first").groupBy("sid", "other").agg(F.min_by(value, order).alias("r"))
        append(rest.select(F.col("other").alias("sid"), "other", F.lit(False).alias("shared"), "r"))
    out = spark.table(name).drop("other", "shared")
    out._sets_table = name
    return out


def drop_sets(rows: DataFrame) -> None:
    """Deletes the table behind a result of one_of_each that nothing reads any more."""
    spark, name = rows.sparkSession, getattr(rows, "_sets_table", None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark).rstrip('/')}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """a, b: candidates by SimHash. The index of op 4 links fingerprints, each stands for its least set; other sets of a fingerprint are
    paired with that one."""
    fps = written(sets.groupBy("fp").agg(F.min("sid").alias("least"), F.count("*").alias("n")), "copies-fingerprints")
    same = with_hot_keys(sets.select("fp", "sid"), fps, ["fp"], "n").filter("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    found = written(simhash_links(fps.select("fp")).filter("u <> v").distinct(), "copies-fingerprint-links")
    out = found
    for fp, side in (("u", "a"), ("v", "b")):
        least = found.groupBy(fp).agg(F.count("*").alias("n")).join(fps.select(F.col("fp").alias(fp), F.col("least").alias(side)), fp)
        out = with_hot_keys(out, written(least, "copies-least"), [fp], "n")
    return out.select("a", "b").unionByName(same)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample, sorted, and the places of their frequencies."""
    step = max(1, sets.count() // SAMPLE)
    some = sets.filter(F.pmod("sid", F.lit(step)) == 0).select("text")

    def run(batches):
        for b in small(batches, 200):
            for t in b.column(0).to_pylist():
                yield batch_of("h bigint", {"h": shingle_set(t)})

    rows = some.mapInArrow(tidy(run), "h bigint").groupBy("h").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()
    h = rows.column(0).to_numpy()
    order = np.argsort(h)
    return h[order], (len(h) - order).astype(np.int64)


_POSTING = "h bigint, sid bigint, pos bigint"


def postings(sets: DataFrame) -> DataFrame:
    """h, sid, pos (size of the set and place of h in its order, 32 bits each) of every shingle of a prefix."""
    sent = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def run(batches):
        common, rank = sent.value
        for b in small(batches, 200):
            h, sid, pos = [], [], []
            for t, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(t)
                first = prefix(s, common, rank)
                h.append(first)
                sid.append(np.full(len(first), i))
                pos.append((len(s) << 32) + np.arange(len(first)))
            yield batch_of(_POSTING, {k: np.concatenate(v) for k, v in (("h", h), ("sid", sid), ("pos", pos))})

    return sets.select("text", "sid").mapInArrow(tidy(run), _POSTING)


def _allowed(x: np.ndarray, y: np.ndarray, places: bool = True) -> np.ndarray:
    """Whether sizes (and places, in the same list) let the sets of two arrays of pos be similar."""
    n, m = x >> 32, y >> 32
    both = np.minimum(n - (x & 0xFFFFFFFF), m - (y & 0xFFFFFFFF)) if places else np.minimum(n, m)
    return OVER * both >= UNDER * (n + m)


_FOUND = "a bigint, b bigint, h bigint, pos bigint"


def _scan(batches, pairwise: int):
    """Candidate pairs (a, b) of sorted lists, and the members (a, h, pos) of the long ones. No more of a list is held than pairwise
    rows beside the batch at hand: of a long one, members go out as they come, paired with the two before."""
    held, long_key = [np.zeros(0, np.int64)] * 3, None

    def emit(a, b, h=None, pos=None):
        import pyarrow as pa

        none = pa.nulls(len(a), pa.int64())
        return batch_of(_FOUND, {"a": a, "b": none if b is None else b, "h": none if h is None else h, "pos": none if pos is None else pos})

    def pairs(h, sid, pos, most, places):
        for d in range(1, most + 1):
            at = np.flatnonzero(h[d:] == h[:-d])
            if not len(at):
                return
            at = at[_allowed(pos[at], pos[at + d], places)]
            yield emit(sid[at], sid[at + d])

    def lists(h, sid, pos, last):
        """Everything but a short list at the end, unless it is the last; tells what is held on to, and the key of a long list."""
        nonlocal long_key
        edge = np.append(0, np.flatnonzero(np.diff(h)) + 1)
        size = np.diff(np.append(edge, len(h)))
        is_long = (size > pairwise) | (h[edge] == long_key if long_key is not None else False)
        long_key = h[-1] if is_long[-1] else None
        if not is_long[-1] and not last:
            cut = edge[-1]
            size, is_long = size[:-1], is_long[:-1]
        else:
            cut = len(h)
        row = np.repeat(is_long, size)
        own = [x[:cut] for x in (h, sid, pos)]
        yield from pairs(*[x[~row] for x in own], pairwise - 1, True)
        if row.any():
            many = [x[row] for x in own]
            yield from pairs(*many, 2, False)
            fresh = slice(0, None)
            if len(done) and done[0] == many[0][0]:
                fresh = slice(len(done), None)  # rows of a long list that were held for pairing only
            yield emit(many[1][fresh], None, many[0][fresh], many[2][fresh])
        keep = max(cut - 2, edge[-1]) if long_key is not None else cut
        held[:] = [x[keep:] for x in (h, sid, pos)]
        done[:] = held[0].tolist() if long_key is not None else []

    done: list = []
    for b in batches:
        cols = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, b.columns, strict=True)]
        if len(cols[0]):
            yield from lists(*cols, False)
    if len(held[0]) and long_key is None:
        yield from lists(*held, True)


def _best(ci, cj, far, a, b):
    """Of each pair of components the FEW candidates with the least difference."""
    lo, hi = np.minimum(ci, cj), np.maximum(ci, cj)
    order = np.lexsort((b, a, far, hi, lo))
    new = np.flatnonzero(np.append(True, (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)))
    nth = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    order = order[nth < FEW]
    return tuple(x[order] for x in (ci, cj, far, a, b))


def _across(batches, few: bool):
    """Candidate pairs of different components within groups of equal (h, s, t): of block s with block t, where sizes, places
    and parities allow; with few, those of each pair of components that are closest."""
    left = None

    def group(h, s, t, block, sid, pos, comp, bits):
        folded, other = {}, np.flatnonzero(block == t)
        size = np.array([len(x) for x in bits])
        for z in np.unique(size[other]):
            rows = other[size[other] == z]
            m = np.array([np.frombuffer(bits[i], np.uint64) for i in rows])
            folded[z] = (rows, m, m.reshape(len(rows), 2, -1) if z > 8 else None)
        got, held = [], 0
        for i in np.flatnonzero(block == s):
            own = np.frombuffer(bits[i], np.uint64)
            for z in (size[i] // 2, size[i], 2 * size[i]):
                if z not in folded:
                    continue
                rows, m, halves = folded[z]
                ok = _allowed(np.broadcast_to(pos[i], len(rows)), pos[rows]) & (comp[rows] != comp[i])
                if s[0] == t[0]:
                    ok &= sid[rows] > sid[i]
                if not ok.any():
                    continue
                if z == size[i]:
                    x, y = own, m[ok]
                elif z < size[i]:
                    x, y = np.bitwise_xor(*own.reshape(2, -1)), m[ok]
                else:
                    x, y = own, np.bitwise_xor(halves[ok, 0], halves[ok, 1])
                rows, far = rows[ok], np.bitwise_count(x ^ y).sum(axis=1)
                near = (OVER - 2 * UNDER) * ((pos[i] >> 32) + (pos[rows] >> 32)) >= OVER * far
                rows = rows[near]
                got.append((np.full(len(rows), comp[i]), comp[rows], far[near], np.full(len(rows), sid[i]), sid[rows]))
                held += len(rows)
            if held > 1 << 16:
                got = [tuple(np.concatenate(x) for x in zip(*got, strict=True))]
                if few:
                    got = [_best(*got[0])]
                else:
                    yield from got
                    got = []
                held = 0
        if got:
            last = tuple(np.concatenate(x) for x in zip(*got, strict=True))
            yield _best(*last) if few else last

    def out(cols, upto):
        edge = np.flatnonzero((np.diff(cols[0][:upto]) != 0) | (np.diff(cols[1][:upto]) != 0) | (np.diff(cols[2][:upto]) != 0)) + 1
        for lo, hi in zip(np.append(0, edge), np.append(edge, upto), strict=True):
            for _, _, _, a, b in group(*[c[lo:hi] for c in cols]):
                yield batch_of("a bigint, b bigint", {"a": a, "b": b})

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = cols if left is None else [np.concatenate(x) for x in zip(left, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        upto = int(np.argmax(same))
        if upto:
            yield from out(cols, upto)
        left = [c[upto:] for c in cols]
    if left is not None and len(left[0]):
        yield from out(left, len(left[0]))


def _rest(members: DataFrame, roots: DataFrame, few: bool) -> DataFrame:
    """a, b: candidates of long lists that lie in different components."""
    comp = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("h", "sid", "pos", "bits", F.coalesce("root", "sid").alias("comp"))
    comp = written(comp, "copies-members")
    mixed = comp.groupBy("h").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = with_hot_keys(comp, written(mixed.select("h", "size", blocks.alias("blocks")), "copies-mixed"), ["h"], "size")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("h", F.least("block", "other").alias("s"), F.greatest("block", "other").alias("t"), "block", "sid", "pos", "comp", "bits")
    dealt = rows.repartition(partitions(members.sparkSession), "h", "s", "t").sortWithinPartitions("h", "s", "t")
    return dealt.mapInArrow(tidy(partial(_across, few=few)), "a bigint, b bigint")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: the pairs (a, b) whose whole sets are similar. Parities rule most others out; of what is left, the text of one of
    a pair travels to where the other one lies."""
    import pyarrow as pa

    def alike(batches):
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                ok.append((OVER - 2 * UNDER) * (n + m) >= OVER * least_difference(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verify(batches):
        for batch in small(batches, 500):
            last, s, ok = None, None, []
            for _, b, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != last:
                    last, s = b, shingle_set(y)
                r = shingle_set(x)
                ok.append(OVER * len(np.intersect1d(r, s, assume_unique=True)) >= UNDER * (len(r) + len(s)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def beside(rows: DataFrame, *columns: str) -> DataFrame:
        each = rows.select(F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("sid")) for side in ("a", "b")])).alias("x"))
        often = each.groupBy("x").count().filter(F.col("count") > MANY).orderBy(F.desc("count"), "x").limit(HOT).select("x.side", "x.sid").collect()
        for side in ("a", "b"):
            own, many = sets.select(F.col("sid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), [r["sid"] for r in often if r["side"] == side]
            hot = F.col(side).isin(many)
            rows = rows.filter(~hot).join(own, side).unionByName(rows.filter(hot).join(F.broadcast(own.filter(hot)), side)) if many else rows.join(own, side)
        return rows.select("a", "b", *[f"{c}_{side}" for c in columns for side in ("a", "b")])

    some = written(beside(written(pairs.distinct(), "copies-pairs"), "n", "bits").mapInArrow(tidy(alike), "a bigint, b bigint"), "copies-candidates")
    return written(beside(some, "text").mapInArrow(tidy(verify), "a bigint, b bigint").toDF("u", "v"), "copies-links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each group: the least row by doc_id (null last), then by all columns."""
    sets = distinct_sets(docs)
    links = _similar(fingerprint_pairs(sets), sets)
    roots = written(components(links), "copies-roots")
    # what SimHash has left apart
    lists = postings(sets).repartition(partitions(docs.sparkSession), "h").sortWithinPartitions("h", "pos", "sid")
    found = written(lists.mapInArrow(tidy(partial(_scan, pairwise=PAIRWISE)), _FOUND), "copies-found")
    links = links.unionByName(_similar(_apart(found.filter("b is not null").select("a", "b"), roots), sets))
    roots = written(components(links), "copies-roots")
    members = found.filter("h is not null").select(F.col("a").alias("sid"), "h", "pos")
    if members.head(1):
        members = written(members.join(sets.select("sid", "bits"), "sid"), "copies-long")
        for few in (True, False):  # first what brings components together, so that little is left to compare
            links = links.unionByName(_similar(_rest(members, roots, few), sets))
            roots = written(components(links), "copies-roots")
    named = sets.select("sid", "no_id", "doc_id", "key").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    keep = named.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min(F.struct("no_id", "doc_id", "key", "sid")).alias("row")).select("row.sid")
    out = sets.join(written(keep, "copies-kept"), "sid", "left_semi")
    got = out.select(*[(F.col("text") if c == "text" else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
    got._sets_table = sets._sets_table
    return got
