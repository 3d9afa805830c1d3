"""Token ids in files: canonical length-limited Huffman codes, decoded by table in independent blocks.

Ids are counted over the whole corpus; the counts of at most one vocabulary come to the driver, where package-merge finds
code lengths of at most MAX_BITS. The codes are canonical, so the lengths alone are the code book. Documents are put in
ascending doc_id order (null first) and written in blocks of whole documents. A block's payload is

    magic, number of ids, number of checkpoints, bits; one 64-bit bit offset for every CHECKPOINT ids; 64-bit words of codes

and can be decoded without any other block. Decoding looks up MAX_BITS bits at a time in one table; all checkpoints of a
block advance side by side. The container is Parquet: doc_ids and id counts of a block beside its payload, with the place
of the block in the order (`_part`, `_block`).

Null text is empty: a document of the end id alone. Rows that repeat a doc_id follow each other in the order of their ids. A
block holds whole documents, so a very long one is a block of its own. An empty table gives no blocks. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, before, partitions, removed, small, table, tidy, written

END_ID, VOCABULARY = 2, 49408
MAX_BITS, CHECKPOINT, BLOCK_IDS = 18, 128, 1 << 17
MAGIC, _HEAD = b"FLHC", struct.Struct("<4sIIQ")

_IDS = "doc_id bigint, n bigint, ids binary"


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n, ids (little-endian unsigned 16-bit, with the end id). A tokenizer or end id beyond VOCABULARY is an error."""
    from tokenizers import Tokenizer

    last = max(end_id, *Tokenizer.from_file(tokenizer_path).get_vocab().values())
    if last >= VOCABULARY:
        raise ValueError(f"ids up to {last}: only those below {VOCABULARY} can be written")

    def run(batches):
        from .tokens import tokenizer

        tok = tokenizer(tokenizer_path, "word")
        for b in small(batches):
            doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for first, ids, off in tok.encode(texts):
                own = [np.append(ids[a:z], np.uint32(end_id)).astype("<u2").tobytes() for a, z in zip(off, off[1:], strict=False)]
                yield batch_of(_IDS, {"doc_id": doc_ids[first : first + len(own)], "n": [len(x) // 2 for x in own], "ids": own})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), _IDS)


def counted(ids: DataFrame, vocabulary: int = VOCABULARY) -> np.ndarray:
    """How often each id occurs; counted in each task, then added up."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield batch_of("id int, n bigint", {"id": at.astype(np.int32), "n": total[at]})

    out = np.zeros(vocabulary, np.int64)
    for i, n in ids.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `most` bits (0: id does not occur), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError("too many ids for this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # each level: merged list of leaves and packages of the level below; only whether an entry is a leaf is kept
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        both = np.concatenate([weight, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        merged = both[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes (uint64): by length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    # the Kraft sum before a code, in units of the longest one, is the code shifted to full width
    before_ = np.cumsum(1 << (64 - 2 - size)) - (1 << (62 - size))
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (before_ >> (62 - size)).astype(np.uint64)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ids) else 0
    words = np.zeros(bits // 64 + 2, np.uint64)
    if len(ids):
        word, offset, code = at >> 6, at & 63, codes[ids]
        room = 64 - offset - size
        part = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(part, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    marks = at[::CHECKPOINT].astype("<u8")
    return _HEAD.pack(MAGIC, len(ids), len(marks), bits) + marks.tobytes() + words.astype("<u8").tobytes()


def decode_table(lengths: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every value of the next `most` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (most - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << most, np.int32), np.ones(1 << most, np.int64)
    n = int(spans.sum())
    ids[:n], sizes[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes


def decode(payload: bytes, lookup: tuple[np.ndarray, np.ndarray], most: int = MAX_BITS) -> np.ndarray:
    magic, n, marks, _ = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    at = np.frombuffer(payload, "<u8", marks, _HEAD.size).astype(np.int64)
    words = np.frombuffer(payload, "<u8", -1, _HEAD.size + 8 * marks).astype(np.uint64)
    ids, sizes = lookup
    out = np.zeros((CHECKPOINT, max(marks, 1)), np.int32)
    for step in range(min(CHECKPOINT, n)):
        live = marks if step < n - (marks - 1) * CHECKPOINT else marks - 1
        if not live:
            break
        p = at[:live]
        word, offset = p >> 6, (p & 63).astype(np.uint64)
        # shifts by 64 are avoided: the second word is shifted in two steps
        window = (words[word] << offset) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - offset))
        peek = (window >> np.uint64(64 - most)).astype(np.int64)
        out[step, :live] = ids[peek]
        at[:live] = p + sizes[peek]
    return out.T.ravel()[:n]


_BLOCK = "_part bigint, _block bigint, total bigint, doc_ids array<bigint>, counts array<bigint>, payload binary"


def write(ids: DataFrame, lengths: np.ndarray, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The container of all documents of token_ids() (written), as a written table."""
    book = ids.sparkSession.sparkContext.broadcast((lengths, canonical(lengths)))
    n = partitions(ids.sparkSession)
    line = ids.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "n").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")

    def run(batches):
        from pyspark import TaskContext

        part, block, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            data = np.frombuffer(b"".join(held), "<u2")
            return batch_of(_BLOCK, {"_part": [part], "_block": [block], "total": [len(data)], "doc_ids": [names], "counts": [[len(x) // 2 for x in held]], "payload": [encode(data, *book.value)]})

        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                held.append(x.as_py())
                names.append(doc_id)
                size += len(held[-1]) // 2
                if size >= block_ids:
                    yield flush()
                    block, held, names, size = block + 1, [], [], 0
        if held:
            yield flush()

    return written(line.mapInArrow(tidy(run), _BLOCK), "ids-blocks")


_DOC = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


def read(container: DataFrame, lengths: np.ndarray, keep_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit)."""
    heads = container.select("_part", "_block", "total")
    w = Window.partitionBy("_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    places = before(heads, {"_earlier": F.col("total")}).withColumn("first", (F.col("_earlier") + F.coalesce(F.sum("total").over(w), F.lit(0))).cast("bigint"))
    rows = container.join(places.select("_part", "_block", "first"), ["_part", "_block"]).select("first", "doc_ids", "counts", "payload")
    sent = container.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        lookup = decode_table(sent.value)
        for b in batches:
            for first, doc_ids, counts, payload in zip(*b.columns, strict=True):
                data, at = decode(payload.as_py(), lookup).astype("<u4").tobytes(), 0
                out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
                for doc_id, n in zip(doc_ids.as_py(), counts.as_py(), strict=True):
                    own = data[4 * at : 4 * (at + n)]
                    for k, v in zip(out, (doc_id, first.as_py() + at, n, zlib.crc32(own), own if keep_ids else None), strict=True):
                        out[k].append(v)
                    at += n
                yield batch_of(_DOC, out)

    return rows.mapInArrow(tidy(run), _DOC)


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The container and its code book (id, length), both written."""
    import public_tokenizers

    ids = written(token_ids(docs, tokenizer_path or public_tokenizers.path("word_bpe_49k.json")), "ids")
    lengths = code_lengths(counted(ids))
    book = docs.sparkSession.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int")
    out = write(ids, lengths), written(book.coalesce(1), "ids-book")
    removed(ids)
    return out


def book_lengths(book: DataFrame, vocabulary: int = VOCABULARY) -> np.ndarray:
    out = np.zeros(vocabulary, np.uint8)
    for i, n in book.collect():  # one vocabulary at most
        out[i] = n
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    container, book = encode_documents(table(spark, sf_dir, "documents"))
    return read(container, book_lengths(book), keep_ids=False).drop("ids")
