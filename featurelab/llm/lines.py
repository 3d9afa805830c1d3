"""Line dedup: lines that many documents share stay in one document only; the result is a bitmap of kept lines for each document.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key counts if it has at least MIN_CHARS code
points and occurs in at least MIN_DOCS documents; its lines are dropped everywhere but in the largest doc_id that holds it.

Texts are read where they are and give one row for each different counting key of a document: a 128-bit digest, the document and
the places of its lines. These rows are range-partitioned by digest, document (largest first) and first place, sorted, and streamed:
the first document of a digest keeps its lines, the next ones wait until the fifth shows that the key is common. The sampled
ranges cut a hot digest into several tasks. A run of one digest that touches the beginning or end of its task, or in which too
many rows wait, is left open: its rows pass through, and a summary of each task's part of it settles them afterwards.

Null text is one empty line, as is the empty text. Rows are told apart by doc_id and text; equal rows have equal bitmaps. Rows
with one doc_id are one document for counting, whatever their texts, and so are all rows with null doc_id, which is smaller than
any other. A text is split in one task, whatever its length. An empty table gives an empty result. Only doc_id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, matched, partitions, small, table, tidy, written

MIN_CHARS, MIN_DOCS = 40, 5
BLANK = b" \t\n\x0b\x0c\r"
#: Rows of one digest that may wait for more documents before its run is left open.
WAITING = 50_000

_OCCURRENCE = "digest binary, doc_id bigint, h bigint, place int, places binary"
_STREAMED = "digest binary, doc_id bigint, h bigint, places binary, part int, docs bigint, first_doc bigint, last_doc bigint"


def text_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def keyed(text: str, min_chars: int = MIN_CHARS) -> dict[bytes, list[int]]:
    """Digest -> places of the lines, for keys of at least min_chars code points."""
    out: dict[bytes, list[int]] = {}
    for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line) < min_chars:
            continue
        key = line.strip(BLANK).lower()  # of bytes: A-Z alone
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            out.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(k)
    return out


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """digest, doc_id, h (of the text), place (the first), places (32 bits each): one row for each document and key."""

    def run(batches):
        for b in small(batches, 200):
            rows: dict[str, list] = {"digest": [], "doc_id": [], "h": [], "place": [], "places": []}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = keyed(text or "", min_chars)
                if not found:
                    continue
                n = len(found)
                rows["digest"] += found
                rows["doc_id"] += [doc_id] * n
                rows["h"] += [text_hash(text.encode("utf-8", "surrogatepass"))] * n
                rows["place"] += [p[0] for p in found.values()]
                rows["places"] += [np.array(p, "<i4").tobytes() for p in found.values()]
            yield batch_of(_OCCURRENCE, rows)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), _OCCURRENCE)


def stream(rows, part: int, min_docs: int = MIN_DOCS, waiting: int = WAITING):
    """The drops among sorted rows (digest, doc_id, h, places) of one range, in its order, as rows of _STREAMED.

    Rows with places but no digest are settled: these lines go. Rows with digest and places are open. Rows without places sum up an open run,
    or the last one: its documents, first and last. At most `waiting` rows are held.
    """
    digest, first, last, docs, is_open, wait, begun = None, None, None, 0, False, [], False

    def opened():
        return [(digest, d, h, p, part, None, None, None) for d, h, p in wait]

    def closed(at_end: bool):
        # a run that ends with its range may go on in the next one
        if digest is not None and (is_open or at_end):
            yield from opened()
            yield digest, None, None, None, part, docs, first, last

    for g, doc_id, h, places in rows:
        if g != digest:
            yield from closed(False)
            digest, first, last, docs, is_open, wait = g, doc_id, doc_id, 1, not begun, []
            begun = True
        elif doc_id != last:
            last, docs = doc_id, docs + 1
        if is_open:
            yield g, doc_id, h, places, part, None, None, None
        elif docs >= min_docs:
            for d, x, p in wait:
                if d != first:
                    yield None, d, x, p, part, None, None, None
            wait = []
            if doc_id != first:
                yield None, doc_id, h, places, part, None, None, None
        else:
            wait.append((doc_id, h, places))
            if len(wait) > waiting:
                is_open = True
                yield from opened()
                wait = []
    yield from closed(True)


def streamed(found: DataFrame, min_docs: int = MIN_DOCS, waiting: int = WAITING) -> DataFrame:
    """The rows of stream() over all ranges of the written rows of occurrences()."""
    order = ["digest", F.col("doc_id").desc_nulls_last(), "place", "h"]
    line = found.repartitionByRange(partitions(found.sparkSession), *order).sortWithinPartitions(*order).select("digest", "doc_id", "h", "places")

    def run(batches):
        from itertools import islice

        from pyspark import TaskContext

        def rows():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        names = [f.split(" ")[0] for f in _STREAMED.split(", ")]
        out = stream(rows(), TaskContext.get().partitionId(), min_docs, waiting)
        while some := list(islice(out, 8192)):
            yield batch_of(_STREAMED, dict(zip(names, map(list, zip(*some, strict=True)), strict=True)))

    return line.mapInArrow(tidy(run), _STREAMED)


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, waiting: int = WAITING) -> DataFrame:
    """doc_id, h, places of all lines that go."""
    found = written(occurrences(docs, min_chars), "lines-found")
    got = written(streamed(found, min_docs, waiting), "lines-streamed")
    runs = got.filter("docs is not null").select("digest", "part", "docs", "first_doc", "last_doc")
    by = Window.partitionBy("digest").orderBy("part")  # as many rows as ranges
    # a document whose rows two ranges share counts once
    twice = F.when(F.lag("part").over(by).isNotNull() & F.lag("last_doc").over(by).eqNullSafe(F.col("first_doc")), 1).otherwise(0)
    top = F.min_by(F.struct("first_doc"), "part").alias("top")
    common = runs.withColumn("twice", twice).groupBy("digest").agg((F.sum("docs") - F.sum("twice")).alias("docs"), top).filter(F.col("docs") >= min_docs)
    open_rows = got.filter("digest is not null and places is not null").select("digest", "doc_id", "h", "places")
    # written, so that its true size decides whether the open rows stay where they are
    late = open_rows.join(written(common.select("digest", "top"), "lines-common"), "digest").filter(~F.col("doc_id").eqNullSafe(F.col("top.first_doc")))
    return got.filter("digest is null").select("doc_id", "h", "places").unionByName(late.select("doc_id", "h", "places"))


def packed(places: list[bytes]) -> tuple[bytes, int]:
    """A compressed bitmap (lowest bit first, 1: the line stays) up to the last dropped line, after which all stay; and the number of drops."""
    at = np.unique(np.concatenate([np.frombuffer(p, "<i4") for p in places]))
    bits = np.ones((int(at[-1]) // 8 + 1) * 8, np.uint8)
    bits[at] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6), len(at)


def stays(bitmap: bytes | None, n: int) -> np.ndarray:
    """For n lines, whether each stays."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, waiting: int = WAITING) -> DataFrame:
    """doc_id, h, n_dropped, bitmap of each document that loses lines; all lines of the others stay."""
    schema = "doc_id bigint, h bigint, n_dropped bigint, bitmap binary"
    # each set is of one document's places, copies of it add nothing
    each = dropped(docs, min_chars, min_docs, waiting).groupBy("doc_id", "h").agg(F.collect_set("places").alias("places"))

    def run(batches):
        for b in batches:
            got = [packed(p) for p in b.column(2).to_pylist()]
            yield batch_of(schema, {"doc_id": b.column(0), "h": b.column(1), "n_dropped": [n for _, n in got], "bitmap": [m for m, _ in got]})

    return each.mapInArrow(run, schema)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text (never null), bitmap (null: all lines stay) of every row of docs. bitmaps is a written table."""
    schema = "doc_id bigint, text string, h bigint"

    def run(batches):
        for b in small(batches, 200):
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield batch_of(schema, {"doc_id": b.column(0), "text": texts, "h": [text_hash(t.encode("utf-8", "surrogatepass")) for t in texts]})

    hashed = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), schema)
    # one plan at all sizes: texts are exchanged once, frequent keys' partitions can be split
    return matched(hashed, bitmaps.select("doc_id", "h", "bitmap").hint("merge"), ["doc_id", "h"], "left").select("doc_id", "text", "bitmap")


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text (kept lines), n_lines (before), n_dropped of every row of docs."""
    return _applied(docs, keep_bitmaps(docs, min_chars, min_docs), "doc_id bigint, text string, n_lines bigint, n_dropped bigint", lambda kept: ("text", kept))


def _applied(docs: DataFrame, bitmaps: DataFrame, schema: str, made) -> DataFrame:
    def run(batches):
        for b in small(batches, 200):
            n_lines, n_dropped, values, name = [], [], [], made("")[0]
            for text, bitmap in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = text.count("\n") + 1
                keep = stays(bitmap, n)
                lost = n - int(keep.sum())
                kept = "\n".join([x for x, k in zip(text.split("\n"), keep, strict=True) if k]) if lost else text
                n_lines.append(n)
                n_dropped.append(lost)
                values.append(made(kept)[1])
            yield batch_of(schema, {"doc_id": b.column(0), "n_lines": n_lines, "n_dropped": n_dropped, name: values})

    return with_bitmaps(docs, written(bitmaps, "lines-bitmaps")).mapInArrow(tidy(run), schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda kept: ("kept_sha256", hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
    return _applied(docs, keep_bitmaps(docs), "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string", digest)


OP13_SQL = r"""
WITH lines AS (
  SELECT row, doc_id, k, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (
    SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), common AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5
), marked AS (
  SELECT row, doc_id, k, line, common.key IS NOT NULL AND doc_id IS DISTINCT FROM top AS gone FROM lines LEFT JOIN common USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row
"""
