"""Token counts that follow edits: a segment tree of pre-tokens for each document.

The leaves of a document's tree hold LEAF pre-tokens each (their text and token counts), inner nodes the sums of code points
and tokens below. An edit (position, deleted code points, inserted text) descends by the sums of code points to the leaves it
touches. The region is widened to the left until it has CONTEXT pre-tokens before the edit, which is as far back as
splitting looks ahead, and to the right until its end is a place where the new text is split as the old one was; splitting
is without memory, so everything after that place keeps its counts. The region alone is split and counted again, its leaves
are refilled, and the sums above them are updated. The regions of many documents are split by one pass: a tree asks for the split of a
text, and what the trees of a batch ask for is answered together.

The trees are kept in a table beside their texts (count_trees): the sizes and counts of all pre-tokens and the sums of all
nodes. Counts after edits (edited_tree_counts) and the trees after them (edited_trees) come from that table; the text outside
the touched regions is neither split nor encoded again.

Positions beyond the text are at its end. Edits apply one after another, by seq, each to the text that the ones before it
left. Null text is empty; null inserted text is empty; null position or deleted count is 0. Edits with equal seq go by position.
Every row of a repeated doc_id gets all edits of that doc_id. A text's tree is held in one task. An empty table gives an empty
result. Only doc_id, text and edits are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batch_of, small, table, tidy, written

LEAF, CONTEXT, LOOK = 32, 4, 16


def _packed(values: np.ndarray) -> bytes:
    """Counts in the fewest whole bytes each: 1, 4 or 8."""
    most = int(values.max()) if len(values) else 0
    return values.astype("<u1" if most < 1 << 8 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n if n else 1}").astype(np.int64)


def _leaves(pretokens: int) -> int:
    """Leaves of a tree over so many pre-tokens: a power of two."""
    return 1 << (max(1, -(-pretokens // LEAF)) - 1).bit_length()


class SegmentTree:
    """Token counts of one text, by a FastTokenizer. Pre-tokens come as ends (code points) and counts; sums (code points,
    tokens) are those of a stored tree. A leaf is taken from them when an edit first reads it."""

    def __init__(self, tok, text: str, ends: np.ndarray, counts: np.ndarray, sums: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.tok, self.recounted = tok, 0
        self.size = _leaves(len(ends))
        self._given, self._read = (text, ends, counts), {}
        self.chars, self.tokens = sums or (self._sums(np.diff(ends, prepend=0)), self._sums(counts))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        out, step = np.zeros(2 * self.size, np.int64), self.size
        if len(values):
            each = np.add.reduceat(values, np.arange(0, len(values), LEAF), dtype=np.int64)
            out[step : step + len(each)] = each
        while step > 1:
            out[step // 2 : step] = out[step : 2 * step : 2] + out[step + 1 : 2 * step : 2]
            step //= 2
        return out

    def _leaf(self, leaf: int) -> tuple[str, np.ndarray, np.ndarray]:
        """Text, ends and counts of a leaf."""
        if leaf not in self._read:
            text, ends, counts = self._given
            a = min(leaf * LEAF, len(ends))
            b = min(a + LEAF, len(ends))
            begin, end = (int(ends[i - 1]) if i else 0 for i in (a, b))
            self._read[leaf] = text[begin:end], ends[a:b] - begin, counts[a:b]
        return self._read[leaf]

    def _fill(self, leaf: int, text: str, ends: np.ndarray, counts: np.ndarray) -> None:
        self._read[leaf] = text, ends, counts
        self.chars[self.size + leaf], self.tokens[self.size + leaf] = len(text), counts.sum()

    def _up(self, leaf: int) -> None:
        i = (self.size + leaf) // 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def whole(self) -> str:
        return "".join(self._leaf(i)[0] for i in range(self.size))

    def evened(self) -> SegmentTree:
        """The tree of the text as it is now, with LEAF pre-tokens in each leaf again; nothing is split or encoded."""
        if not self._read:
            return self
        leaves = [self._leaf(i) for i in range(self.size)]
        sizes = np.concatenate([np.diff(e, prepend=0) for _, e, _ in leaves])
        return SegmentTree(self.tok, "".join(t for t, _, _ in leaves), np.cumsum(sizes), np.concatenate([c for _, _, c in leaves]))

    def row(self) -> dict:
        """What a table keeps of the tree."""
        text, ends, counts = self._given
        arrays = {"sizes": np.diff(ends, prepend=0), "counts": counts, "char_sums": self.chars, "token_sums": self.tokens}
        return {"text": text, "n_chars": self.length, "n_tokens": self.total, "n_pretokens": len(ends)} | {k: _packed(v) for k, v in arrays.items()}

    @staticmethod
    def of_row(tok, row: dict) -> SegmentTree:
        n = row["n_pretokens"]
        sums = tuple(_unpacked(row[k], 2 * _leaves(n)) for k in ("char_sums", "token_sums"))
        return SegmentTree(tok, row["text"], np.cumsum(_unpacked(row["sizes"], n)), _unpacked(row["counts"], n), sums)

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position (the last one with text at the end), and where the leaf begins."""
        i, begin = 1, 0
        while i < self.size:
            left = int(self.chars[2 * i])
            if position - begin < left or not self.chars[2 * i + 1]:
                i = 2 * i
            else:
                begin += left
                i = 2 * i + 1
        return i - self.size, begin

    def edit(self, position: int, deleted: int, inserted: str) -> None:
        answered(self.tok, [self.steps(position, deleted, inserted)])

    def steps(self, position: int, deleted: int, inserted: str):
        """An edit that asks for the splits it needs: yields a text and is sent the ends and counts of its pre-tokens."""
        position = min(max(position, 0), self.length)
        deleted = min(max(deleted, 0), self.length - position)
        lo, begin = self.find(max(position - 1, 0))
        hi, hi_begin = self.find(min(position + deleted, max(self.length - 1, 0)))
        hi = max(hi, lo)
        before = int(np.searchsorted(self._leaf(lo)[1], position - begin, side="left"))
        while lo > 0 and before < CONTEXT:
            lo -= 1
            begin -= len(self._leaf(lo)[0])
            before += len(self._leaf(lo)[1])
        while True:
            old = "".join(self._leaf(i)[0] for i in range(lo, hi + 1))
            new = old[: position - begin] + inserted + old[position - begin + deleted :]
            rest, k = "", hi + 1
            while k < self.size and len(rest) < LOOK:
                rest += self._leaf(k)[0]
                k += 1
            ends, counts = yield new + rest
            done = int(np.searchsorted(ends, len(new), side="right"))
            # the region ends where a pre-token ends, and all of the edit lies before the last of them
            settled = (done and ends[done - 1] == len(new)) or not new
            if not rest or (settled and len(old) - (position - begin + deleted) > 0):
                break
            hi += 1
        ends, counts = ends[:done], counts[:done]
        self.recounted += done
        many, at = hi - lo + 1, 0
        cuts = [done * (i + 1) // many for i in range(many)]
        for i, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
            end = int(ends[b - 1]) if b else 0
            end = max(end, at)
            self._fill(lo + i, new[at:end], ends[a:b] - at, counts[a:b])
            at = end
        for leaf in range(lo, hi + 1):
            self._up(leaf)


def splits(tok, texts: list[str]):
    """Ends and counts of the pre-tokens of every text, by passes over many."""
    for _, k, joined, bounds, spans in tok.blocks(texts):
        _, ends, entry = tok.pieces(joined, bounds, spans)
        lens = tok.table.len[entry]
        cut = np.searchsorted(ends, np.append(bounds, len(joined)), side="right").tolist()
        for i in range(k):
            yield ends[cut[i] : cut[i + 1]] - bounds[i], lens[cut[i] : cut[i + 1]]


def answered(tok, steps: list) -> None:
    """Runs generators that ask for splits (SegmentTree.steps); of each, one text at a time."""
    asked = [(s, t) for s in steps if (t := next(s, None)) is not None]
    while asked:
        more = []
        for (s, _), got in zip(asked, splits(tok, [t for _, t in asked]), strict=True):
            try:
                more.append((s, s.send(got)))
            except StopIteration:
                pass
        asked = more


_TREE = "doc_id bigint, text string, n_chars bigint, n_tokens bigint, n_pretokens bigint, sizes binary, counts binary, char_sums binary, token_sums binary"
_COUNTS = "doc_id bigint, n_chars bigint, n_tokens bigint, n_pretokens bigint, edited_chars bigint, edited_tokens bigint, recounted bigint"
_NAMES = [f.split(" ")[0] for f in _TREE.split(", ")]


def _path(tokenizer_path: str | None) -> str:
    import public_tokenizers

    return tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")


def count_trees(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The tree of every row of docs (doc_id, text; edits, if docs has them, stay beside it). To be written once: whole texts
    are split and encoded nowhere else."""
    path = _path(tokenizer_path)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", *["edits"] * ("edits" in docs.columns))
    schema = StructType([*StructType.fromDDL(_TREE).fields, *docs.schema.fields[2:]])

    def run(batches):
        from .tokens import tokenizer

        tok = tokenizer(path, "byte")
        for b in small(batches):
            doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for first, k, joined, bounds, spans in tok.blocks(texts):
                _, ends, entry = tok.pieces(joined, bounds, spans)
                lens = tok.table.len[entry]
                cut = np.searchsorted(ends, np.append(bounds, len(joined)), side="right")
                rows = []
                for i in range(k):
                    own = slice(cut[i], cut[i + 1])
                    rows.append({"doc_id": doc_ids[first + i]} | SegmentTree(tok, texts[first + i], ends[own] - bounds[i], lens[own]).row())
                out = batch_of(_TREE, {n: [r[n] for r in rows] for n in _NAMES})
                for name, column in list(zip(b.schema.names, b.columns, strict=True))[2:]:
                    out = out.append_column(name, column.slice(first, k))
                yield out

    return docs.mapInArrow(tidy(run), schema)


def _edited(trees: DataFrame, tokenizer_path: str | None, ddl: str, result) -> DataFrame:
    """result(row, tree after its edits) for every row of trees with `edits`."""
    path = _path(tokenizer_path)
    names = [f.split(" ")[0] for f in ddl.split(", ")]

    def in_order(tree, edits):
        for e in sorted((x for x in edits or [] if x), key=lambda x: (x["seq"] or 0, x["position"] or 0)):
            yield from tree.steps(e["position"] or 0, e["deleted"] or 0, e["inserted"] or "")

    def run(batches):
        from .tokens import tokenizer

        tok = tokenizer(path, "byte")
        for b in small(batches):
            out, kept = {n: [] for n in names}, b.to_pylist()
            trees = [SegmentTree.of_row(tok, row) for row in kept]
            answered(tok, [in_order(tree, row["edits"]) for tree, row in zip(trees, kept, strict=True)])
            for row, tree in zip(kept, trees, strict=True):
                got = result(row, tree)
                for n in names:
                    out[n].append(got[n])
            yield batch_of(ddl, out)

    return trees.select(*_NAMES, "edits").mapInArrow(tidy(run), ddl)


def edited_trees(trees: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The trees (of count_trees or this, with `edits`: array of (seq, position, deleted, inserted)) after their edits."""
    return _edited(trees, tokenizer_path, _TREE, lambda row, tree: {"doc_id": row["doc_id"]} | tree.evened().row())


def edited_tree_counts(trees: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Counts of every row of trees (with `edits`) before and after its edits."""
    after = lambda tree: {"edited_chars": tree.length, "edited_tokens": tree.total, "recounted": tree.recounted}
    return _edited(trees, tokenizer_path, _COUNTS, lambda row, tree: row | after(tree))


def edited_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Counts of every row of docs (doc_id, text, edits: array of (seq, position, deleted, inserted)) before and after, where
    no trees are kept."""
    return edited_tree_counts(written(count_trees(docs, tokenizer_path), "count-trees"), tokenizer_path)


def with_edit_log(docs: DataFrame, log: DataFrame) -> DataFrame:
    """docs or trees with the edits of a log (doc_id, seq, position, deleted, inserted) as an array."""
    by_doc = log.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "position", "deleted", "inserted")).alias("edits"))
    own = _NAMES if set(_NAMES) <= set(docs.columns) else ["doc_id", "text"]
    return docs.select(*own).join(by_doc, "doc_id", "left")


def sample_edits(text: Column) -> Column:
    """Three edits: words put in at a third, a passage replaced at two thirds, the first code point deleted."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    third = F.floor(n / 3).cast("bigint")
    edit = lambda seq, position, deleted, inserted: F.struct(F.lit(seq).alias("seq"), position.alias("position"), F.lit(deleted).cast("bigint").alias("deleted"), F.lit(inserted).alias("inserted"))
    return F.array(edit(1, third, 0, " it's 12,345 new words"), edit(2, third * 2, 40, "\n\n naïve  text"), edit(3, F.lit(0).cast("bigint"), 1, ""))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = written(count_trees(docs.select("doc_id", "text")), "count-trees")
    return edited_tree_counts(trees.withColumn("edits", sample_edits(F.col("text"))))
