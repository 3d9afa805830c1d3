"""Fast, exact use of the two public BPE tokenizers on whole texts.

Both tokenizers split a text into pre-tokens by a fixed pattern and encode every pre-token on its own. The splitting is
done here for a whole block of texts at once with numpy; each distinct pre-token is encoded by the ``tokenizers`` library
once and remembered in a table of bounded size. It is found again by a 64-bit hash, and its code points are compared. The ids
are those that the library gives for the text with add_special_tokens=False: the string of a special token gives that token.
A text of more than BLOCK_CHARS code points is encoded in parts, cut where a pre-token begins with a blank in any case.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np

#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points that one numpy pass covers, besides a longer single text.
BLOCK_CHARS = 1 << 18
#: Distinct pre-tokens remembered at most; beyond that the table starts anew.
MAX_ENTRIES = 400_000
#: A blank at which a text may be cut: whatever stands around it, a pre-token begins there.
_CUT = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties L, N and White_Space."""
    global _classes
    if _classes is None:
        import regex

        table = np.zeros(0x110000, np.uint8)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            every = "".join(map(chr, range(lo, hi)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(pattern, every):
                    table[lo + m.start() : lo + m.end()] = kind
        _classes = table
    return _classes


def _starts(cp: np.ndarray, cls: np.ndarray, first: np.ndarray, joined_space: bool) -> np.ndarray:
    """Mask of the positions where a pre-token (or, without joined_space, a run of white space) begins."""
    n = len(cp)
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(cls[1:], cls[:-1], out=run[1:])
    run |= first
    start = run.copy()
    if joined_space:
        at = np.flatnonzero(run)
        at = at[(cls[at] != SPACE) & ~first[at]]
        at = at[cls[at - 1] == SPACE]
        # the last white space before a word starts a pre-token of its own; a blank also takes the word in
        start[at - 1] = True
        start[at[cp[at - 1] == 32]] = False
    else:
        start |= cls == NUMBER
    quote = np.flatnonzero(cp == 39)
    quote = quote[start[quote] & (quote + 1 < n)]
    if len(quote):
        ok = ~first[quote + 1] & (cls[quote + 1] == LETTER)
        quote = quote[ok]
        c1 = cp[quote + 1]
        last = np.minimum(quote + 2, n - 1)
        c2 = np.where((quote + 2 < n) & ~first[last], cp[last], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        size = np.where(one, 2, np.where(two, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote[size == 3] + 2] = False
        after = quote + size
        start[after[after < n]] = True
    return start


@functools.cache
def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _lower(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class PieceTable:
    """Open-addressed map from 64-bit hashes to entries: a pre-token's code points and its ids."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self._alloc(1 << 16)
        self.n, self.used = 0, 0
        self.off, self.len = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.at, self.size, self.cps, self.filled = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0
        self.others: dict[str, int] = {}  # entries of pre-tokens whose hash another one has

    def _alloc(self, size: int) -> None:
        self.keys, self.vals = np.zeros(size, np.uint64), np.zeros(size, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of every hash, -1 if there is none."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.vals[slot], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            key, want = self.keys[slot[todo]], h[todo]
            out[todo] = np.where(key == want, self.vals[slot[todo]], -1)
            todo = todo[(key != want) & (key != 0)]
        return out

    def _place(self, h: np.ndarray, v: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            _, who = np.unique(slot[free], return_index=True)
            won = free[who]
            self.keys[slot[won]], self.vals[slot[won]] = h[won], v[won]
            left = np.ones(len(h), bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = np.where(self.keys[slot[todo]] != 0, (slot[todo] + 1) & mask, slot[todo])

    def entries(self, pieces: list[str], runs: list[list[int]]) -> np.ndarray:
        """New entries, not yet found by any hash."""
        lens, sizes = np.fromiter(map(len, runs), np.int64, len(runs)), np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((i for r in runs for i in r), np.uint32, int(lens.sum()))
        text = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        while self.n + len(pieces) > len(self.off):
            self.off, self.len, self.at, self.size = (np.resize(a, 2 * len(a)) for a in (self.off, self.len, self.at, self.size))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while self.filled + len(text) > len(self.cps):
            self.cps = np.resize(self.cps, 2 * len(self.cps))
        v = np.arange(self.n, self.n + len(pieces), dtype=np.int32)
        self.off[v], self.len[v] = self.used + np.cumsum(lens) - lens, lens
        self.at[v], self.size[v] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.cps[self.filled : self.filled + len(text)] = text
        self.n, self.used, self.filled = self.n + len(pieces), self.used + len(flat), self.filled + len(text)
        return v

    def add(self, h: np.ndarray, pieces: list[str], runs: list[list[int]]) -> None:
        """Distinct new hashes with their pre-tokens and ids."""
        v = self.entries(pieces, runs)
        if 2 * self.n > len(self.keys):
            was = self.keys != 0
            hs, vs = self.keys[was], self.vals[was]
            size = len(self.keys)
            while 2 * self.n > size:
                size *= 2
            self._alloc(2 * size)
            self._place(hs, vs)
        self._place(h, v)

    def differ(self, entry: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The places whose code points are not those of their entry."""
        size = end - start
        odd = self.size[entry] != size
        size = np.where(odd, 0, size)
        ends = np.cumsum(size)
        within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        other = self.cps[np.repeat(self.at[entry], size) + within] != cp[np.repeat(start, size) + within]
        if other.any():
            odd[np.searchsorted(ends, np.flatnonzero(other), side="right")] = True
        return np.flatnonzero(odd)


class FastTokenizer:
    """``kind`` is "byte" (byte-level BPE, blanks join the next word) or "word" (lower case, white space dropped)."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special))))
        self.kind, self.table = kind, PieceTable()
        self._pow = self._inv = np.ones(0, np.uint64)

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token, by the library's BPE model."""
        if piece in self.special:
            return [self.special[piece]]
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_byte_chars()))]

    def _powers(self, n: int) -> None:
        if len(self._pow) < n:
            n = max(n, BLOCK_CHARS)
            p = 0x9E3779B97F4A7C15
            inv = pow(p, -1, 1 << 64)
            for name, base in (("_pow", p), ("_inv", inv)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def specials(self, text: str, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Spans of special tokens' strings within joined texts."""
        if not any(x in text for x in self.special):
            return []
        spans = [m.span() for m in self._special.finditer(text)]
        return [(a, b) for a, b in spans if np.searchsorted(bounds, a, side="right") == np.searchsorted(bounds, b - 1, side="right")]

    def pieces(self, text: str, bounds: np.ndarray, spans: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end (code points) and table entry of the pre-tokens of joined texts; bounds: where each text begins. spans:
        those of special tokens, where they can't be seen from the text."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cp)
        none = np.zeros(0, np.int64)
        if not n:
            return none, none, none
        spans = self.specials(text, bounds) if spans is None else spans
        cls = char_classes()[cp]
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        for a, b in spans:
            first[a] = first[b] = True
        mask = _starts(cp, cls, first[:n], self.kind == "byte")
        for a, b in spans:
            mask[a + 1 : b] = False
        start = np.flatnonzero(mask)
        end = np.append(start[1:], n)
        if self.kind == "word":
            keep = cls[start] != SPACE
            start, end = start[keep], end[keep]
        self._powers(n + 1)
        val = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        val ^= val >> np.uint64(32)
        val *= self._pow[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(val, out=total[1:])
        h = (total[end] - total[start]) * self._inv[start]
        h ^= (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        h ^= h >> np.uint64(29)
        h[h == 0] = 1
        if self.kind == "word" and spans:  # lower case makes such strings of others, which are no tokens
            own = np.isin(start, [a for a, _ in spans])
            h[own] ^= np.uint64(0x5851F42D4C957F2D)
        entry = self.table.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.table.n + len(new) > MAX_ENTRIES and self.table.n:
                self.table.clear()
                new = np.arange(len(h))
            hs, at = np.unique(h[new], return_index=True)
            at = new[at]
            words = [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            self.table.add(hs, words, [self.piece_ids(w) for w in words])
            entry[new] = self.table.find(h[new])
        for i in self.table.differ(entry, cp, start, end).tolist():
            word = text[start[i] : end[i]]
            if word not in self.table.others:
                self.table.others[word] = int(self.table.entries([word], [self.piece_ids(word)])[0])
            entry[i] = self.table.others[word]
        return start, end, entry

    def _plain(self, text: str) -> tuple[str, list[tuple[int, int]] | None]:
        """The text as it is split, and the spans of special tokens where that changes letters."""
        if self.kind == "byte":
            return text, None
        if not any(x in text for x in self.special):
            return _lower(text), []
        out, spans, size, at = [], [], 0, 0
        for m in [*self._special.finditer(text), None]:
            x = _lower(text[at : m.start() if m else len(text)])
            out.append(x)
            size += len(x)
            if m:
                out.append(m.group())
                spans.append((size, size + len(m.group())))
                size, at = spans[-1][1], m.end()
        return "".join(out), spans

    def blocks(self, texts: list[str]):
        """Yields (index of the first text, number of texts, joined text, bounds, spans of special tokens or None)."""
        at = 0
        while at < len(texts):
            part, size, spans = [], 0, []
            first = at
            while at < len(texts) and (not part or size + len(texts[at]) <= BLOCK_CHARS):
                t, own = self._plain(texts[at])
                spans += [(a + size, b + size) for a, b in own or ()]
                part.append(t)
                size += len(t)
                at += 1
            lens = np.fromiter(map(len, part), np.int64, len(part))
            yield first, len(part), "".join(part), np.cumsum(lens) - lens, None if self.kind == "byte" else spans

    def parts(self, text: str):
        """A long text in parts that are encoded each for itself."""
        at = 0
        while at < len(text):
            m = _CUT.search(text, at + BLOCK_CHARS)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end

    def encode(self, texts: list[str]):
        """Yields (index of the first text, ids of all texts of a block, offsets: one more than there are texts)."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > BLOCK_CHARS:
                ids = np.concatenate([x for part in self.parts(texts[at]) for _, x, _ in self._encode([part])])
                yield at, ids, np.array([0, len(ids)])
                at += 1
                continue
            end = next((i for i in range(at, len(texts)) if len(texts[i]) > BLOCK_CHARS), len(texts))
            for first, ids, off in self._encode(texts[at:end]):
                yield at + first, ids, off
            at = end

    def _encode(self, texts: list[str]):
        for first, k, joined, bounds, spans in self.blocks(texts):
            start, _, entry = self.pieces(joined, bounds, spans)
            lens = self.table.len[entry]
            ends = np.cumsum(lens)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.table.pool[np.repeat(self.table.off[entry] - (ends - lens), lens) + np.arange(total)]
            cuts = np.searchsorted(start, np.append(bounds, len(joined)))
            yield first, ids, np.append(0, ends)[cuts]


_cached: dict[tuple[str, str], FastTokenizer] = {}


def tokenizer(path: str, kind: str) -> FastTokenizer:
    """One tokenizer for each file in a Python process."""
    if (path, kind) not in _cached:
        _cached[path, kind] = FastTokenizer(path, kind)
    return _cached[path, kind]
