"""The ten operators against brute force, on whole small tables and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featurelab.llm import chat, common, components, edits, fingerprint, idfile, labelled, media, mix, pack, quality, queries, simhash, tokens, toxicity

from ..compare import connection, same
from .conftest import COLUMNS, rows

BYTE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def lib(path):
    return Tokenizer.from_file(path)


def table(df):
    return [r.asDict() for r in df.collect()]


# --- tokens ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("path, kind, block", [(BYTE, "byte", 1 << 18), (WORD_BPE, "word", 1 << 18), (BYTE, "byte", 40), (WORD_BPE, "word", 40)])
def test_ids_equal_the_library(monkeypatch, path, kind, block, texts):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", block)
    rnd, letters = random.Random(1), [*"ab'stmdrelvLL  \n\t  é1٣²漢!?#'’́İΣσß🙂\u0085​", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", "\u0338", " word", ", two"]
    every = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["", "<|endoftext|> hi", "'s", "''s", " 's", "<|endof", "text|>"] + list(texts.values())
    own, t = [None] * len(every), tokens.FastTokenizer(path, kind)
    for first, ids, off in t.encode(every):
        for k in range(len(off) - 1):
            own[first + k] = ids[off[k] : off[k + 1]].tolist()
    assert own == [e.ids for e in lib(path).encode_batch(every, add_special_tokens=False)]


def test_pre_tokens_with_one_hash_are_told_apart(monkeypatch, texts):
    """Every hash is made to collide with others."""
    class Poor(tokens.PieceTable):
        def find(self, h):
            return super().find(h % np.uint64(50) + np.uint64(1))

        def add(self, h, pieces, runs):
            few, at = np.unique(h % np.uint64(50) + np.uint64(1), return_index=True)
            new = super().find(few) < 0
            super().add(few[new], [pieces[i] for i in at[new]], [runs[i] for i in at[new]])

    some = list(texts.values())[:15]
    t = tokens.FastTokenizer(BYTE, "byte")
    t.table = Poor()
    assert [i for _, ids, _ in t.encode(some) for i in ids.tolist()] == [i for e in lib(BYTE).encode_batch(some, add_special_tokens=False) for i in e.ids]


def test_a_full_table_of_pieces_starts_anew(monkeypatch, texts):
    monkeypatch.setattr(tokens, "MAX_ENTRIES", 50)
    t, some = tokens.FastTokenizer(BYTE, "byte"), list(texts.values())[:20]
    got = [i for _, ids, _ in t.encode(some) for i in ids.tolist()]
    assert got == [i for e in lib(BYTE).encode_batch(some, add_special_tokens=False) for i in e.ids]


# --- 1 media -----------------------------------------------------------------------------------------------------------


def test_cuts_equal_the_rolling_hash():
    data, h, last, ends = bytes(random.Random(2).choices(b"abcdefgh \n", k=60_000)), 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(media.gear_table()[b])) & 0xFFFFFFFF
        size = i + 1 - last
        if (h >> (32 - media.CUT_BITS) == 0 and size >= media.MIN_CHUNK) or size == media.MAX_CHUNK:
            ends.append(i + 1)
            last = i + 1
    assert media.cuts(data) == ends + ([len(data)] if last < len(data) else [])
    assert media.cuts(b"\0" * 64) == [64]


def check_media(got, docs):
    assert len(got) == len(docs)
    want = Counter()
    for doc_id, text in docs:
        raw = (text or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by = {}
    for r in got:
        assert by.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def media_rows(docs):
    return media.Store(docs).digests()


def test_media(spark, sf, texts, edge):
    check_media(table(media.op1(spark, sf)), list(texts.items()))
    check_media(table(media_rows(edge)), [r[:2] for r in rows()])


def test_shared_chunks_are_stored_once_and_damage_is_found(spark):
    body = " ".join(str(i * 7919) for i in range(4000))
    docs = spark.createDataFrame([(i, f"head {i} {body} end {i}") for i in range(6)], "doc_id bigint, text string")
    store = media.Store(docs)
    chunks = store.chunks.select("hi", "lo").collect()
    assert len(chunks) == len(set(chunks)) > 5
    stored = store.packs.select(F.sum(F.length("body"))).first()[0] + store.chunks.select(F.sum(F.length("body"))).first()[0]
    assert stored < 2.5 * len(body)
    recipes = {(r["p_hi"], r["p_lo"]): r["recipe"] for r in store.packs.collect()}
    for r in store.media().collect():
        assert r["media"] == recipes[r["p_hi"], r["p_lo"]] + r["payload"] and r["payload"].startswith(b"head ")
    with pytest.raises(Exception, match="digest"):
        media.read_back(store.packs, store.chunks.withColumn("body", F.concat(F.lit(b"!"), F.expr("substring(body, 2)")))).collect()


# --- 2 packing ---------------------------------------------------------------------------------------------------------


def check_pack(got, docs):
    t, by = lib(BYTE), {}
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[doc_id, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return 1 - sum(r["length"] for r in got) / (2048 * max(1, len(by)))


def test_packing(spark, sf, texts, edge):
    assert check_pack(table(pack.op2(spark, sf)), list(texts.items())) < 0.02
    check_pack(table(pack.pack_documents(edge)), [r[:2] for r in rows()])


def test_plan_meets_the_demand_near_the_bound():
    rng = np.random.default_rng(0)
    demand = np.bincount(rng.integers(1, 256, 5000), minlength=257)
    made = pack.plan(demand, 256)
    assert (demand * np.arange(257)).sum() / 256 <= made.bound <= made.sequences <= made.bound * 1.01 + 2
    for size in np.flatnonzero(demand):
        places = sorted((made.table[int(size)][:, 0]).tolist())
        assert places[0] == 0
    worth, counts = pack.knapsack(np.array([0, 1.0, 2.5, -np.inf, 5.5]), 4)
    assert worth == 5.5 and counts[4] == 1


def test_sequences_hold_the_ids(spark, plain_docs, texts):
    some = plain_docs.filter("doc_id < 20")
    cut = pack.pieces(some, BYTE, keep_ids=True).persist()
    got = pack.sequences(pack.pack(cut), cut, pad=7).collect()
    t = lib(BYTE)
    have = Counter(i for r in got for i in r["ids"])
    want = Counter(i for d in range(20) for i in [*t.encode(texts[d], add_special_tokens=False).ids, 1])
    have[7], want[7] = 0, 0
    assert have == want and all(len(r["ids"]) == 2048 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in got)


# --- 3 and 5 classifiers -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, module, label, least", [("op3_toxicity", toxicity, "toxic", 0.75), ("op5_quality", quality, "quality", 0.85)])
def test_classifiers(spark, name, module, label, least):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in table(queries.queries()[name](spark, sf))}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= module.THRESHOLD) for r in got.values())
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > least


def slow_toxicity(m, text):
    """The most toxic window, n-gram by n-gram."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.lower().encode()) if w]
    if not words:
        return 0.0
    worths = []
    for w in words:
        w, own = b" " + w + b" ", []
        for n in (3, 4, 5):
            for k in range(len(w) - n + 1):
                h = w[k]
                for c in w[k + 1 : k + n]:
                    h = (h * 16777619 & 0xFFFFFFFF) ^ c
                h ^= n * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
                own.append(float(m.worth[(h * 0x85EBCA6B & 0xFFFFFFFF) >> 14]))
        worths.append(own)
    logits = []
    for k in range(0, max(len(words) - 8, 0) + 4, 4):
        if k == 0 or k < len(words) - 8 + 4:
            bag = [x for own in worths[k : k + 8] for x in own]
            logits.append(sum(bag) / max(len(bag), 1) + m.bias)
    return 1 / (1 + np.exp(-max(logits)))


def slow_quality(m, text):
    """Every token's vector in turn, and the network by hand."""
    vectors, last, n = [], None, 0
    for raw in text.split():
        n += 1
        plain = re.sub(r"^\W+|\W+$", "", raw).lower()
        w = m.reader.words.get(plain, 1 + len(m.reader.words) + zlib.crc32(plain.encode()) % quality.BUCKETS if plain else 0)
        vectors += [m.word[w]] * (w > 0) + [m.shape[m.reader.shapes.get(quality.shape_of(raw), 0)]] + [m.repeat] * (raw == last)
        last = raw
    x = np.sum(vectors, axis=0, dtype=np.float64) / n if n else np.zeros(quality.DIM)
    mean, scale, w1, b1, w2, b2 = m.layers
    z = np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2
    return 1 / (1 + np.exp(-(z[1] - z[0]) / m.temperature))


@pytest.mark.parametrize("module, label, slow", [(toxicity, "toxic", slow_toxicity), (quality, "quality", slow_quality)])
def test_scores_equal_a_slow_scorer(spark, monkeypatch, edge, module, label, slow):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = module.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    some = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + [r[1] or "" for r in rows()] + ["a " * k for k in range(1, 30)]
    want = [slow(m, t) for t in some]
    assert m.scores(some) == pytest.approx(want, abs=1e-4)
    by_row = [r["score"] for r in labelled.score_table(edge, m, 0.5).orderBy("score").collect()]
    assert by_row == pytest.approx(sorted(slow(m, r[1] or "") for r in rows()), abs=1e-4)
    monkeypatch.setattr(module, "BLOCK" if module is toxicity else "PART", 50)  # long texts in parts
    monkeypatch.setattr(toxicity, "LONG", 3)
    assert m.scores(some) == pytest.approx(want, abs=1e-4)


def test_misspellings_share_vectors():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdeilmnorst", k=rnd.randint(3, 8))) for _ in range(400)]
    text = lambda bad: " ".join([*rnd.choices(words, k=60), *bad, *rnd.choices(words, k=60)])
    m = toxicity.train([text([]) for _ in range(300)] + [text([rnd.choice(["wretchful", "stinkhead"])]) for _ in range(300)], [0] * 300 + [1] * 300)
    clean = m.scores([text([]) for _ in range(60)])
    assert (m.scores([text(["wretchful"]) for _ in range(60)]) >= 0.5).mean() > 0.8
    assert (clean >= 0.5).mean() < 0.1
    assert m.scores([text(["wretchfull"]) for _ in range(60)]).mean() > clean.mean() + 0.3


@pytest.mark.parametrize("module, label, rest", [(toxicity, "toxic", 0.0), (quality, "quality", 1.0)])
def test_classifier_edges(spark, edge, module, label, rest):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(3, 1, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        m = module.fit(edge, lab)
        got = labelled.score_table(edge, m, 0.5).collect()
        assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == rest for r in got)
    keep = labelled.kept(edge, m, 0.5, int(rest))
    assert keep.columns == edge.columns and keep.count() == len(rows())
    assert labelled.kept(edge.limit(0), m, 0.5, 1).count() == 0


def test_training_rows_are_never_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    texts_, y = labelled.sample(docs, labels, "toxic", 1000)
    assert len(texts_) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200)) and not any(zlib.crc32(t.split()[1].encode()) % 5 == 0 for t in texts_)
    more = labels.unionByName(spark.createDataFrame([(i, i % 2) for i in range(1000, 9000)], "doc_id bigint, toxic int"))  # labels without documents take nothing away
    assert labelled.sample(docs, more, "toxic", 40) == labelled.sample(docs, labels, "toxic", 40) and len(labelled.sample(docs, more, "toxic", 40)[0]) == 80
    assert len(labelled.sample(docs, labels, "toxic", 10)[0]) == 20 and sorted(set(y)) == [0, 1]


# --- 4 simhash ---------------------------------------------------------------------------------------------------------


def slow_fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    count = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(sh))


def slow_components(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = np.array(sorted(root), np.uint64)
    for i, f in enumerate(every):
        for g in every[i + 1 :][np.bitwise_count(every[i + 1 :] ^ f) <= radius]:
            root[find(int(g))] = find(int(f))
    return {f: find(f) for f in root}


def check_simhash(got, docs):
    fps = [(i, slow_fingerprint(t)) for i, t in docs]
    comp = slow_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    assert Counter((r["doc_id"], int(r["fp"]) & (1 << 64) - 1, r["component_id"]) for r in got) == Counter((i, f, least.get(comp[f])) for i, f in fps)


def test_simhash(plain_docs, texts, edge):
    check_simhash(table(simhash.near_duplicates(plain_docs)), list(texts.items()))
    check_simhash(table(simhash.near_duplicates(edge)), [r[:2] for r in rows()])
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


@pytest.mark.parametrize("max_list", [20_000, 7])
def test_dense_groups_lose_no_link(spark, max_list):
    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        fps |= {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(120)}
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(df, 4, max_list)).collect()}
    want = slow_components(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    full = {signed(f): signed(f) for f in fps} | got
    assert groups(full) == {frozenset(map(signed, g)) for g in groups(want)}


def test_triples_cover_all_sets_of_four():
    from itertools import combinations

    assert len(simhash.position_sets()) == 20 and all(any(set(t) <= set(s) for t in simhash.position_sets()) for s in combinations(range(8), 4))


def test_chains_and_stars_are_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (1, 0)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_one_of_each_group_stays(spark, edge):
    comp = slow_components({slow_fingerprint(r[1]) for r in rows()})
    first = {}
    for r in sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(comp[slow_fingerprint(r[1])], r[:2])
    for docs in (edge, edge.orderBy(F.desc("text")).coalesce(1)):
        out = simhash.one_of_each(docs)
        assert out.columns == edge.columns
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(first.values())


# --- 6 id files --------------------------------------------------------------------------------------------------------


def check_ids(got, docs):
    t, at, want = lib(WORD_BPE), 0, []
    coded = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x in docs]
    for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), x[1].astype("<u2").tobytes())):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(s, i, n, c) for i, s, n, c in want]


def test_id_files(spark, sf, texts, edge):
    check_ids(table(idfile.op6(spark, sf)), list(texts.items()))
    container, book = idfile.encode_documents(edge)
    got = idfile.read(container, idfile.book_lengths(book)).collect()
    check_ids([r.asDict() for r in got], [r[:2] for r in rows()])
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    container, book = idfile.encode_documents(edge.limit(0))
    assert idfile.read(container, idfile.book_lengths(book)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000])
def test_codes(n):
    ids = np.minimum((np.random.default_rng(n).pareto(0.6, n) * 3).astype(int), 49407)
    lengths = idfile.code_lengths(np.bincount(ids, minlength=49408))
    used = lengths[lengths > 0].astype(float)
    assert (lengths <= idfile.MAX_BITS).all() and (2.0**-used).sum() <= 1 + 1e-12
    assert idfile.decode(idfile.encode(ids, lengths, idfile.canonical(lengths)), idfile.decode_table(lengths)).tolist() == ids.tolist()


def test_lengths_are_limited_and_optimal():
    assert idfile.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32, 64]), 18).tolist() == [7, 7, 6, 5, 4, 3, 2, 1]
    limited = idfile.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32, 64]), 4)
    assert limited.max() == 4 and (2.0 ** -limited.astype(float)).sum() == 1


# --- 7 edits -----------------------------------------------------------------------------------------------------------


def test_counts_follow_edits():
    tok, rnd = tokens.FastTokenizer(BYTE, "byte"), random.Random(5)
    letters = [*"ab'stmdrelvLL  \n\t  é1٣漢!?#", "<|endoftext|>", "<|endof", "text|>", "<|", "endoftext", "|>"]
    for _ in range(250):
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 50, 400, 1500])))
        _, ends, entry = tok.pieces(text, np.zeros(1, np.int64)) if text else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        tree = edits.SegmentTree(tok, text, ends, tok.table.len[entry])
        for _ in range(6):
            p, d, new = rnd.randint(0, len(text) + 2), rnd.choice([0, 0, 1, 3, 13, 20, 200]), "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 0, 1, 2, 5, 60])))
            p = min(p, len(text))
            text = text[:p] + new + text[p + d :]
            tree.edit(p, d, new)
            assert (tree.whole(), tree.length, tree.total) == (text, len(text), len(tok.lib.encode(text, add_special_tokens=False).ids))


def test_edits_of_many_texts_are_split_together(monkeypatch):
    """Far fewer passes than edits, and the trees that the edits give one by one; special tokens' strings end at their text."""
    tok, rnd = tokens.FastTokenizer(BYTE, "byte"), random.Random(6)
    letters, trees, alone, logs, passes = [*"ab's \n1漢", "<|endoftext|>", "<|endof", "text|>"], [], [], [], []
    for _ in range(200):
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 50, 400])))
        ends, counts = next(edits.splits(tok, [text]))
        for out in (trees, alone):
            out.append(edits.SegmentTree(tok, text, ends, counts))
        logs.append([(rnd.randint(0, len(text)), rnd.choice([0, 3, 40]), rnd.choice(["", " new", "text|>"])) for _ in range(rnd.randint(0, 4))])
        for e in logs[-1]:
            alone[-1].edit(*e)
    pieces = tok.pieces
    monkeypatch.setattr(tok, "pieces", lambda *a: passes.append(1) or pieces(*a))

    def steps(tree, log):
        for e in log:
            yield from tree.steps(*e)

    edits.answered(tok, [steps(t, log) for t, log in zip(trees, logs, strict=True)])
    assert len(passes) < sum(map(len, logs)) / 10
    for tree, one in zip(trees, alone, strict=True):
        assert (tree.whole(), tree.recounted) == (one.whole(), one.recounted) and tree.evened().row() == one.evened().row()
        assert tree.total == len(tok.lib.encode(tree.whole(), add_special_tokens=False).ids)


def slow_edit(x):
    k = len(x) // 3
    y = x[:k] + " it's 12,345 new words" + x[k:]
    at = min(2 * k, len(y))
    y = y[:at] + "\n\n naïve  text" + y[at + 40 :]
    return y[1:]


def test_edited_counts(spark, sf, texts, edge):
    t = lib(BYTE)
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    got = table(edits.op7(spark, sf))
    assert len(got) == len(texts)
    for r in got:
        x = texts[r["doc_id"]]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"]) == (n(x), n(slow_edit(x)), len(slow_edit(x)))
    long = max(got, key=lambda r: r["n_pretokens"])
    assert long["recounted"] < long["n_pretokens"] / 5
    again = table(edits.edited_counts(edge.select("doc_id", "text", edits.sample_edits(F.col("text")).alias("edits"))))
    want = Counter((r[0], n(r[1] or ""), n(slow_edit(r[1] or ""))) for r in rows())
    assert Counter((r["doc_id"], r["n_tokens"], r["edited_tokens"]) for r in again) == want
    log = spark.createDataFrame([(3, 1, 0, 0, "x"), (3, 2, None, None, None), (4, 1, 99999, 5, " end")], "doc_id bigint, seq int, position bigint, deleted bigint, inserted string")
    by = {r["doc_id"]: r for r in table(edits.edited_counts(edits.with_edit_log(edge.filter("doc_id in (3, 4, 5)"), log)))}
    assert by[3]["edited_tokens"] == n("xone") and by[5]["edited_tokens"] == by[5]["n_tokens"] and by[4]["edited_tokens"] == n(rows()[4][1] + " end")


def test_kept_trees_follow_edit_logs(spark, edge):
    t = lib(BYTE)
    docs = edge.filter("doc_id is not null").dropDuplicates(["doc_id"])
    whole = {r["doc_id"]: r["text"] or "" for r in table(docs.select("doc_id", "text"))}
    trees, rnd = common.written(edits.count_trees(docs), "trees"), random.Random(3)
    for seq in range(3):
        log, new = [], dict(whole)
        for i in sorted(whole):
            p, d, put = rnd.randint(0, len(whole[i])), rnd.choice([0, 2, 40]), rnd.choice(["", " it's 12", "\n\n é word"])
            log.append((i, seq, p, d, put))
            new[i] = whole[i][:p] + put + whole[i][p + d :]
        whole = new
        log = spark.createDataFrame(log, "doc_id bigint, seq int, position bigint, deleted bigint, inserted string")
        trees = common.written(edits.edited_trees(edits.with_edit_log(trees, log)), "trees")
        got = {r["doc_id"]: r for r in table(trees)}
        assert {i: (r["text"], r["n_chars"], r["n_tokens"]) for i, r in got.items()} == {i: (x, len(x), len(t.encode(x, add_special_tokens=False).ids)) for i, x in whole.items()}
        fresh = edits.count_trees(spark.createDataFrame(sorted(whole.items()), "doc_id bigint, text string"))
        assert got == {r["doc_id"]: r for r in table(fresh)}


# --- 8 chat ------------------------------------------------------------------------------------------------------------


def slow_chat(turns):
    order = sorted(((t, r or "", x or "") for t, r, x in turns), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    loss = "".join(x for _, r, x in order if r == "assistant")
    whole = "".join(f"{r}\n{x}\n" for _, r, x in order)
    return len(order), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat(spark, sf):
    same(chat.op8(spark, sf), connection(sf), chat.OP8_SQL)
    nasty = ["\\", "<|", "<\\|", "\\<|im_end|>\\n", "<|im_start|>assistant\nok<|im_end|>\n", "", None, "a\nb", "\\\\<<||"]
    data = [(c, t, r, x) for c in (1, 2, None) for t, r in ((0, "user"), (1, "assistant"), (None, "assistant"), (2, None), (2, "a role\n<|")) for x in nasty] + [(3, 1, "assistant", "twice")] * 2
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumns({"piece": F.lit(1), "seq": F.lit(2)})
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.format_conversations(df)).collect()}
    want = {c: slow_chat([x[1:] for x in data if x[0] == c]) for c in (1, 2, 3, None)}
    assert got == want
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_events_fold_into_messages(spark):
    log = [("start", "assistant", None), ("delta", None, "He"), ("delta", None, "llo"), ("regenerate", None, None), ("delta", None, "Good "), ("delta", None, None), ("delta", None, "day")]
    rows_ = [(1, 0, "m", i, *e) for i, e in enumerate(log)] + [(1, 1, "n", 0, "start", "user", None), (1, 1, "n", 1, "delta", None, "x"), (1, 1, "n", 2, "edit", None, "y"), (1, 1, "n", 3, "delta", None, "z")] + [(1, 2, "o", 0, "start", None, None)]
    events = spark.createDataFrame(rows_[::-1], "conv_id bigint, turn bigint, message_id string, seq bigint, kind string, role string, text string")
    assert sorted((r["message_id"], r["role"], r["text"]) for r in chat.messages(events).collect()) == [("m", "assistant", "Good day"), ("n", "user", "yz"), ("o", "", "")]


# --- 9 mixing ----------------------------------------------------------------------------------------------------------


def test_mixing(spark, sf, edge):
    same(mix.op9(spark, sf), connection(sf), mix.OP9_SQL)
    a, b = table(mix.mix(edge)), table(mix.mix(edge.repartition(3)))
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == len(rows())
    words = Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows())
    assert Counter((r["doc_id"], r["size"]) for r in a) == words
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in a)
    assert mix.mix(edge.limit(0)).count() == 0
    for docs in (edge, edge.withColumnsRenamed({"h": "_size", "fp": "_n", "size": "q", "key": "_r_source", "n": "extra"})):
        out = mix.mixed_documents(docs)
        assert out.columns == docs.columns
        have = Counter((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in out.collect())
        want = Counter()
        for r in a:
            want[r["doc_id"], r["source"], r["size"]] += r["copies"]
        assert have == +want


def test_rows_that_tie_at_the_cut_are_taken_in_part(spark):
    """One source, every document of one id and size: the sample of the other source's share ends among equals."""
    docs = spark.createDataFrame([(1, f"w{i} b c", "a") for i in range(10)] + [(i, "x y z", "b") for i in range(2, 40)], "doc_id bigint, text string, source string")
    out, want = mix.mixed_documents(docs), mix.mix(docs)
    for s in "ab":
        assert out.filter(F.col("source") == s).count() == want.filter(F.col("source") == s).agg(F.sum("copies")).first()[0]
    each = Counter(r["text"] for r in out.filter("source = 'a'").collect())
    assert len(each) == 10 and max(each.values()) - min(each.values()) == 1
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mix.mixed_documents(docs.repartition(5)).collect()))


def test_targets_stop_at_three_times_the_source(spark):
    df = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 1000), (None, 5)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mix.targets(df).collect()}
    assert got == {"a": 30.0, "b": 30.0, "c": 30.0, "d": pytest.approx(930.0), None: 15.0}


def test_words_taken_come_near_the_target(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * int(rng.paretovariate(1.2) * 5), "abc"[i % 3] if i % 7 else "hot") for i in range(3000)], "doc_id bigint, text string, source string")
    got = mix.mix(docs).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("most")).collect()
    assert all(abs(r["k"] - r["t"]) <= r["most"] for r in got)


# --- 10 fingerprints ---------------------------------------------------------------------------------------------------


def term_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    count = [0] * 64
    for i, x in enumerate(w):
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        if i + 1 < len(w):
            h = xxhash.xxh64_intdigest(w[i + 1].encode(), h)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(w))


def test_fingerprints(spark, sf, texts):
    ids, got = sorted(texts), {r["doc_id"]: r for r in table(fingerprint.op10(spark, sf))}
    fps = {i: term_fingerprint(texts[i]) for i in ids}
    every = np.unique(np.array(list(fps.values()), np.uint64))
    assert set(got) == set(ids)
    for k, i in enumerate(ids):
        t, nxt, r = texts[i], ids[(k + 1) % len(ids)], got[i]
        q = len(t) // 4
        e = t[: len(t) - q] + texts[nxt][:q]
        f = term_fingerprint(e)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        assert (r["n_chars"], r["edited_sha256"], int(r["fingerprint"], 16), int(r["edited_fingerprint"], 16), r["near_edited"], r["near_next"]) == (len(t), hashlib.sha256(e.encode()).hexdigest(), fps[i], f, like(fps[i], f), like(fps[i], fps[nxt]))
        near = int((np.bitwise_count(every ^ np.uint64(fps[i])) <= 3).sum()) - 1
        assert r["within_radius"] == (near if i % 100 == 0 else None)


def test_fingerprint_edges(spark, edge):
    got = table(fingerprint.fingerprint(edge))
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((r[0], len(r[1] or "")) for r in rows())
    one = spark.createDataFrame([(1, "abcd efgh")], "doc_id bigint, text string")
    row = fingerprint.fingerprint(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and row["fp"] == row["next_fp"]
    assert fingerprint.fingerprint(edge.limit(0)).count() == 0


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(20)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    got = Counter((r["q"], r["fp"]) for r in fingerprint.within(df.selectExpr("fp as q"), df).collect())
    assert got == Counter((signed(a), signed(b)) for a in fps for b in fps if (a ^ b).bit_count() <= 3)


# --- all ---------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert media_rows(empty).count() == pack.pack_documents(empty).count() == simhash.one_of_each(empty).count() == mix.mixed_documents(empty).count() == 0
    assert edits.edited_counts(empty.select("doc_id", "text", edits.sample_edits(F.col("text")).alias("edits"))).count() == 0


def test_ids_beyond_the_file_format_are_an_error(spark):
    import public_tokenizers

    with pytest.raises(ValueError, match="below"):
        idfile.token_ids(spark.range(0).selectExpr("id doc_id", "'' text"), public_tokenizers.path("byte_bpe_50k.json"))


def test_words_outside_the_sample_have_vectors():
    m = quality.train(["some plain words here"] * 20 + ["other ,,, junk !!!"] * 20, [1] * 20 + [0] * 20)
    ids, _, _, _ = m.reader.ids("unseen plain !!!")
    assert ids[0] > len(m.reader.words) >= ids[1] > 0 == ids[2]
    assert np.linalg.norm(m.word[ids[0]]) > 0 and not m.word[0].any()
