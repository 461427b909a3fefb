"""Operators against brute force on small tables, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lineweave.llm import digest, language, lines, mixing, pieces, simhash, suffixes, tokenfile, toxicity, vectors
from lineweave.llm.components import components
from lineweave.llm.queries import PIECE_BPE, WORD_BPE, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "x", "a\x00b", "é" * 40, "word " * 3000, "same text here", "same text here", "日本語のテキスト。", "  odd\x85 spaces　"]


def table(spark, texts, **more):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, null keys and columns whose names an operator might use itself."""
    base = [(i, t, None if i % 3 else "en", None if i % 2 else "s", 0, 1, "b") for i, t in enumerate(ODD)]
    base += [base[8], (None, "no id", "en", "s", 0, 1, "b"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(base, SCHEMA + ", size int, id string")


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text, width=4, seed=42):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# ------------------------------------------------------------------ components and SimHash


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7, k) for k in range(2000, 2300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == groups([e for e in edges if e[0] != e[1]], nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_trie_links():
    rng = np.random.default_rng(5)
    for n, budget in ((300, 4), (50, 0), (2, 4), (400, 9)):
        base = rng.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)
        keys = base[rng.integers(0, len(base), n)]
        for _ in range(4):
            keys = keys ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.5).astype(np.uint64)
        cut = sorted({0, n, *rng.integers(0, n, 2).tolist()})
        keys = np.concatenate([np.sort(keys[a:b]) for a, b in zip(cut, cut[1:])])
        i, j = simhash.trie_links(keys, np.array(cut), budget)
        want = {(x, y) for a, b in zip(cut, cut[1:]) for x in range(a, b) for y in range(x + 1, b) if int(keys[x] ^ keys[y]).bit_count() <= budget}
        got = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("width,budget,rooted", [(4, 4, 4096), (5, 7, 4096), (4, 4, 0), (4, 3, 1)])
def test_simhash(docs, rows, width, budget, rooted, monkeypatch):
    """Tries rooted at one block of bits, and at several where very many fingerprints would share a root."""
    monkeypatch.setattr(simhash, "ROOTED", rooted)
    monkeypatch.setattr(simhash, "MOST_BLOCKS", 3)
    fp = {d: fingerprint(t, width) for d, t in rows}
    ids = sorted(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= budget]
    assert links
    want = groups(links, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, width, budget).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


def test_wide_links(monkeypatch):
    """Nodes of few rows, first words that many rows share, and copies."""
    rng = np.random.default_rng(6)
    for n, budget, leaf in ((300, 60, 16), (200, 20, 8), (2, 60, 128), (1, 60, 128), (400, 60, 128)):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        fp = rng.integers(0, 1 << 63, (n // 3 + 1, 3), dtype=np.uint64)[rng.integers(0, n // 3 + 1, n)]
        fp[: n // 4, 0] = fp[0, 0]
        for _ in range(15):
            fp[np.arange(n), rng.integers(1, 3, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
            fp[n // 4 :, 0] ^= np.uint64(1) << rng.integers(0, 64, n - n // 4).astype(np.uint64)
        fp = fp[np.argsort(fp[:, 0])]
        far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
        i, j, d = simhash.wide_links(fp, budget)
        i, j = np.minimum(i, j), np.maximum(i, j)
        assert sorted(zip(i.tolist(), j.tolist(), d.tolist())) == [(x, y, far[x, y]) for x in range(n) for y in range(x + 1, n) if far[x, y] <= budget]


@pytest.mark.parametrize("rooted", [4096, 2])
def test_fingerprints_propose_near_copies(spark, rooted, monkeypatch):
    """Sets at a Jaccard similarity of 0.8, tiny ones and texts in which one shingle comes very often too, with roots of few and of
    more bits; nothing but near fingerprints with a common root is compared."""
    monkeypatch.setattr(simhash, "ROOTED", rooted)
    assert (simhash.roots_of(400)[0] > simhash.LEAST_ROOT) == (rooted == 2)
    rng = random.Random(9)
    rows = []
    for k in range(200):
        n = (4, 8, 40, 300)[k % 4] + 4  # words of n - 4 shingles, and of a quarter more
        w = [f"w{rng.randrange(9**9)}" for _ in range(n + (n - 4) // 4)]
        rows += [(2 * k, " ".join(w[:n])), (2 * k + 1, " ".join(w))]
    w = [f"w{k}" for k in range(60)]
    rows += [(900, " ".join(w)), (901, " ".join(w + ["again"] * 3000))]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_near_copies_come_by_fingerprints():
    """Equal sizes whose wide fingerprints are far apart are no pair, near ones are."""
    fp = np.zeros((3, simhash.WIDE), np.uint64)
    fp[1] = 2**20 - 1  # 60 bits
    fp[2] = 2**21 - 1
    i, j = simhash.maybe_alike(fp, np.array([9, 9, 9]), 0.8)
    assert list(zip(i.tolist(), j.tolist())) == [(1, 2), (0, 1)]
    assert simhash.wide_links(fp, 0)[0].size == 0


def test_simhash_odd(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r for r in got}
    assert all(by[i].fingerprint == "0" * 16 and by[i].component_id == 0 for i in (0, 1, 2, 3))
    assert by[8].component_id == by[9].component_id == 8
    assert all(by[i].fingerprint == f"{fingerprint(t):016x}" for i, t in enumerate(ODD))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 0, 4, 5, 6, 7, 8, 10, 11}
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_hot_blocks(spark, monkeypatch):
    """Parts of a hot block value lose no link."""
    rng = random.Random(1)
    keys = {rng.getrandbits(12) << 50 | (1 << rng.randrange(50)) | (1 << rng.randrange(50)) for _ in range(1500)}
    keys = [(k - (1 << 64) if k >> 63 else k, i) for i, k in enumerate(sorted(keys))]
    got = components(simhash.fingerprint_links(spark.createDataFrame(keys, "fp long, node long"), 4))
    u = np.array([k for k, _ in keys], np.int64).view(np.uint64)
    d = np.bitwise_count(u[:, None] ^ u[None, :])
    want = simhash.forest(len(u), *np.nonzero(d <= 4))
    mine = np.arange(len(u))
    for r in got.collect():
        mine[r.node] = r.component
    assert (mine == want).all()


# ------------------------------------------------------------------ repeated passages


def repeated(texts, passage):
    count, spans = Counter(), {}
    for d, t in texts:
        w = words(t)
        count.update(tuple(w[i : i + passage]) for i in range(len(w) - passage + 1))
    for d, t in texts:
        w, cover = words(t), []
        for i in range(len(w) - passage + 1):
            if count[tuple(w[i : i + passage])] > 1:
                if cover and i <= cover[-1][1]:
                    cover[-1][1] = i + passage
                else:
                    cover.append([i, i + passage])
        spans[d] = cover
    return {(d, a, b) for d, c in spans.items() for a, b in c}


def test_passages(docs, rows):
    got = suffixes.repeated_passages(docs).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == repeated(rows, 50)
    assert all(r.n_words == r.end_word - r.start_word >= 50 for r in got)


def test_passages_random(spark):
    rng = random.Random(7)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(150)] for _ in range(4)]
    texts = []
    for _ in range(60):
        w = [rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            b, i = rng.choice(base), rng.randrange(120)
            w += b[i : i + rng.randint(5, 60)]
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    got = suffixes.repeated_passages(table(spark, texts), 16, 8).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == repeated(list(enumerate(texts)), 16)
    for r in got:
        if r.partner_id != r.doc_id:
            mine = words(texts[r.doc_id])[r.start_word : r.end_word]
            other = words(texts[r.partner_id])
            assert {tuple(mine[i : i + 16]) for i in range(len(mine) - 15)} & {tuple(other[i : i + 16]) for i in range(len(other) - 15)}


def test_passages_share_a_row_key_only_if_equal(spark):
    """Rows of one doc_id with different texts are texts of their own."""
    rng = random.Random(5)
    one = [f"w{rng.randrange(900)}" for _ in range(120)]
    two = [f"v{rng.randrange(900)}" for _ in range(70)]
    rows = [(5, " ".join(one)), (5, "short text"), (5, " ".join(two)), (6, "x " + " ".join(one[10:80])), (7, "unique " * 10)]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.partner_id) for r in got) == [(5, 10, 80, 6), (6, 1, 71, 5)]


def test_passages_hot(spark, monkeypatch):
    """One passage in most texts, each time between other words, is dealt over tasks without losing a stretch; words of any
    length compare whole."""
    monkeypatch.setattr(suffixes, "REMEMBER", 16)
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(30)] + ["q" * 5000] + [f"p{k}" for k in range(40)]
    texts = []
    for k in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))]
        a, b = rng.choice(((0, 71), (0, 71), (3, 60), (10, 59), (30, 71)))
        texts.append(" ".join(w + passage[a:b] + [f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 9))]))
    got = suffixes.repeated_passages(table(spark, texts).repartition(40)).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == repeated(list(enumerate(texts)), 50)
    alone = ["q" * 4999 + "r" if w == "q" * 5000 else w for w in passage]
    assert suffixes.repeated_passages(table(spark, [" ".join(passage[:60]), " ".join(alone[:60])])).count() == 0


def test_passages_of_several_documents(spark):
    """Without repeats within one text: only stretches under two doc_ids count, in hot groups too."""
    rng = random.Random(3)
    own = [f"w{k}" for k in range(60)]
    both = [f"v{k}" for k in range(70)]
    texts = [" ".join(own * 3), " ".join(both + own[:5]), " ".join(["x", *both]), " ".join(both * 2)]
    texts += [" ".join([f"y{rng.random()}", *both[:55], f"y{rng.random()}"]) for _ in range(80)]
    df = table(spark, texts).repartition(20)
    got = {(r.doc_id, r.start_word, r.end_word, r.partner_id) for r in suffixes.repeated_passages(df, within=False).collect()}
    assert not any(d == 0 for d, *_ in got) and {(1, 0, 70, 83), (2, 1, 71, 1)} <= got and {r[0] for r in got} == set(range(1, 84))
    assert {r.doc_id for r in suffixes.repeated_passages(df).collect()} == set(range(84))


def test_passages_odd(spark, odd):
    got = suffixes.repeated_passages(odd).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.partner_id) for r in got] == [(7, 0, 3000, 7)]
    assert suffixes.repeated_passages(table(spark, [])).count() == 0


# ------------------------------------------------------------------ lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_banded_distance():
    rng = random.Random(2)
    texts = []
    for _ in range(120):
        t = [rng.choice("abcé") for _ in range(rng.randint(4, 40))]
        texts.append("".join(t))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = [rng.choice("abcx")] * rng.randint(0, 1)
        texts.append("".join(t) or "a")
    cps, off = lines.points(texts)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    for k in (1, 2, 3):
        ok = np.minimum(np.diff(off)[i], np.diff(off)[j]) >= k
        a, b = i[ok], j[ok]
        assert (lines.within(cps, off, a, b, k) == np.array([edit(texts[x], texts[y]) <= k for x, y in zip(a, b)])).all()


def line_truth(texts, edits=2, least=20):
    first, occ = {}, defaultdict(list)
    for d, t in sorted(texts):
        for i, x in enumerate((t or "").split("\n")):
            if x.strip():
                first.setdefault(x.strip(), (d, i))
                occ[d].append((i, x.strip()))
    every = sorted(first)
    links = []
    by = defaultdict(list)
    for x in every:
        by[len(x)].append(x)
    for x in every:
        for n in range(len(x), len(x) + edits + 1):
            for y in by[n]:
                if (n > len(x) or y > x) and len(x) >= least and sum(abs(v) for v in (Counter(x) - Counter(y)).values()) <= edits and edit(x, y) <= edits:
                    links.append((x, y))
    root = {x: x for x in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    best = {}
    for x in every:
        best[find(x)] = min(best.get(find(x), first[x]), first[x])
    degree = Counter(x for p in links for x in p)
    out = {}
    for d, _ in texts:
        mine = occ[d]
        again = [(i, x) for i, x in mine if best[find(x)] != (d, i)]
        out[d] = (len(mine), sum(degree[x] for _, x in mine), len(again), sum(len(x) for i, x in mine if (i, x) not in again))
    return out, links


def test_line_report(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(15, 60))).strip() + "z" for _ in range(25)]
    texts = []
    for _ in range(80):
        part = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                k = rng.randrange(len(x))
                x[k : k + rng.randint(0, 1)] = [rng.choice("abcé")] * rng.randint(0, 2)
            part.append("".join(x))
        texts.append("\n".join(part))
    want, links = line_truth(list(enumerate(texts)))
    assert len(links) > 50
    got = {r.doc_id: (r.n_lines, r.n_links, r.n_again, r.kept_chars) for r in lines.line_report(table(spark, texts)).collect()}
    assert got == want


def test_line_hot_keys(spark, monkeypatch):
    """A key that many lines share is split into parts without losing a link."""
    monkeypatch.setattr(lines, "PART", 7)
    rng = random.Random(4)
    head = "a common beginning of many lines that differ at the end: "
    texts = [head + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)]
    want, links = line_truth(list(enumerate(texts)))
    assert len(links) > 50
    got = {r.doc_id: (r.n_lines, r.n_links, r.n_again, r.kept_chars) for r in lines.line_report(table(spark, texts)).collect()}
    assert got == want


def test_line_dedup_of_documents(spark, docs, rows):
    want, _ = line_truth(rows)
    got = {r.doc_id: (r.n_lines, r.n_links, r.n_again, r.kept_chars) for r in lines.line_report(docs).collect()}
    assert got == want
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert all(sum(len(x.strip()) for x in kept[d].text.split("\n")) == want[d][3] for d, _ in rows)
    assert all(r.n_chars == len(r.text) for r in kept.values())


def test_lines_odd(spark, odd):
    got = lines.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == len(ODD) + 3
    by = {r.doc_id: r.text for r in got.where("doc_id is not null").collect()}
    assert by[0] is None and by[1] == "" and by[3] == "\n\n" and by[8] == "same text here" and by[9] == ""
    assert lines.line_report(table(spark, [])).count() == 0


def test_lines_of_one_doc_id(spark):
    """Texts under one doc_id lose their own lines only; equal rows stay alike; a user's columns may have any name."""
    first, other = "a line that comes in two documents", "a line that is nowhere else at all"
    rows = [(1, first, 0, 0), (5, first, 0, 0), (5, other, 0, 0), (5, other, 0, 0), (6, f"{other}!\nlast", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, _lost int")
    out = lines.dedup_lines(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.text) for r in out.collect()) == [(1, first), (5, ""), (5, other), (5, other), (6, "last")]
    got = sorted((r.doc_id, r.n_lines, r.n_again) for r in lines.line_report(df).collect())
    assert got == [(1, 1, 0), (5, 1, 0), (5, 1, 0), (5, 1, 1), (6, 2, 1)]


# ------------------------------------------------------------------ token files and SentencePiece


def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(WORD_BPE))


def test_token_parity():
    tok, rng = bpe(), random.Random(9)
    alphabet = "aZ 'sé É\n<|>.,9ñ́Σ中 \t½ßÀ× 　"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [t or "" for t in ODD] + ["x <|endoftext|> it's we'll"]
    got = tokenfile.encode_texts(tokenizer_path(WORD_BPE), pa.array(texts), 1)
    assert all(g.tolist() == tok.encode(t, add_special_tokens=False).ids + [1] for g, t in zip(got, texts))


def test_token_files(spark, docs, rows):
    got = sorted(tuple(r) for r in tokenfile.read(spark, *tokenfile.write(docs, tokenizer_path(WORD_BPE), 1)).collect())
    tok, want, start = bpe(), [], 0
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want


def test_token_files_odd(spark, odd, tmp_path):
    got = sorted((tuple(r) for r in tokenfile.read(spark, *tokenfile.write(odd, tokenizer_path(WORD_BPE), 1)).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [None, None, *sorted([*range(len(ODD)), 8])] and got[0][2] == 1 and got[-1][1] + got[-1][2] == sum(g[2] for g in got)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    folder, shards = tokenfile.write(table(spark, []), tokenizer_path(WORD_BPE), 1)
    assert tokenfile.read(spark, folder, shards).count() == 0


def test_shard(tmp_path):
    from pyarrow import fs

    own = fs.LocalFileSystem()
    docs = [(i, np.arange(i * 3, dtype=np.uint32)) for i in range(50)]
    d = tokenfile.train_dictionary([x.astype("<u2").tobytes() for _, x in docs])
    assert tokenfile.write_shard(own, str(tmp_path / "a.tok"), d, docs, 2) == (50, sum(len(x) for _, x in docs))
    shard = tokenfile.Shard(own, str(tmp_path / "a.tok"), d)
    assert shard.ids(20).tolist() == list(range(60)) and [k for k, _ in shard] == list(range(50))
    with pytest.raises(ValueError):
        tokenfile.Shard(own, str(tmp_path / "a.tok"), d + b"x")
    with pytest.raises(ValueError, match="70000 needs more than 2 bytes"):
        tokenfile.write_shard(own, str(tmp_path / "b.tok"), d, [(1, np.array([70000], np.uint32))], 2)
    tokenfile.write_shard(own, str(tmp_path / "c.tok"), d, [(None, np.array([7])), (0, np.array([70000], np.uint32))], 4)
    assert [(k, x.tolist()) for k, x in tokenfile.Shard(own, str(tmp_path / "c.tok"), d)] == [(None, [7]), (0, [70000])]
    assert tokenfile.id_bytes(tokenizer_path(WORD_BPE), 1) == 2 and tokenfile.id_bytes(tokenizer_path(WORD_BPE), 1 << 16) == 4


def test_sentencepiece(spark, docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_BPE))
    got = {r.doc_id: r for r in pieces.encoded(docs, tokenizer_path(PIECE_BPE), with_ids=True).collect()}
    for d, t in rows:
        assert list(got[d].ids) == sp.encode(t or "") and got[d].parity and got[d].round_trip
        assert got[d].n_pieces == len(got[d].ids) and got[d].ids_crc32 == zlib.crc32(np.array(got[d].ids, "<u4").tobytes())


def test_sentencepiece_random():
    import sentencepiece

    path, rng = tokenizer_path(PIECE_BPE), random.Random(9)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path)
    alphabet = "aZ 'sé É\n<|>.,9ñ́Σ中 \t▁ß 　\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [t or "" for t in ODD]
    ids, same = own.encode(texts)
    assert all(same) and all(i.tolist() == sp.encode(t) for i, t in zip(ids, texts))
    assert all(own.decode(i) == t.replace("▁", " ") for i, t in zip(ids, texts))
    whole = own.model.tokenizer()
    assert all(whole.encode(t).ids == i.tolist() for i, t in zip(ids, texts) if t)


def test_unigram_model():
    """A model file built by hand: unigram scores, no byte fallback, spaces collapsed."""
    import sentencepiece

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(p, score, kind=1):
        return field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))

    body = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    for p, s in (("▁a", -1.5), ("▁", -3.0), ("a", -2.0), ("b", -2.1), ("ab", -2.5), ("▁ab", -4.9), ("ba", -3.3)):
        body += piece(p, s)
    body += field(2, bytes([0x18, 1])) + field(3, b"\x18\x01\x20\x01\x28\x01")
    sp = sentencepiece.SentencePieceProcessor(model_proto=body)
    own = pieces.PieceCodec(body)
    texts = ["ab", "aba  ab", " b a ", "", "abba", "a"]
    ids, same = own.encode(texts)
    assert all(same) and [i.tolist() for i in ids] == [sp.encode(t) for t in texts]
    assert [own.decode(i) for i in ids] == [sp.decode(sp.encode(t)) for t in texts]


def test_sentencepiece_odd(spark, odd):
    got = pieces.encoded(odd, tokenizer_path(PIECE_BPE)).collect()
    assert len(got) == len(ODD) + 3 and all(r.parity and r.round_trip for r in got)
    assert pieces.encoded(table(spark, []), tokenizer_path(PIECE_BPE)).count() == 0


# ------------------------------------------------------------------ classifiers


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right >= 0.93  # only some 300 texts to learn from here
    assert all(not r.predicted or r.toxic for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def word_hash(data):
    from lineweave.llm.common import byte_values, prefix_hash, span_hash

    b = np.frombuffer(data, np.uint8)
    return span_hash(prefix_hash(byte_values(b)), np.array([0]), np.array([len(b)]))[0]


def plain_toxic_features(text):
    """Buckets of the words of a text, and of pairs of words one to three apart."""
    from lineweave.llm.common import mix64

    low = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
    h = [word_hash(w) for w in re.findall(rb"[a-z0-9\x80-\xff]+", low)]
    found = {int(x >> np.uint64(64 - toxicity.BITS)) for x in h}
    with np.errstate(over="ignore"):
        for k in (1, 2, 3):
            for a, b in zip(h, h[k:]):
                x = mix64(np.array([a * np.uint64(3) + np.uint64(k) + mix64(np.array([b]))[0]]))[0]
                found.add(int(x >> np.uint64(64 - toxicity.BITS)))
    return sorted(found)


def plain_ftrl(examples, passes, rate, l1, l2):
    """Binary FTRL-proximal by the book, coordinate by coordinate."""
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / rate + l2)

    for _ in range(passes):
        for features, want in examples:
            w = {i: weight(i) for i in features}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + bias)))) - want
            for i in features:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rate * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= rate * g / (1 + math.sqrt(bias_n))
    return {i: weight(i) for i in z if weight(i)}, bias


def test_toxicity_by_definition(spark):
    """Every score from plainly written features and steps."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in text}
    from pyspark.sql import functions as F

    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    examples = [(plain_toxic_features(text[i]), known[i]) for i in sorted(known, key=lambda i: (order[i], known[i]))]
    w, bias = plain_ftrl(examples, toxicity.PASSES, toxicity.RATE, toxicity.L1, toxicity.L2)
    assert w and len(got) == len(text)
    for i, t in text.items():
        s = bias + sum(w.get(f, 0.0) for f in plain_toxic_features(t))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, s)))), abs=1e-4)
        assert got[i].predicted == (got[i].score >= 0.3)


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(ODD))] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ODD) + 3 and all(r.score is not None and r.held_out is not None for r in got)
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity(table(spark, []), labels).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def plain_ngrams(text):
    """Buckets of the n-grams of one to three code points of a lower-cased text, with their numbers."""
    t = [32 if ord(c) in (9, 10, 13) else ord(c) for c in (text or "").lower()]
    out = Counter()
    for i in range(len(t)):
        h = 0
        for k in range(min(3, len(t) - i)):
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ ((t[i + k] * 0x9E3779B1 + k) & 0xFFFFFFFF)
            x = h ^ (h >> 15)
            out[(x * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language.BITS)] += 1
    return out


def test_language_by_definition(spark):
    """Every prediction and score from plainly written features, steps and temperature."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h")).collect()
    known = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    grams = {r.doc_id: plain_ngrams(r.text) for r in rows}
    langs = sorted({r.lang for r in known})
    df = Counter(b for r in known for b in grams[r.doc_id])
    factor = defaultdict(lambda: language.SCALE * (math.log(1 + len(known)) + 1), {b: language.SCALE * (math.log((1 + len(known)) / (1 + k)) + 1) for b, k in df.items()})
    z, n = defaultdict(lambda: np.zeros(len(langs))), defaultdict(lambda: np.zeros(len(langs)))
    bias, bias_n = np.zeros(len(langs)), np.zeros(len(langs))

    def weight(b):
        return np.where(np.abs(z[b]) <= language.L1, 0, (np.sign(z[b]) * language.L1 - z[b]) / ((1 + np.sqrt(n[b])) / language.RATE + language.L2))

    def values(r):
        total = sum(grams[r.doc_id].values())
        return {b: k / total * factor[b] for b, k in grams[r.doc_id].items()}

    known = [r for r in sorted(known, key=lambda r: r.h) if grams[r.doc_id]]
    held = [((r.h >> 7) & 1023) < language.CALIBRATE * 1024 for r in known]
    for _ in range(language.PASSES):
        for r, out in zip(known, held):
            if out:
                continue
            v = values(r)
            w = {b: weight(b) for b in v}
            s = sum(w[b] * v[b] for b in v) + bias
            g = np.exp(s - s.max())
            g /= g.sum()
            g[langs.index(r.lang)] -= 1
            for b in v:
                gv = g * v[b]
                z[b] = z[b] + gv - (np.sqrt(n[b] + gv * gv) - np.sqrt(n[b])) / language.RATE * w[b]
                n[b] = n[b] + gv * gv
            bias_n += g * g
            bias -= language.RATE * g / (1 + np.sqrt(bias_n))

    def logits(r):
        return sum((weight(b) * x for b, x in values(r).items()), np.zeros(len(langs))) + bias

    trial = [(logits(r), langs.index(r.lang)) for r, out in zip(known, held) if out]
    loss = lambda t: sum(math.log(np.exp((s - s.max()) / t).sum()) - (s[k] - s.max()) / t for s, k in trial)
    best = min(np.geomspace(0.05, 20, 121), key=loss)
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    for r in rows:
        if r.text and any(c.isalpha() for c in r.text):
            p = np.exp((logits(r) - logits(r).max()) / best)
            p /= p.sum()
            assert got[r.doc_id].score == pytest.approx(p.max(), abs=2e-3) and got[r.doc_id].lang_pred == langs[int(p.argmax())]


def test_language_odd(spark, odd):
    got = language.languages(odd).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 3)) and by[10].lang_pred == "en"
    assert {r.lang_pred for r in language.languages(odd.withColumn("lang", odd.lang.substr(9, 1)).where("doc_id < 3")).collect()} == {"und"}
    assert language.languages(table(spark, [])).count() == 0


# ------------------------------------------------------------------ mixing


def test_targets():
    rng = random.Random(6)
    for _ in range(200):
        sizes = {s: rng.choice((0, rng.randint(1, 1000))) for s in ["b", "a", "c", None, "é", "Z"][: rng.randint(1, 6)]}
        got = mixing.targets(sizes, (3, 1, 2), 1.5, 2.0)
        assert math.isclose(sum(got.values()), 1.5 * sum(sizes.values()), abs_tol=1e-6)
        names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
        level = {got[s] / (3, 1, 2)[i % 3] for i, s in enumerate(names) if got[s] < 2 * sizes[s]}
        assert all(v <= 2 * sizes[s] for s, v in got.items()) and (not level or max(level) - min(level) < 1e-6)
        if level:
            assert all(2 * sizes[s] / (3, 1, 2)[i % 3] <= max(level) + 1e-6 for i, s in enumerate(names) if got[s] >= 2 * sizes[s])


def test_mix(docs, rows):
    got = mixing.mixed(docs).collect()
    by, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len(words(r.row.text)) and 0 <= r.copies <= 2
        by[r.row.source, r.target] += r.copies * r.size
        longest[r.row.source] = max(longest[r.row.source], r.size)
    assert all(abs(taken - target) <= longest[s] / 2 + 1 for (s, target), taken in by.items())
    again = {r.row.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    assert again == {r.row.doc_id: r.copies for r in got}
    assert mixing.mix(docs).count() == sum(again.values()) and mixing.mix(docs).columns == docs.columns


def test_mix_odd(spark, odd):
    got = mixing.mixed(odd).collect()
    assert len(got) == len(ODD) + 3 and all(r.copies is not None and r.target is not None for r in got)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mixed(table(spark, [])).count() == 0


# ------------------------------------------------------------------ embeddings


def cosine_truth(rows, threshold=0.95):
    fine = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(fine)
    x = np.array([fine[i] for i in ids]).reshape(len(ids), -1)
    s = x @ x.T >= threshold
    np.fill_diagonal(s, False)
    root = groups([(ids[a], ids[b]) for a, b in zip(*np.nonzero(s))], ids)
    n = dict(zip(ids, s.sum(axis=1).tolist()))
    return {i: (n.get(i, 0), root.get(i, i), root.get(i, i) == i) for i, _ in rows}


def test_embeddings(spark):
    """Groups of near copies from two to hundreds, at cosines about the threshold, hubs that join groups, exact copies."""
    rng = np.random.default_rng(3)
    vec = list(rng.standard_normal((600, 32)))
    for k in range(120):
        centre = vec[k]
        vec += near_copies(rng, centre / np.linalg.norm(centre), rng.integers(1, 4), rng.choice((0.15, 0.22, 0.3, 0.38)))
    hub = rng.standard_normal(32)
    hub /= np.linalg.norm(hub)
    vec += [hub, *near_copies(rng, hub, 250, 0.3)] + [hub * 3] * 20
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(len(vec)), vec)]
    want = cosine_truth(rows)
    assert sum(1 for v in want.values() if v[0]) > 300 and len({v[1] for v in want.values()}) > 600
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == want


def test_embeddings_repeated_ids(spark):
    """Every row comes back, also where a vec_id has several vectors."""
    a, b = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (2, b), (3, a), (4, [1.0, 0.0, 0.25])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 3, 1, True), (2, 1, 1, False), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False)]


def test_embeddings_odd(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 8))
    rows = [(k, (base[k % 6] + rng.normal(0, 0.12, 8)).astype(np.float32).tolist()) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(30)] + [(200, [2 * x for x in rows[0][1]])]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0] * 7 + [None]), (304, [float("nan")] * 8), (305, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()} == cosine_truth(rows)
    short = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n_links, r.kept) for r in vectors.near_duplicates(short).collect()} == {(1, 0, True), (2, 0, True), (None, 0, True)}
    assert vectors.near_duplicates(short.limit(0)).count() == 0


# ------------------------------------------------------------------ fingerprints


def test_entropy_sums():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 103, 500).astype(np.uint8)
    sums = digest.entropy_sums(data)
    for i in (0, 1, 77, 468):
        n = np.bincount(data[i : i + digest.WINDOW])
        assert sums[i] == sum(digest._SUM[x] for x in n)


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in digest.edited_likeness(docs).collect()}
    alone = {r.doc_id: r.fingerprint for r in digest.fingerprints(docs).collect()}
    near, other = [], []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        q = len(t) // 4
        new = t[: len(t) - q] + after[:q]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == alone[d] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        own, changed = (digest.digests(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0] for x in (t, new))
        assert r.fingerprint == digest._text(own) and r.edited_fingerprint == digest._text(changed)
        near.append(r.near_edited)
        other.append(r.near_next)
    assert np.median(near) > 0.5 and np.median(other) < 0.1
    by = defaultdict(set)
    for d, t in rows:
        by[t].add(got[d].fingerprint)
    assert all(len(x) == 1 for x in by.values())


def plain_features(text):
    """Windows of a text's bytes that win among RIVALS neighbours at least WINS times, by the definition."""
    data = text.encode()
    if len(data) < digest.WINDOW:
        return [data] if data else []
    windows = [data[i : i + digest.WINDOW] for i in range(len(data) - digest.WINDOW + 1)]

    def rarity(w):
        counts = Counter(w)
        if len(counts) == 1:
            return 0
        return abs(sum(int(digest._SUM[n]) for n in counts.values()) - digest._USUAL)

    rank = [rarity(w) for w in windows]
    wins = Counter()
    for a in range(-digest.RIVALS + 1, len(windows)):
        held = range(max(a, 0), min(a + digest.RIVALS, len(windows)))
        wins[max(held, key=lambda i: (rank[i], -i))] += 1
    return list(dict.fromkeys(windows[i] for i in sorted(wins) if wins[i] >= digest.WINS))


def test_features_by_definition(rows):
    texts = [t or "" for _, t in rows[:25]] + ["", "a", "b" * 31, "c" * 32, "d" * 500, "one two three four five six seven eight nine", *(("word %d and " % k) * 9 for k in range(5))]
    texts += [t[: 90 + k] for k, t in enumerate(t for _, t in rows if t and len(t) > 400) if k < 25]
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    row, h = digest.features(data, off)
    from lineweave.llm.common import byte_values, prefix_hash, span_hash

    for k, t in enumerate(texts):
        want = []
        for w in plain_features(t):
            b = np.frombuffer(w, np.uint8)
            want.append(int(span_hash(prefix_hash(byte_values(b)), np.array([0]), np.array([len(b)]))[0]))
        assert h[row == k].tolist() == want, t
        assert not t or want


def plain_likeness(a, b):
    """Overlap of two printed digests by sets of bits."""
    if a == b:
        return 1.0
    x, y = ([{i for i in range(digest.FILTER_BITS) if f[i // 8] >> i % 8 & 1} for f in (bytes.fromhex(s.split(":")[1])[k : k + digest.FILTER_BITS // 8] for k in range(0, len(s.split(":")[1]) // 2, digest.FILTER_BITS // 8))] for s in (a, b))
    if not x or not y:
        return 0.0
    x, y = sorted((x, y), key=len) if len(x) != len(y) else (x, y)
    best = []
    for f in x:
        scores = []
        for g in y:
            low, top = len(f) * len(g) / digest.FILTER_BITS, min(len(f), len(g))
            low += digest.CHANCE * (top - low)
            scores.append(min(1.0, max(0.0, (len(f & g) - low) / max(top - low, 1e-9))))
        best.append(max(scores))
    return sum(best) / len(best)


def test_likeness_by_definition(docs):
    got = digest.edited_likeness(docs).orderBy("doc_id").collect()
    for k, r in enumerate(got):
        after = got[(k + 1) % len(got)]
        assert r.near_edited == pytest.approx(plain_likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(plain_likeness(r.fingerprint, after.fingerprint))


def test_short_texts_have_features(spark):
    """No text that isn't empty has the empty text's fingerprint."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("etaoin shrdlu.,") for _ in range(n)) for n in range(1, 260)] + ["", None, "A plain sentence of just about ninety-eight characters, which is a length between two cases, yes"]
    got = {r.doc_id: r for r in digest.edited_likeness(table(spark, texts)).collect()}
    assert [d for d, t in enumerate(texts) if got[d].fingerprint == "0:"] == [259, 260] and got[258].near_next == 0 and got[260].near_next == 0


def test_fingerprints_odd(spark, odd):
    got = digest.edited_likeness(odd).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].fingerprint == by[1].fingerprint == "0:" and by[0].near_next == 1.0
    assert by[8].fingerprint == by[9].fingerprint and by[8].near_next == 1.0
    lone = digest.edited_likeness(table(spark, ["a lone document of some words"])).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert digest.edited_likeness(table(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op7_mixing", "op8_embeddings", "op9_line_dedup"])
def test_sql(spark, name):
    from oracle import connect, differ

    from lineweave.llm import queries

    sf = "/root/testdata/sf0.01"
    assert differ(spark, connect(sf), queries.queries()[name], queries.oracle_sql()[name], sf) == ""


def near_copies(rng, centre, n, spread):
    return [centre + spread * rng.standard_normal(len(centre)) / np.sqrt(len(centre)) for _ in range(n)]


def test_embeddings_links_between_dense_groups(spark):
    """Each vector has more near copies in its own group than a list holds; the links to the other group still count."""
    rng = np.random.default_rng(4)
    a, b, c = (x / np.linalg.norm(x) for x in rng.standard_normal((3, 64)))
    b -= (a @ b) * a
    b /= np.linalg.norm(b)
    t = 0.33
    rows = [(i, x.tolist()) for i, x in enumerate(near_copies(rng, a, 101, 0.1) + near_copies(rng, np.cos(t) * a + np.sin(t) * b, 101, 0.1) + near_copies(rng, c, 50, 3.0))]
    want = cosine_truth(rows)
    x = np.array([v / np.linalg.norm(v) for _, v in rows[:202]])
    s = x @ x.T
    across = s[:101, 101:] >= 0.95
    assert across.any() and not any((s[i, :101] > s[i, 101:].max()).sum() < 65 for i in range(101))
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_embeddings_large_bucket(spark):
    """Pairs in a bucket that is dealt out meet, whatever part they are in, with one table; more vectors need more tables."""
    rng = np.random.default_rng(6)
    one = np.abs(rng.standard_normal((700, 48))) * (rng.random((700, 48)) < 0.5)
    vec = np.concatenate([one, one + 0.1 * rng.random((700, 48))])
    rows = [(i, v.tolist()) for i, v in enumerate(vec)]
    df = spark.createDataFrame([(i, 0, 48, np.array(v, "<f8").tobytes()) for i, v in rows], "id long, c long, dim int, vec binary").selectExpr("id", "id as c", "dim", "vec")
    edges = vectors.first_neighbours(df, "<f8", 0.95, 4, range(1), 11, 0).where("sim >= 2").collect()
    want = {i: c for i, (_, c, _) in cosine_truth(rows).items()}
    assert groups([(r.u, r.v) for r in edges], list(want)) == want and len(set(want.values())) < 1000
    assert [vectors.table_count(n, 0.95) for n in (100_000, 1_000_000)] == [17, 24]


def test_embeddings_audit(spark, monkeypatch):
    """A large joined group doesn't outvote small ones that are lost, and what stays low isn't returned."""
    rng = np.random.default_rng(9)
    vec = near_copies(rng, 10 * np.eye(32)[0], 60, 0.1)
    for _ in range(40):
        vec += near_copies(rng, rng.standard_normal(32), 2, 0.01)
    rows = [(i, 32, np.array(v, "<f8").tobytes()) for i, v in enumerate(vec)]
    nodes = spark.createDataFrame(rows, "id long, dim int, vec binary")
    label = spark.createDataFrame([(i, 0) for i in range(60)], "node long, component long")
    assert vectors.audit(label, nodes, "<f8", 0.95, 200) == (pytest.approx(60 / 140), 140)
    assert vectors.audit(label, nodes.limit(1), "<f8", 0.95, 200) == (None, 0)
    monkeypatch.setattr(vectors, "audit", lambda *a: (0.5, 140))
    with pytest.raises(RuntimeError, match="recall 0.5000 of 140"):
        vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "vec_id long, embedding array<double>"), tables=1)


def test_line_runs_of_one_character(spark):
    """Lines of one length that meet in a run of one character count their links once."""
    texts = [x + "b" * 23 for x in "XYZ"] + ["Chapter " + str(k) + "." * 30 + str(k) for k in range(4)] + ["=" * 40, "=" * 39 + "x", "y" + "=" * 39, "=" * 42]
    want, links = line_truth(list(enumerate(texts)))
    assert want[0][1] == 2 and len(links) > 8
    got = {r.doc_id: (r.n_lines, r.n_links, r.n_again, r.kept_chars) for r in lines.line_report(table(spark, texts)).collect()}
    assert got == want
