"""SimHash near-duplicates: a binary trie joined with itself under a budget of differing bits."""

from __future__ import annotations

from itertools import combinations
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import _SPACE, cut, drop, mix64, partitions, pieces, settled, spread, utf8, words
from lineweave.llm.components import components

#: Share of shingles at which two texts are near copies, and the chance at which such a pair may have no root of the tries in common.
ALIKE, MISS = 0.8, 3e-5
#: Chance at most that a fingerprint bit differs between two sets at ALIKE, by their sizes' exact binomials; sets of at most TINY
#: shingles differ more often, as they have more ties.
UNLIKE, TINY, UNLIKE_TINY = 0.162, 5, 0.1875
#: 64-bit words of a wide fingerprint that are compared, bits in which they may differ to propose a pair (31 are expected at 0.8, with
#: a deviation of 5), sets of a trie node that are compared at once, and sets of a tile.
WIDE, FAR, LEAF, TILE = 3, 60, 256, 256
#: Bits of a root of the wide tries at least.
LEAST_ROOT = 6
#: Distinct fingerprints that share a root of the tries on average, at most, and blocks at which a root is taken at most.
ROOTED, MOST_BLOCKS = 4096, 5
#: Pairs of trie nodes that one step of the traversal holds.
FRONTIER = 400_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(data: np.ndarray, off: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the word shingles of all texts, and at which shingle each text begins."""
    data = _LOWER[data]
    s, e, at = words(data, off)
    n = np.diff(at)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    last = np.zeros(len(s), bool)
    last[at[1:][n > 0] - 1] = True
    keep = ~_SPACE[data]
    keep[e[~last]] = True  # one separator after each word but a text's last
    moved = np.cumsum(keep) - 1
    text = np.where(_SPACE[data], np.uint8(32), data)[keep].tobytes()
    s, e = moved[s], moved[e - 1] + 1
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    i = at[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    j = np.minimum(i + width, at[1:][row]) - 1
    f = xxhash.xxh64_intdigest
    return np.fromiter((f(text[a:b], seed) for a, b in zip(s[i].tolist(), e[j].tolist())), np.uint64, len(i)), begin


def majority(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The 64 bits that are set in over half the hashes of each row; rows without hashes get zero."""
    n = np.diff(begin)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): SimHash of the lower-cased (A-Z) word shingles of each whole text. Shorter texts have their
    whole word sequence as one shingle; null and wordless texts have fingerprint zero."""

    def run(batches):
        for b in batches:
            data, off = utf8(b.column("text"))
            fp = np.zeros(b.num_rows, np.uint64)
            for i, j in pieces(off):
                fp[i:j] = majority(*shingle_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], width, seed))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def trie_links(keys: np.ndarray, groups: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of the same group whose keys differ in at most budget bits.

    keys: sorted within each group. Each group is one binary trie over its sorted keys: a node is a range of rows. Node
    pairs go down together from (root, root); a step into unlike branches adds a differing bit, and pairs beyond the
    budget are dropped. Pairs of single rows are settled by counting the remaining bits at once.
    """
    found: list[np.ndarray] = []
    sizes = np.diff(groups)
    roots = np.flatnonzero(sizes > 1)
    lo, hi = groups[:-1][roots].astype(np.int32), groups[1:][roots].astype(np.int32)
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        bit, al, ah, bl, bh, d = stack.pop()
        if len(al) > FRONTIER:
            k = len(al) // 2
            stack += [(bit, al[:k], ah[:k], bl[:k], bh[:k], d[:k]), (bit, al[k:], ah[k:], bl[k:], bh[k:], d[k:])]
            continue
        one = (ah - al == 1) & (bh - bl == 1)
        if one.any():
            i, j = al[one], bl[one]
            good = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            found.append(np.stack([i[good], j[good]]))
            al, ah, bl, bh, d = (x[~one] for x in (al, ah, bl, bh, d))
        if not len(al) or bit < 0:
            if len(al):  # equal keys: all rows of both nodes
                for a0, a1, b0, b1 in zip(al.tolist(), ah.tolist(), bl.tolist(), bh.tolist()):
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(a0, a1), np.arange(b0, b1), indexing="ij"))
                    found.append(np.stack([i[i < j], j[i < j]]).astype(np.int32))
            continue
        if bit not in zeros:
            z = np.zeros(len(keys) + 1, np.int32)
            np.cumsum((keys >> np.uint64(bit)) & np.uint64(1) == 0, out=z[1:])
            zeros[bit] = z
        z = zeros[bit]
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        same = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + np.int8(1)), (am[~same], ah[~same], bl[~same], bm[~same], d[~same] + np.int8(1))]
        nxt = [np.concatenate(x) for x in zip(*parts)]
        ok = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget)
        ok &= ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1) & (nxt[3] - nxt[2] == 1))
        stack.append((bit - 1, *(x[ok] for x in nxt)))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    i, j = np.concatenate(found, axis=1)
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        if (a == b).all():
            return root
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]


def fingerprint_links(nodes: DataFrame, budget: int = 4, bits: int = 64) -> DataFrame:
    """Links (u, v) that join the same fingerprints as all pairs within budget differing bits do.

    nodes: (fp long, node long), one row for each distinct fingerprint. Fingerprints within the budget agree in r of
    budget + r blocks of bits at least, so for each choice of r blocks the trie is rooted at these with nothing to spare there:
    their value deals the fingerprints out, and the trie of each value is joined with itself. r grows with the number of
    fingerprints, so that about ROOTED share a root. A value that is much more frequent is dealt out as pairs of parts, so that no
    task grows with it. Within a task linked fingerprints form trees, so a group of copies gives as many links as it has
    members, not its square.
    """
    n = nodes.count()
    r = next((r for r in range(1, MOST_BLOCKS) if n >> r * (bits // (budget + r)) <= ROOTED), MOST_BLOCKS)
    blocks = budget + r
    width = [bits // blocks + (k < bits % blocks) for k in range(blocks)]
    shift = [bits - sum(width[: k + 1]) for k in range(blocks)]
    roots = list(combinations(range(blocks), r))
    most = max(512, 8 * n >> r * min(width))

    def value(chosen: tuple[int, ...]):
        out = F.lit(0).cast("long")
        for k in chosen:
            out = F.shiftleft(out, width[k]).bitwiseOR(F.shiftrightunsigned("fp", shift[k]).bitwiseAND((1 << width[k]) - 1))
        return out

    key = F.array(*(F.struct(F.lit(x).alias("block"), value(chosen).alias("value")) for x, chosen in enumerate(roots)))
    rows = nodes.select("fp", "node", F.explode(key).alias("k")).select("fp", "node", "k.block", "k.value")
    hot = rows.groupBy("block", "value").count().where(F.col("count") > most).withColumn("parts", F.ceil(F.col("count") / most).cast("int")).drop("count")
    rows = rows.join(hot, ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("fp", "node", "block", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def kernel(t, at):
        fp = t["fp"].to_numpy().view(np.uint64)
        node = t["node"].to_numpy()
        block = t["block"].to_numpy()[at[:-1]]
        block = np.repeat(block, np.diff(at))
        for x in np.unique(block):  # the chosen blocks come first
            own, out = block == x, np.zeros(np.count_nonzero(block == x), np.uint64)
            for k in (*roots[x], *(k for k in range(blocks) if k not in roots[x])):
                out = (out << np.uint64(width[k])) | ((fp[own] >> np.uint64(shift[k])) & np.uint64((1 << width[k]) - 1))
            fp = fp.copy()
            fp[own] = out << np.uint64(64 - bits)
        order = np.lexsort((fp, np.repeat(np.arange(len(at) - 1), np.diff(at))))
        fp, node = fp[order], node[order]
        i, j = trie_links(fp, at, budget)
        root = forest(len(fp), i, j)
        link = np.flatnonzero(root != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(node[link]), pa.array(node[root[link]])], ["u", "v"])

    return spread(rows, partitions(nodes), ["block", "value", "p", "q"], kernel, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs.

    Fingerprints link at budget or fewer differing bits; component_id is the smallest doc_id reachable. Null and
    wordless texts have fingerprint zero and link like others; rows that repeat a doc_id each give a row; a null doc_id
    gives a row whose component is that of its fingerprint; an empty table gives an empty one. Rows of one doc_id link what any
    of them links. Columns besides doc_id and text are not looked at.
    """
    fps = cut(fingerprints(docs, width, seed))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    named = nodes.where("node is not null")
    found = cut(components(fingerprint_links(named, budget)))
    label = cut(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    drop(nodes, found)
    return settled(fps.join(label, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), fps, label)


def roots_of(n: int) -> tuple[int, int, int]:
    """Bits of a root, the same for tiny sets, and roots of each wide fingerprint, so that about ROOTED of n share a root and a
    pair at ALIKE shares none with a chance of MISS at most."""
    bits = max(LEAST_ROOT, (n // max(ROOTED, 1)).bit_length())
    agree = (1 - UNLIKE) ** bits
    return bits, int(log(agree) / log(1 - UNLIKE_TINY)), ceil(log(MISS) / log1p(-agree))


_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def wide_bits(hashes: np.ndarray, begin: np.ndarray, count: int) -> np.ndarray:
    """SimHash of each row in count words of 64 bits, one column a bit; the first word is majority()'s. Rows without hashes get
    zeros."""
    n = np.diff(begin)
    out = np.zeros((len(n), 64 * count), np.uint8)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    many = -(-n[full] // 255)  # byte lanes hold the sums of 255 shingles
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    at = np.repeat(begin[:-1][full], many) + 255 * (np.arange(many.sum()) - np.repeat(first, many))
    for k in range(count):
        h = (mix64(hashes ^ mix64(np.array([k], np.uint64))) if k else hashes).view(np.uint8).reshape(-1, 8)
        for x in range(8):
            ones = np.add.reduceat(np.add.reduceat(_LANES[h[:, x]], at).view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int32)
            out[full, 64 * k + 8 * x : 64 * k + 8 * x + 8] = 2 * ones > n[full][:, None]
    return out


def shingle_sets(docs: DataFrame, width: int, seed: int, total: int | None = None) -> DataFrame:
    """(doc_id, mark, size, fp) of each row: a hash of its set of shingles, their number and WIDE words of the set's SimHash; with
    `roots`, the roots of its fingerprint among `total` ones, or without a total with the sorted `shingles` themselves."""
    bits, short, many = roots_of(total or 0)

    def run(batches):
        for b in batches:
            data, off = utf8(b.column("text"))
            for i, j in pieces(off):
                h, begin = shingle_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], width, seed)
                sets = [np.unique(h[x:y]) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]
                size = np.array([len(x) for x in sets], np.int32)
                wide = wide_bits(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), WIDE if total is None else max(WIDE, -(-bits * many // 64)))
                fp = np.packbits(wide[:, : 64 * WIDE], axis=1, bitorder="little")
                marks = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                cols = [b.column("doc_id").slice(i, j - i), pa.array(marks, pa.binary()), pa.array(size), pa.array([x.tobytes() for x in fp], pa.binary())]
                if total is None:
                    cols.append(pa.array([x.tobytes() for x in sets], pa.binary()))
                else:
                    runs = wide[:, : bits * many].reshape(-1, many, bits)
                    tiny = np.flatnonzero(size <= TINY)
                    at = np.concatenate([[0], np.cumsum(many * (1 + (size <= TINY)))]).astype(np.int32)
                    value = np.zeros(at[-1], np.int64)
                    place = at[:-1, None] + np.arange(many)
                    value[place] = runs @ (1 << np.arange(bits)) + (np.arange(many) << bits)
                    value[place[tiny] + many] = runs[tiny][:, :, :short] @ (1 << np.arange(short)) + (np.arange(many, 2 * many) << bits)
                    cols.append(pa.ListArray.from_arrays(at, pa.array(value)))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "size", "fp", "shingles" if total is None else "roots"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, mark binary, size int, fp binary, " + ("shingles binary" if total is None else "roots array<long>"))


def paired(rows: DataFrame, keys: list[str], most: int, node: str = "node") -> DataFrame:
    """rows with columns own, p and q: groups of more than `most` rows are dealt out as pairs of parts, in one of which any two
    of a group's rows meet."""
    hot = rows.groupBy(*keys).count().where(F.col("count") > most).withColumn("parts", F.ceil(F.col("count") / most).cast("int")).drop("count")
    rows = rows.join(hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(node), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("parts", "other")


def wide_links(fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of rows of fp that differ in at most budget bits, and in how many.

    fp: words by row, sorted by the first word. Its bits make a binary trie that is joined with itself as in trie_links(), but pairs
    of nodes of at most LEAF rows are settled at once by counting the differing bits of all words; rows of one first word are
    halved."""
    words = list(np.ascontiguousarray(fp.T))
    mids: dict[tuple[int, int, int], int] = {}

    def mid(bit: int, lo: int, hi: int) -> int:
        if bit < 0:
            return (lo + hi) // 2
        if (bit, lo, hi) not in mids:
            high = int(words[0][lo]) >> bit << bit | 1 << bit
            mids[bit, lo, hi] = lo + int(np.searchsorted(words[0][lo:hi], np.uint64(high)))
        return mids[bit, lo, hi]

    side = min(LEAF, len(fp))
    held = [np.empty((side, side), kind) for kind in (np.uint64, np.uint8, np.uint8)]
    found = []
    stack = [(63, 0, len(fp), 0, len(fp), 0)] if len(fp) > 1 else []
    while stack:
        bit, al, ah, bl, bh, d = stack.pop()
        if ah - al <= LEAF and bh - bl <= LEAF:
            x, one, far = (b[: ah - al, : bh - bl] for b in held)
            far[:] = 0
            for w in words:
                np.bitwise_xor(w[al:ah, None], w[None, bl:bh], out=x)
                far += np.bitwise_count(x, out=one)
            i, j = np.divmod(np.flatnonzero(far <= budget), bh - bl)
            if al == bl:
                i, j = i[i < j], j[i < j]
            if len(i):
                found.append((i + al, j + bl, far[i, j]))
            continue
        am, bm, step = mid(bit, al, ah), mid(bit, bl, bh), int(bit >= 0)
        pairs = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + step)]
        if al != bl:
            pairs.append((am, ah, bl, bm, d + step))
        stack += [(bit - 1, *x) for x in pairs if x[1] > x[0] and x[3] > x[2] and x[4] <= budget]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*found))


def maybe_alike(fp: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j whose sizes allow a Jaccard similarity of `least` and whose wide fingerprints are near, nearest first."""
    order = np.argsort(fp[:, 0], kind="stable")
    i, j, far = wide_links(fp[order], FAR)
    i, j = order[i], order[j]
    i, j = np.minimum(i, j), np.maximum(i, j)
    ok = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])
    i, j, far = i[ok], j[ok], far[ok]
    nearest = np.lexsort((j, i, far))
    return i[nearest], j[nearest]


def wide_words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE)


def alike_links(docs: DataFrame, nodes: DataFrame, total: int, width: int, seed: int, least: float) -> DataFrame:
    """Links (u, v) that join the same nodes as all pairs of shingle sets with a Jaccard similarity of `least` do.

    nodes: (mark, node, size, fp, roots), one row for each distinct set. Fingerprints that share a root, the same bits at one of
    as many places as roots_of() gives, make a trie that is joined with itself under a budget of FAR differing bits and so
    proposes pairs; within what these connect, each pair of sets within the budget is compared exactly, unless links join it
    already. Roots and groups that many sets share are dealt out as pairs of parts, and a task gives trees, so no table grows with
    the square of a group.
    """

    def propose(t, at):
        node, fp, size = t["node"].to_numpy(), wide_words(t["fp"]), t["size"].to_numpy()
        us, vs = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a > 1:
                root = forest(b - a, *maybe_alike(fp[a:b], size[a:b], least))
                link = np.flatnonzero(root != np.arange(b - a))
                us.append(node[a:b][link])
                vs.append(node[a:b][root[link]])
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cat], ["u", "v"])

    rows = nodes.where("size > 0").select("node", "size", "fp", F.explode("roots").alias("value"))
    most = max(512, 2 * total >> roots_of(total)[0])
    loose = cut(components(spread(paired(rows, ["value"], most), partitions(docs), ["value", "p", "q"], propose, "u long, v long")))
    sets = shingle_sets(docs.join(loose.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), width, seed)
    rows = sets.where("size > 0").join(loose, sets.doc_id == loose.node).select("component", "node", "mark", "size", "fp", "shingles")

    def compare(t, at):
        node, fp, size = t["node"].to_numpy(), wide_words(t["fp"]), t["size"].to_numpy()
        us, vs = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            held = [np.frombuffer(x, np.uint64) for x in t["shingles"].slice(a, b - a).to_pylist()]
            root = list(range(b - a))

            def top(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            i, j = maybe_alike(fp[a:b], size[a:b], least)
            for x, y in zip(i.tolist(), j.tolist()):
                r, s = top(x), top(y)
                if r != s:
                    both = len(held[x]) + len(held[y])
                    same = len(np.intersect1d(held[x], held[y], assume_unique=True))
                    if same / (both - same) >= least:
                        root[max(r, s)] = min(r, s)
            ends = np.array([top(x) for x in range(b - a)])
            link = np.flatnonzero(node[a:b] != node[a:b][ends])
            us.append(node[a:b][link])
            vs.append(node[a:b][ends[link]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])

    found = cut(spread(paired(rows, ["component"], TILE), partitions(docs), ["component", "p", "q"], compare, "u long, v long"))
    drop(loose)
    return found


def similar(docs: DataFrame, width: int = 5, seed: int = 42, least: float = ALIKE) -> DataFrame:
    """(doc_id, component_id) of each row of docs: texts link when the Jaccard similarity of their sets of word shingles is
    `least` or more, and component_id is the smallest doc_id reachable. SimHash fingerprints of the sets propose the pairs (for a
    `least` of ALIKE or more), their exact similarity decides. Null and wordless texts link with each other; rows that
    repeat a doc_id each give a row, and link what any of their texts link."""
    total = docs.count()
    sets = cut(shingle_sets(docs, width, seed, total))
    nodes = cut(sets.groupBy("mark").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("roots").alias("roots")))
    found = cut(components(alike_links(docs, nodes.where("node is not null"), total, width, seed, least)))
    label = cut(nodes.join(found, "node", "left").select("mark", F.coalesce("component", "node").alias("component_id")))
    drop(nodes, found)
    return settled(sets.join(label, "mark").select("doc_id", "component_id"), sets, label)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without all but the smallest doc_id of each group of similar() texts. Rows without a doc_id stay, as do all
    rows of a doc_id that stays; null, empty and wordless texts are one group. All columns stay."""
    kept = similar(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept, "doc_id", "left_semi").select(docs.columns))
