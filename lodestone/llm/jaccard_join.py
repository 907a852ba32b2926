"""N-gram Jaccard join with a prefix tree.

A document's set is its distinct word n-grams, as 64-bit hashes. A document whose n-grams are too rarely held by
others to reach the threshold has no partner; which ones others hold is found by dealing n-grams to buckets. What is left is
ordered globally, rarest first; documents that share an n-gram of their prefixes meet in blocks, in whose prefix trees
they are joined: paths shared by many sets are walked once, and subtrees are pruned by what is left of both lengths.
A block that is too large for one tree is cut into cells, by the n-grams of the prefixes, and two cells meet only with
those of their documents that share such an n-gram.
"""

from __future__ import annotations

import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import lean, materialize, small_batches
from .components import components
from .hashing import SpanHasher, mix
from .packing import slices

#: Words of an n-gram and the least Jaccard similarity, as a fraction.
N, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Bytes of text of a slice, whose n-grams are counted together before they are dealt out.
SLICE = 2 << 20
#: Bytes of text whose n-grams are hashed at once.
PART = 1 << 19
#: N-grams of a bucket; cost of the sets that one tree holds: their n-grams, and so many more for each set.
BUCKET, TREE, EACH = 1 << 19, 1 << 18, 128
#: Sets of large blocks that are sent to every executor, as rows of a few numbers; more are joined by a shuffle.
SENT = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[bytes], hasher: SpanHasher, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every text's distinct n-grams, sorted; a shorter text is one n-gram, one without words none.

    Texts are taken a part at a time, so that the arrays of a part stay small.
    """
    sizes = np.cumsum([0] + [len(t) + 1 for t in texts])
    cut = np.unique(np.append(np.searchsorted(sizes, np.arange(0, sizes[-1], PART)), len(texts))).tolist()
    found = [(a, *_shingles(texts[a:b], hasher, n)) for a, b in zip([0, *cut[:-1]], cut, strict=True) if a < b]
    return np.concatenate([np.empty(0, np.int64), *(a + own for a, own, _ in found)]), np.concatenate([np.empty(0, np.uint64), *(key for _, _, key in found)])


def _shingles(texts: list[bytes], hasher: SpanHasher, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    word = ~_BLANK[data]
    before = np.concatenate([[False], word[:-1]])
    start, stop = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
    each = hasher.spans(hasher.sums(data), start, stop)
    text = np.searchsorted(begin, start, "right") - 1
    size = np.bincount(text, minlength=len(texts))
    rows = len(each) - n + 1
    h = np.zeros(max(rows, 0), np.uint64)
    for k in range(n if rows > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + rows]
    whole = text[: len(h)] == text[n - 1 :] if rows > 0 else np.empty(0, bool)
    key, owner = mix(h[whole] + np.uint64(n)), text[: len(h)][whole]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        first = np.cumsum(size) - size
        extra = []
        for k in short.tolist():
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for v in each[first[k] : first[k] + size[k]]:
                    x = x * np.uint64(0x9E3779B97F4A7C15) + v
                extra.append(x + np.uint64(size[k]))
        key, owner = np.concatenate([key, mix(np.array(extra, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], key[new]


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """The least overlap with any partner of a set of n."""
    return -(-NUMERATOR * n // DENOMINATOR)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one byte string: the numbers' lowest bytes, then their second ones and so on, which compress better."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        parts += [struct.pack("<cQ", a.dtype.char.encode(), a.nbytes), np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind, size = struct.unpack_from("<cQ", data, at)
        kind = np.dtype(kind.decode())
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at + 9).reshape(kind.itemsize, -1).T).view(kind).reshape(-1))
        at += 9 + size
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; the first one from 0."""
    return np.diff(x, prepend=x.dtype.type(0))


def _batch(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in names], [n for n, _ in names])


DEALT = "key bigint, slice bigint, data binary"


def bucket_starts(buckets: int) -> np.ndarray:
    """The least hash of each of so many equal ranges."""
    width = -(-(1 << 64) // buckets)
    return np.arange(buckets, dtype=np.uint64) * np.uint64(width % (1 << 64))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The range of each hash."""
    width = -(-(1 << 64) // buckets)
    return (key // np.uint64(width)).astype(np.int64) if buckets > 1 else np.zeros(len(key), np.int64)


def _deal(docs: DataFrame, buckets: int, n: int) -> DataFrame:
    """Each slice's n-grams by bucket: those of one document of the slice with its place, those of more with their count.

    A row with a negative key stays with its slice: its documents with sizes, digests and the n-grams that they share within it.
    So a slice sends an n-gram once, however many of its documents hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, number, starts = SpanHasher(), TaskContext.get().partitionId() << 24, bucket_starts(buckets)
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE):
                own, key = shingles([x or b"" for x in batch.column(1)[lo:hi].cast(pa.binary()).to_pylist()], hasher, n)
                size = np.bincount(own, minlength=hi - lo)
                cut = np.concatenate([[0], np.cumsum(size)])
                spread = mix(key ^ np.uint64(0x2545F4914F6CDD1D))
                zero = np.zeros(1, np.uint64)
                sums, twists = np.concatenate([zero, np.cumsum(key)]), np.concatenate([zero, np.cumsum(spread)])
                order = np.argsort(key, kind="stable")
                key, own = key[order], own[order].astype(np.min_scalar_type(hi - lo))
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                count = np.diff(np.append(first, len(key)))
                many = count > 1
                rows = [(-1 - number, number, pack(batch.column(0)[lo:hi].to_numpy(), size, sums[cut[1:]] - sums[cut[:-1]], twists[cut[1:]] - twists[cut[:-1]], gaps(key[first[many]]), count[many].astype(np.uint32), own[np.repeat(many, count)]))]
                # Hashes are sorted, so buckets of equal ranges of them are runs; those that get nothing are passed over.
                alone, alone_own, each, count = key[first[~many]], own[first[~many]], key[first[many]], count[many].astype(np.uint32)
                to = np.unique(np.concatenate([bucket_of(alone, buckets), bucket_of(each, buckets)]))
                at, of = np.searchsorted(alone, starts[to]).tolist(), np.searchsorted(each, starts[to]).tolist()
                for k, a, b, c, d in zip(to.tolist(), at, [*at[1:], len(alone)], of, [*of[1:], len(each)], strict=False):
                    rows.append((k, number, pack(gaps(alone[a:b]), alone_own[a:b], gaps(each[c:d]), count[c:d])))
                number += 1
                yield _batch(DEALT, key=[r[0] for r in rows], slice=[r[1] for r in rows], data=[r[2] for r in rows])

    return docs.mapInArrow(lean(run), DEALT)


def _count(dealt: pa.Table) -> pa.Table:
    """A bucket: how many documents hold each n-gram; tells each slice of those that more than one holds."""
    bucket = dealt["key"][0].as_py()
    if bucket < 0:
        return dealt
    number, parts = dealt["slice"].to_numpy(), [unpack(x) for x in dealt["data"].to_pylist()]
    alone, many = [np.cumsum(p[0]) for p in parts], [np.cumsum(p[2]) for p in parts]
    each, place = np.unique(np.concatenate(alone + many), return_inverse=True)
    n_alone = sum(map(len, alone))
    held = np.bincount(place, np.concatenate([np.ones(n_alone, np.int64), *(p[3] for p in parts)]), len(each)).astype(np.uint32)[place]
    at, of = np.cumsum([0] + [len(x) for x in alone]), n_alone + np.cumsum([0] + [len(x) for x in many])
    rows = []
    for k, p in enumerate(parts):
        h = held[at[k] : at[k + 1]]
        live = h > 1
        if live.any() or of[k] < of[k + 1]:
            rows.append((int(number[k]), pack(gaps(alone[k][live]), p[1][live], h[live], held[of[k] : of[k + 1]])))
    return pa.Table.from_batches([_batch(DEALT, key=[bucket] * len(rows), slice=[r[0] for r in rows], data=[r[1] for r in rows])])


SETS = "doc_id bigint, n bigint, digest_a bigint, digest_b bigint, held bigint, tokens binary"


def _sets(rows: pa.Table) -> pa.Table:
    """A slice: each document's n-grams that others hold too, rarest first; none for a document that has too few of them."""
    data, bucket = rows["data"].to_pylist(), rows["key"].to_numpy()
    home, *told = np.argsort(bucket, kind="stable").tolist()  # the slice's own row, then the buckets' in order
    ids, size, a, b, key, count, own = unpack(data[home])
    told = [unpack(data[k]) for k in told]
    key, own = np.repeat(np.cumsum(key), count), own.astype(np.int64)
    df = np.repeat(np.concatenate([np.empty(0, np.uint32), *(p[3] for p in told)]), count)
    key = np.concatenate([key, *(np.cumsum(p[0]) for p in told)])
    own = np.concatenate([own, *(p[1].astype(np.int64) for p in told)])
    df = np.concatenate([df, *(p[2] for p in told)])
    order = np.lexsort((key, df, own))
    own, key = own[order], key[order]
    cut = np.searchsorted(own, np.arange(len(ids) + 1))
    shared = np.diff(cut)
    live = (shared >= needed(size)) & (size > 0)
    tokens = [pack(key[cut[k] : cut[k + 1]]) if live[k] else None for k in range(len(ids))]
    out = _batch(SETS, doc_id=ids, n=size.astype(np.int64), digest_a=a.view(np.int64), digest_b=b.view(np.int64), held=shared.astype(np.int64), tokens=tokens)
    return pa.Table.from_batches([out])


#: Sizes of partners differ by the threshold at most, so they are in the same or neighbouring classes.
def _class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(DENOMINATOR / NUMERATOR) + 1e-9).astype(np.int64)


PREFIX = "token bigint, class bigint, node bigint"


def _prefixes(sets: DataFrame) -> DataFrame:
    """(token, size class, document): a document's prefix, in its own size class and the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, held = (batch.column(k).to_numpy() for k in range(3))
            # The prefix's first n-grams are those that no one else holds.
            take = n - needed(n) + 1 - (n - held)
            token = [unpack(x)[0][:k].view(np.int64) for x, k in zip(batch.column(3).to_pylist(), take.tolist(), strict=True)]
            own = np.repeat(np.arange(len(node)), [len(x) for x in token])
            token = np.concatenate(token) if len(token) else np.empty(0, np.int64)
            size = _class(n)[own]
            for up in (0, 1):
                yield _batch(PREFIX, token=token, **{"class": size + up}, node=node[own])

    return sets.select("node", "n", "held", "tokens").mapInArrow(lean(run), PREFIX)


class Tree:
    """A prefix tree of sets of ranks, in runs of at most RUN ranks, laid out level by level."""

    RUN = 32

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        keys = [x.astype(">u4").tobytes() for x in sets]
        # Nodes: the places lo to hi of a set's ranks, the member that ends there or -1, and the nodes below.
        owner, lo, hi, member, kids = [], [], [], [], [[]]  # kids[-1]: of the root

        def add(up: int, of: int, a: int, b: int) -> list[int]:
            new = []
            while not new or a < b:
                c = min(b, a + self.RUN)
                kids[up].append(len(owner))
                up = len(owner)
                new.append(up)
                owner.append(of)
                lo.append(a)
                hi.append(c)
                member.append(-1)
                kids.insert(-1, [])
                a = c
            return new

        path: list[int] = []  # nodes of the set before
        last = np.empty(0, np.int64)
        for k in sorted(range(len(sets)), key=keys.__getitem__):
            x = sets[k]
            w = min(len(last), len(x))
            differ = np.flatnonzero(last[:w] != x[:w])
            m = int(differ[0]) if len(differ) else w
            while path and lo[path[-1]] >= m:
                path.pop()
            if path and hi[path[-1]] > m:  # the run is cut where the sets part; its lower part takes what is below
                top = path[-1]
                owner.append(owner[top])
                lo.append(m)
                hi.append(hi[top])
                member.append(member[top])
                kids.insert(-1, kids[top])
                kids[top], hi[top], member[top] = [len(owner) - 1], m, -1
            if m < len(x) or not path or member[path[-1]] >= 0:
                path += add(path[-1] if path else -1, k, m, len(x))
            member[path[-1]] = k
            last = x
        n = len(owner)
        level, order, up = kids[-1], [], [-1] * n
        self.roots = len(level)
        while level:
            order += level
            for v in level:
                for c in kids[v]:
                    up[c] = v
            level = [c for v in level for c in kids[v]]
        order = np.array(order, np.int64)
        new = np.empty(n + 1, np.int64)
        new[order], new[n] = np.arange(n), -1
        up = new[np.array(up, np.int64)[order]]
        lo, hi, owner, self.member = (np.array(v, np.int64)[order] for v in (lo, hi, owner, member))
        self.kid_first = np.searchsorted(up, np.arange(n))
        self.kid_last = np.searchsorted(up, np.arange(n), "right")
        self.length = hi - lo
        start = np.cumsum([0] + [len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        at = np.repeat(start[owner] + lo - (np.cumsum(self.length) - self.length), self.length) + np.arange(self.length.sum())
        self.ranks = flat[at]
        self.begin = np.cumsum(self.length) - self.length
        self.end_rank = flat[np.maximum(start[owner] + hi - 1, 0)] if n else hi
        self.depth = hi
        # What is left below a node, and the smallest set there.
        self.most, self.least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        real = self.member >= 0
        lengths = np.array([len(s) for s in sets], np.int64)
        self.most[real], self.least[real] = lengths[self.member[real]], sizes[self.member[real]]
        for k in range(n - 1, -1, -1):
            if up[k] >= 0:
                self.most[up[k]] = max(self.most[up[k]], self.most[k])
                self.least[up[k]] = min(self.least[up[k]], self.least[k])
        self.sizes = sizes

    def partners(self, x: np.ndarray, size: int, mark: np.ndarray) -> np.ndarray:
        """Members whose similarity with the set x of `size` n-grams is high enough; mark: a zero for every rank."""
        mark[x] = 1
        node, overlap, out = np.arange(self.roots), np.zeros(self.roots, np.int64), []
        while len(node):
            n = self.length[node]
            at = np.repeat(self.begin[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            total = np.concatenate([[0], np.cumsum(mark[self.ranks[at]])])
            ends = np.cumsum(n)
            overlap = overlap + total[ends] - total[ends - n]
            left = np.minimum(len(x) - np.searchsorted(x, self.end_rank[node], "right"), self.most[node] - self.depth[node])
            both = NUMERATOR + DENOMINATOR
            live = both * (overlap + left) >= NUMERATOR * (size + self.least[node])
            node, overlap = node[live], overlap[live]
            own = self.member[node]
            hit = (own >= 0) & (both * overlap >= NUMERATOR * (size + self.sizes[own]))
            out.append(own[hit])
            c = self.kid_last[node] - self.kid_first[node]
            overlap = np.repeat(overlap, c)
            node = np.repeat(self.kid_first[node] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        mark[x] = 0
        return np.concatenate(out) if out else np.empty(0, np.int64)


def join_block(tokens: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: their n-grams in global order, rarest first, and their full sizes.

    side: with it, only links between sets of both sides are sought.
    """
    each, place = np.unique(np.concatenate(tokens), return_inverse=True)
    # In the tree the order is turned round, commonest first, so that copies share long paths.
    count = np.bincount(place, minlength=len(each))
    rank = np.empty(len(each), np.int64)
    rank[np.lexsort((each, -count))] = np.arange(len(each))
    cut = np.cumsum([0] + [len(t) for t in tokens])
    sets = [np.sort(rank[place[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    held = np.arange(len(sets)) if side is None else np.flatnonzero(~side)
    asked = held if side is None else np.flatnonzero(side)
    tree, mark, label, out = Tree([sets[k] for k in held.tolist()], sizes[held]), np.zeros(len(each), np.int64), np.arange(len(sets)), []
    for k in asked.tolist():
        found = held[tree.partners(sets[k], int(sizes[k]), mark)]
        found = found[label[found] != label[k]]
        if len(found):  # one link to each part that it joins
            parts, one = np.unique(label[found], return_index=True)
            out += [(k, p) for p in found[one].tolist()]
            label[np.isin(label, parts)] = label[k]
    return out


LINKS = "a bigint, b bigint"


def _links(table: pa.Table) -> pa.Table:
    """A task's blocks, one after another: (x, x) joins a cell's sets, (x, y) those of two cells, of which side tells."""
    x, y, node = (table[c].to_numpy() for c in ("x", "y", "node"))
    order = np.lexsort((node, y, x))
    table = table.take(pa.array(order))
    x, y, node, n, side = x[order], y[order], node[order], table["n"].to_numpy(), table["side"].to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])).tolist() + [len(x)]
    a, b = [], []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        tokens = [unpack(t)[0] for t in table["tokens"][lo:hi].to_pylist()]
        for p, q in join_block(tokens, n[lo:hi], None if x[lo] == y[lo] else side[lo:hi].astype(bool)):
            a.append(int(node[lo + p]))
            b.append(int(node[lo + q]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


PIECE = ["x", "y", "node", "side"]


def _pieces(prefix: DataFrame, blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y, node, side): which sets meet. prefix: (token, class, node) where more than one set has the token.

    A block of one tree is a cell. A larger one is cut: sets with the same least n-gram go to a cell together, as near copies
    mostly do, and where these are too many they are dealt over several.
    """
    cost = F.col("held") + EACH
    own = blocks.join(classes.select("node", cost.alias("cost")), "node")
    load = materialize(own.groupBy("block").agg(F.sum("cost").alias("load")), "loads")
    whole = blocks.join(load.where(F.col("load") <= TREE), "block").select(F.col("block").alias("x"), F.col("block").alias("y"), "node", F.lit(0).alias("side"))
    large = load.where(F.col("load") > TREE)
    if large.isEmpty():
        return whole
    # Prefixes are many, the sets of large blocks are few: where these can be sent, prefixes stay where they are.
    inside = materialize(own.join(large, "block"), "inside")
    few_sets = common.small_enough(inside, SENT)
    sent = F.broadcast if few_sets else lambda df: df
    inner = prefix.join(sent(inside), "node")
    anchor = inner.groupBy("node").agg(F.min(F.xxhash64("token")).alias("anchor"), F.first("block").alias("block"), F.first("cost").alias("cost"), F.first("load").alias("load"))
    anchor = materialize(anchor, "anchors")
    group = anchor.groupBy("block", "anchor").agg(F.ceil(F.sum("cost") / TREE).cast("bigint").alias("parts"))
    few, many = F.xxhash64("block", F.pmod("anchor", F.ceil(F.col("load") / TREE).cast("bigint"))), F.xxhash64("block", "anchor", F.pmod(F.xxhash64("node"), F.col("parts")))
    cell = materialize(anchor.join(group, ["block", "anchor"]).select("node", F.when(F.col("parts") > 1, many).otherwise(few).alias("cell")), "cells")
    met = prefix.join(sent(cell), "node")
    # Only n-grams of several cells are dealt out again.
    spans = met.groupBy("token", "class").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).where("lo <> hi").select("token", "class")
    met = materialize(met.join(spans, ["token", "class"]), "met")
    other = met.select("token", "class", F.col("cell").alias("other")).distinct()
    cross = met.join(other, ["token", "class"]).where("cell <> other")
    cross = cross.select(F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"), "node", (F.col("cell") > F.col("other")).cast("int").alias("side")).distinct()
    home = cell.select(F.col("cell").alias("x"), F.col("cell").alias("y"), "node", F.lit(0).alias("side"))
    return whole.unionByName(home).unionByName(cross)


def similar(docs: DataFrame, *, n: int = N, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that a document reaches over links, itself included.

    Two documents link if the Jaccard similarity of their sets of distinct word n-grams is at least NUMERATOR / DENOMINATOR.
    Words are runs of other characters than ASCII white space, A-Z in lower case; a text of fewer than n words is one n-gram.
    Null and empty texts have the empty set and link with nothing. Documents with equal sets are joined as one
    class; repeated rows are copies and come back as often. A row of null doc_id links with nothing and has a null component_id.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = common.words(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    grams = F.when(F.size(words) <= n, F.array(F.concat_ws(" ", words))).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n))))
    count = F.when(F.size(words) == 0, 0).otherwise(F.size(F.array_distinct(grams))).cast("bigint")
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", count.alias("n_shingles"), F.col("doc_id").alias("component_id"))
    docs = docs.where(F.col("doc_id").isNotNull())
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, bytes_ // (6 * BUCKET))
    dealt = _deal(docs, buckets, n).repartition(max(12, buckets // 4), "key")
    told = dealt.groupBy("key").applyInArrow(lean(_count), DEALT)
    sets = materialize(told.groupBy("slice").applyInArrow(lean(_sets), SETS), "sets")

    classes = (
        sets.where(F.col("tokens").isNotNull())
        .groupBy("digest_a", "digest_b", "n")
        .agg(F.min("doc_id").alias("node"), F.max("held").alias("held"), F.min_by("tokens", "doc_id").alias("tokens"))
    )
    classes = materialize(classes, "classes")
    prefix = _prefixes(classes)
    met = prefix.groupBy("token", "class").agg(F.min("node").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
    prefix = materialize(prefix.join(met, ["token", "class"]), "prefixes")
    blocks = materialize(components(prefix.where("node <> b").select(F.col("node").alias("a"), "b").distinct()).withColumnsRenamed({"component": "block"}), "blocks")
    pieces = materialize(_pieces(prefix.drop("b"), blocks, classes), "pieces")
    pieces = pieces.join(classes.select("node", "n", "tokens", (F.col("held") + EACH).alias("cost")), "node")
    tasks = max(12, (pieces.agg(F.sum("cost")).first()[0] or 0) // (TREE // 4))
    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("x", "y"), F.lit(16 * tasks))).select("task", *PIECE, "n", "tokens")
    links = materialize(dealt.repartition(tasks, "task").groupBy("task").applyInArrow(lean(_links), LINKS), "links")

    found = components(links)
    name = classes.select("digest_a", "digest_b", "n", "node").join(found, "node", "left")
    name = name.select("digest_a", "digest_b", "n", F.coalesce("component", "node").alias("component_id"))
    return (
        sets.select("doc_id", "n", "digest_a", "digest_b")
        .join(name, ["digest_a", "digest_b", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .unionByName(nameless)
    )
