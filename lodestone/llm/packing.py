"""Lexical retrieval packing: each training window is filled with the BM25 neighbours of the document that opens it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches
from .hashing import mix
from .tokens import forget, kept_bpe

#: Tokens of a sequence, the id that ends a document, and tokens of a shard of the index.
WINDOW, END, SHARD = 2048, 1, 1 << 20
#: Bytes of text that are encoded at once.
PART = 1 << 18
#: BM25's constants; documents of the sample for each bound between shards.
K1, B, SAMPLE = 1.2, 0.75, 64
#: Neighbours that are put in order at first, as most windows are full by then; the others follow if they are not.
FEW = 64

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def weigh(n: int, df: np.ndarray) -> np.ndarray:
    """BM25's idf of terms that so many of n documents hold."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


def postings(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, times) of each pair, by term and document, and the documents' sizes; terms are token ids."""
    sizes = np.array([len(d) for d in docs], np.int64)
    key, tf = np.unique(np.repeat(np.arange(len(docs), dtype=np.int64), sizes) | (np.concatenate(docs).astype(np.int64) << 32), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf, sizes


def impact(idf: np.ndarray, tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    """BM25's score of a term in a document of that size."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(1.0, mean)))


class Index:
    """An inverted BM25 index of one shard's documents.

    idf, by term, and the mean size are the corpus's; without them, these documents are the corpus.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray | None = None, mean: float = 0.0):
        n = len(docs)
        term, self.doc, tf, sizes = postings(docs)
        terms, self.lo, df = np.unique(term, return_index=True, return_counts=True)
        own = weigh(n, df) if idf is None else idf[terms]
        number = np.repeat(np.arange(len(df)), df)
        self.weight = impact(own[number], tf, sizes[self.doc], sizes.mean() if idf is None else mean)
        self.df = df
        # Scores of terms that many documents hold are rows of a table, which has at most 8 times the postings.
        wide = df * 8 > n
        self.row = np.where(wide, np.cumsum(wide) - 1, -1)
        self.table = np.zeros((int(wide.sum()), n), np.float32)
        inside = wide[number]
        self.table[self.row[number[inside]], self.doc[inside]] = self.weight[inside]
        by_doc = np.argsort(self.doc, kind="stable")
        self.held, self.cut = number[by_doc], np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        # Documents that can be found, and how many postings of a term are theirs.
        self.live, self.size = np.arange(n), df

    def narrow(self, free: np.ndarray) -> None:
        """Find only the free documents from now on; scores and the order of the others do not change."""
        keep = free[self.live]
        self.live, self.table = self.live[keep], np.compress(keep, self.table, axis=1)
        inside = keep[self.doc]
        before = np.concatenate([[0], np.cumsum(inside)])
        self.lo, self.size = before[self.lo], before[self.lo + self.size] - before[self.lo]
        self.doc, self.weight = (np.cumsum(keep) - 1)[self.doc[inside]], self.weight[inside]

    def neighbours(self, seed: int, free: np.ndarray | None = None, most: int = 0) -> np.ndarray:
        """Documents that share any term with the seed, best first, ties by position.

        free: the documents that count, all if not given. most: so many of the best, and their ties, are enough; 0 for all.
        """
        own = self.held[self.cut[seed] : self.cut[seed + 1]]
        own = own[self.df[own] >= 2]
        row = self.row[own]
        score = self.table[row[row >= 0]].sum(0, dtype=np.float64)
        thin = own[row < 0]
        size = self.size[thin]
        if len(thin):
            rows = np.repeat(self.lo[thin] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            score += np.bincount(self.doc[rows], self.weight[rows], len(self.live))
        found = np.flatnonzero(score if free is None else (score > 0) & free[self.live])
        if 0 < most < len(found):
            found = found[score[found] >= np.partition(score[found], -most)[-most]]
        return self.live[found[np.argsort(-score[found], kind="stable")]]


def order(docs: list[np.ndarray], window: int, idf: np.ndarray | None = None, mean: float = 0.0) -> list[int]:
    """The documents in packing order: a window's seed, then its unused neighbours until the window is full.

    A document that runs over the window's end is cut there and opens, and seeds, the next one. If no unused document
    shares a term with the seed, the next one in order seeds the rest of the window.
    """
    index, free, out, after = Index(docs, idf, mean), np.ones(len(docs), bool), [], 0
    room, queue, left = 0, iter(()), len(docs)

    def nearest(seed: int) -> Iterator[int]:
        few = index.neighbours(seed, free, min(room, FEW))  # a document has a token at least
        yield from few.tolist()
        if len(few) >= FEW:  # those are used by now
            yield from index.neighbours(seed, free, room).tolist()

    while True:
        doc = next(queue, -1) if room else -1
        seeds = doc < 0
        if seeds:
            while after < len(docs) and not free[after]:
                after += 1
            if after == len(docs):
                return out
            doc = after
            room = room or window
        free[doc] = False
        left -= 1
        if 4 * left < 3 * len(index.live):
            index.narrow(free)
        out.append(int(doc))
        n = len(docs[doc])
        if n >= room:
            room = (room - n) % window  # what is left of the window in which the document ends
            seeds = True
        else:
            room -= n
        if seeds and room:
            queue = nearest(doc)


def cut(sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Lay documents of these sizes end to end and cut: (document, start, length, sequence, offset) of each piece.

    Every sequence is full; what is left at the end makes sequences of falling powers of two, so nothing is padded.
    """
    total = int(sizes.sum())
    bounds = list(range(0, total + 1, window))
    rest = total - bounds[-1]
    for k in range(window.bit_length(), -1, -1):
        if rest >> k & 1:
            bounds.append(bounds[-1] + (1 << k))
    bounds = np.array(bounds, np.int64)
    begins = np.cumsum(sizes) - sizes
    at = np.union1d(begins, bounds[:-1])
    doc, seq = np.searchsorted(begins, at, "right") - 1, np.searchsorted(bounds, at, "right") - 1
    return doc, at - begins[doc], np.diff(np.append(at, total)), seq, at - bounds[seq]


def _planes(docs: list[np.ndarray]) -> list[bytes]:
    """Each document's ids by byte planes, which compress better."""
    flat, ends = np.concatenate(docs).astype("<u4"), np.cumsum([len(d) for d in docs]).tolist()
    low = [(flat >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(4)]
    return [b"".join([x[a:b] for x in low]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _ids(column: pa.Array) -> list[np.ndarray]:
    rows = column.to_pylist()
    sizes = [len(x) // 4 for x in rows]
    flat = np.zeros(sum(sizes), np.uint32)
    for k in range(4):
        plane = np.frombuffer(b"".join([x[k * n : (k + 1) * n] for x, n in zip(rows, sizes, strict=True)]), np.uint8)
        if plane.any():
            flat |= plane.astype(np.uint32) << np.uint32(8 * k)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def signatures(docs: list[np.ndarray], keys: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """Numbers by which related documents lie next to each other.

    From the top: the weightiest term that another document holds, the second, bits of the third, bits of the key's hash.
    """
    term, doc, tf, sizes = postings(docs)
    by = np.argsort(doc.astype(np.min_scalar_type(len(docs))), kind="stable")
    term, doc = term[by], doc[by]
    weight = impact(idf[term], tf[by], sizes[doc], mean)
    first = np.searchsorted(doc, np.arange(len(docs)))
    top = np.zeros((3, len(docs)), np.int64)
    for k in range(3):
        most = np.maximum.reduceat(weight, first)
        at = np.flatnonzero(weight == most[doc])
        at = at[np.diff(doc[at], prepend=-1) > 0]  # of equal weights, the smallest term
        at = at[weight[at] >= 0]
        top[k, doc[at]] = term[at]
        weight[at] = -1
    third = (mix(top[2].astype(np.uint64)) >> np.uint64(54)).astype(np.int64)
    low = (mix(keys.astype(np.uint64)) >> np.uint64(51)).astype(np.int64)
    return (top[0] & 0xFFFFF) << 43 | (top[1] & 0xFFFFF) << 23 | third << 13 | low


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end: int = END, shard: int = SHARD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack whole documents into sequences of at most window tokens.

    Returns a row per piece: doc_id, start (its document's ids before it), length, ids (binary, little-endian unsigned
    32 bits), doc_tokens (with the end id), sequence_id, offset (in the sequence). Document count, document frequencies
    and mean length are those of all documents. Documents are dealt out by content: in the order of their weightiest
    terms (signatures) they make shards of about `shard` tokens, whatever file or partition they come from, and a
    seed's neighbours are sought by all its terms among its shard's documents. Bounds between shards come from a sample that a hash of
    each row chooses, so the result does not depend on the partitioning. Sequences are full but for the powers of two at a shard's end.
    tokenizer: path of a tokenizers file, the same on all executors. window: a power of two.
    A null or empty text is the end id alone; repeated rows are packed as often as they come; a null key stays null.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = kept_bpe(tokenizer), np.array([end], np.uint32)
        df, n, tokens = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for lo, hi in slices(batch.column(1), PART):
                own = [np.concatenate([ids, last]) for ids in bpe.encode([t or "" for t in batch.column(1)[lo:hi].to_pylist()])]
                term, _, _, sizes = postings(own)
                more = np.bincount(term, minlength=len(df))
                more[: len(df)] += df
                df, n, tokens = more, n + len(sizes), tokens + int(sizes.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), pa.array(_planes(own), pa.binary()), pa.nulls(hi - lo, pa.binary())], ["doc_id", "ids", "counts"])
        # What the task has counted is a row of its own, so documents are not read again for it.
        told = np.append(df, [n, tokens]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([told], pa.binary())], ["doc_id", "ids", "counts"])

    written = materialize(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(encode), "doc_id bigint, ids binary, counts binary"), "ids")
    coded = written.where("ids is not null").select("doc_id", "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for told in batch.column(0).to_pylist():
                df = np.frombuffer(told, "<i8")
                term = np.flatnonzero(df[:-2])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], df[-2:]))], ["term", "df"])

    counts = written.where("counts is not null").select("counts")
    total = {r.term: r.df for r in counts.mapInArrow(lean(count), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    n, tokens = total.pop(-1, 0), total.pop(-2, 0)
    df = np.zeros(max(total, default=0) + 1, np.int64)
    df[list(total)] = list(total.values())
    idf, mean, shards = weigh(n, df), tokens / max(1, n), max(1, -(-tokens // shard))
    bridge = np.where(df < 2, 0, idf)  # a term of one document brings it to no other
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((idf, bridge, mean))

    def deal(batches: Iterator[pa.RecordBatch], bounds=None) -> Iterator[pa.RecordBatch]:
        forget()
        _, weights, size = sent.value
        cuts = np.empty(0, np.int64) if bounds is None else bounds.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                keys, ids = batch.column(0)[lo:hi], batch.column(1)[lo:hi]
                own = _ids(ids)
                sign = signatures(own, keys.fill_null(0).to_numpy(zero_copy_only=False), weights, size)
                yield pa.RecordBatch.from_arrays([keys, ids, pa.array(sign), pa.array(np.searchsorted(cuts, sign, "right").astype(np.int64))], ["doc_id", "ids", "sign", "shard"])

    dealt, cuts = "doc_id bigint, ids binary, sign bigint, shard bigint", np.empty(0, np.int64)
    if shards > 1:
        sample = coded.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(max(1, n // (SAMPLE * shards)))) == 0)
        drawn = sample.mapInArrow(lean(deal), dealt).select("sign", (F.octet_length("ids") / 4).cast("bigint").alias("n")).toArrow()
        sign, size = (drawn.column(c).to_numpy() for c in ("sign", "n"))
        by = np.argsort(sign, kind="stable")
        run_up = np.cumsum(size[by])
        if len(by):
            cuts = sign[by][np.searchsorted(run_up, np.arange(1, shards) * (run_up[-1] / shards))]
    bounds = spark.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from deal(batches, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        weights, _, size = sent.value
        keys, held, n, sequence, at_shard = [], [], 0, 0, -1

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            way = order(held, window, weights, size)
            sizes = np.array([len(held[d]) for d in way], np.int64)
            doc, start, length, seq, offset = cut(sizes, window)
            flat = np.concatenate([held[d] for d in way]).astype("<u4")
            at = np.cumsum(length) - length
            data = flat.tobytes()
            whole = np.array(way)[doc]
            columns = [
                pa.array([keys[d] for d in whole], pa.int64()),
                pa.array(start),
                pa.array(length),
                pa.array([data[4 * a : 4 * (a + m)] for a, m in zip(at.tolist(), length.tolist(), strict=True)], pa.binary()),
                pa.array(sizes[doc]),
                pa.array(seq + sequence + (at_shard << 32)),
                pa.array(offset),
            ]
            sequence += int(seq[-1]) + 1
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for k, ids, where in zip(batch.column(0).to_pylist(), _ids(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                # A shard can outgrow its share by rows that are alike in key and text.
                if held and (where != at_shard or n >= 2 * shard):
                    yield flush()
                    n = 0
                if where != at_shard:
                    at_shard, sequence = where, 0
                keys.append(k)
                held.append(ids)
                n += len(ids)
        if held:
            yield flush()

    placed = coded.mapInArrow(lean(place), dealt)
    return placed.repartition(shards, "shard").sortWithinPartitions("shard", "sign", "doc_id", F.xxhash64("ids")).select("doc_id", "ids", "shard").mapInArrow(lean(run), SCHEMA)


def slices(column: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many bytes of text, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chars, "right")))
        yield lo, hi
        lo = hi
