"""Suffix-array dedup: bytes of long strings that an earlier document holds too are removed.

Every window of SPAN bytes holds one anchor, the least of the hashes of its ANCHOR-byte strings, so equal windows hold equal
anchors. Anchors are dealt to buckets to find those of more than one document; the stretches around these are dealt,
by anchor, to shards. The texts of a slice of documents lie meanwhile in a file of the shared folder, and only its name is
passed on. A shard sorts its stretches' suffixes by induced sorting and takes permuted common prefixes; runs
of suffixes that share SPAN bytes tell the first document of each window. Slices of documents then cut what is covered.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, lean, small_batches
from .hashing import SpanHasher, mix
from .jaccard_join import DEALT, _batch, bucket_of, gaps, pack, unpack
from .packing import slices
from .suffix_array import common_prefixes, suffix_array
from .warc import open_store

#: Bytes of a repeated string; bytes of an anchor; bytes of text of a slice, and of the stretches of one suffix array.
SPAN, ANCHOR, SLICE, ARRAY = 50, 24, 8 << 20, 1 << 20
#: Bytes of text whose anchors are found at once.
PART = 1 << 19
#: An anchor that more documents than this seem to hold is hot: its windows are dealt by their own bytes, one by one.
HOT = 512
_GRADES = np.array([1, 2, 8, 64])

SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by one more, and where they begin."""
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.cumsum([0] + [len(t) + 1 for t in texts])


def anchors(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor's hash) of each run of windows with one anchor, in order; windows by their starts.

    PART windows are taken at once, so that the arrays stay small, however long a text is; a run may be cut there.
    """
    found = []
    for at in range(0, max(1, len(data) - SPAN + 1), PART):
        first, last, key = _anchors(data[at : at + PART + SPAN - 1], begin[1:] - 1 - at)
        found.append((first + at, last + at, key))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one part; ends: places of the bytes between texts."""
    n = len(data) - SPAN + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64)
    ends = ends[(ends >= 0) & (ends < len(data))]
    raw = data.tobytes()
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)).copy()
    h = mix(eight[:-16] * np.uint64(0x9E3779B97F4A7C15) + mix(eight[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(eight[16:])))
    # The upper bits of the hash, then the place; the leftmost of equal ones wins.
    low = (h >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64)
    width, done = SPAN - ANCHOR + 1, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    place = (low[:n] & np.uint64((1 << 28) - 1)).astype(np.int64)
    cut = np.zeros(n + 1, np.int32)
    np.add.at(cut, np.clip(ends - SPAN + 1, 0, n), 1)
    np.add.at(cut, np.clip(ends + 1, 0, n), -1)
    inside = np.cumsum(cut[:n]) == 0
    fresh = np.ones(n, bool)
    fresh[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(inside & fresh)
    over = np.ones(n, bool)
    over[:-1] = fresh[1:] | ~inside[1:]
    last = np.flatnonzero(inside & over)
    # The least hashes are small; mixed once more they spread evenly over buckets.
    return first, last, mix(h[place[first]] ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(2) << np.uint64(2)


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for lo, hi in slices(batch.column(1), SLICE):
        yield batch.column(0)[lo:hi].to_numpy(), [x or b"" for x in batch.column(1)[lo:hi].cast(pa.binary()).to_pylist()]


def _press(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdCompressor(level=1).compress(data), np.uint8)


def _unpress(data: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data.tobytes())


def _save(path: str, *arrays: np.ndarray) -> np.ndarray:
    """Write arrays to a new file of the folder; its name, as bytes. An attempt that is repeated writes a file of its own."""
    store, folder = open_store(path)
    store.create_dir(folder, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{folder}/{name}") as f:
        f.write(pack(*arrays))
    return np.frombuffer(name.encode(), np.uint8)


def _load(path: str, name: np.ndarray) -> list[np.ndarray]:
    store, folder = open_store(path)
    with store.open_input_stream(f"{folder}/{name.tobytes().decode()}") as f:
        return unpack(f.read())


def _deal(docs: DataFrame, buckets: int, path: str) -> DataFrame:
    """Each slice's distinct anchors, with a grade of how many of its documents hold them, by bucket; and where its texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for ids, texts in _cut(batch):
                data, begin = join_texts(texts)
                first, _, key = anchors(data, begin)
                doc = np.searchsorted(begin, first, "right") - 1
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                other = new.copy()
                other[1:] |= doc[1:] != doc[:-1]
                at = np.flatnonzero(new)
                held = np.add.reduceat(other.astype(np.int64), at) if len(at) else at
                each = key[at] | (np.searchsorted(_GRADES, held, "right") - 1).astype(np.uint64)
                rows = [(-1 - number, pack(_save(path, ids, begin, _press(data.tobytes()))))]
                to, of = np.unique(bucket_of(each, buckets), return_index=True)
                rows += [(k, pack(gaps(each[a:b]))) for k, a, b in zip(to.tolist(), of.tolist(), [*of[1:].tolist(), len(each)], strict=False)]
                yield _batch(DEALT, key=[r[0] for r in rows], slice=[number] * len(rows), data=[r[1] for r in rows])
                number += 1

    return docs.mapInArrow(lean(run), DEALT)


def _shared(dealt: pa.Table) -> pa.Table:
    """A bucket: tells each slice of its anchors that more than one document holds; the lowest bit is set for hot ones."""
    bucket = dealt["key"][0].as_py()
    if bucket < 0:
        return dealt
    number, parts = dealt["slice"].to_numpy(), [np.cumsum(unpack(x)[0]) for x in dealt["data"].to_pylist()]
    keys = np.concatenate(parts)
    each, place = np.unique(keys >> np.uint64(2), return_inverse=True)
    held = np.bincount(place, _GRADES[(keys & np.uint64(3)).astype(np.int64)], len(each))
    told = (each << np.uint64(2)) | (held > HOT).astype(np.uint64)
    live, at, rows = (held > 1)[place], np.cumsum([0] + [len(p) for p in parts]), []
    for k in range(len(parts)):
        own = slice(at[k], at[k + 1])
        if live[own].any():
            rows.append((int(number[k]), pack(gaps(told[place[own][live[own]]]))))
    return pa.Table.from_batches([_batch(DEALT, key=[bucket] * len(rows), slice=[r[0] for r in rows], data=[r[1] for r in rows])])


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _stretches(shards: int, path: str):
    """A slice: its distinct stretches around shared anchors, by shard, and where it holds them."""

    def run(rows: pa.Table) -> pa.Table:
        data, bucket = rows["data"].to_pylist(), rows["key"].to_numpy()
        home, *told = np.argsort(bucket, kind="stable").tolist()
        number = rows["slice"][0].as_py()
        (name,) = unpack(data[home])
        ids, begin, pressed = _load(path, name)
        text = np.frombuffer(_unpress(pressed), np.uint8)
        told = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(unpack(data[k])[0]) for k in told)])
        first, last, key = anchors(text, begin)
        at = np.minimum(np.searchsorted(told >> np.uint64(2), key >> np.uint64(2)), max(0, len(told) - 1))
        live = (told[at] >> np.uint64(2) == key >> np.uint64(2)) if len(told) else np.zeros(len(key), bool)
        first, last, key, hot = first[live], last[live], key[live], (told[at[live]] & np.uint64(1)).astype(bool) if len(told) else live[live]
        # A hot anchor's windows go one by one.
        count = np.where(hot, last - first + 1, 1)
        start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        end = np.where(np.repeat(hot, count), start + SPAN, np.repeat(last, count) + SPAN)
        key, hot = np.repeat(key, count), np.repeat(hot, count)
        hasher, content = SpanHasher(), np.empty(len(start), np.uint64)
        for at in range(0, len(text), PART):  # starts are sorted
            a, b = np.searchsorted(start, (at, at + PART))
            content[a:b] = hasher.spans(hasher.sums(text[at : at + PART + 2 * SPAN]), start[a:b] - at, end[a:b] - at)
        each, index, place = np.unique(content, return_index=True, return_inverse=True)
        doc = ids[np.searchsorted(begin, start, "right") - 1]
        order = np.argsort(place, kind="stable")
        cut = np.searchsorted(place[order], np.arange(len(each)))
        low, high = (np.minimum.reduceat(doc[order], cut), np.maximum.reduceat(doc[order], cut)) if len(each) else (doc, doc)
        size = (end - start)[index].astype(np.uint8)
        route = np.where(hot[index], each, mix(key[index]))
        shard, route = (route % np.uint64(shards)).astype(np.int64), (route >> np.uint64(32)).astype(np.uint32)
        out = [(-1 - number, pack(name, gaps(start.astype(np.uint32)), place.astype(np.uint32)))]
        by = np.argsort(shard, kind="stable")
        to, of = np.unique(shard[by], return_index=True)
        for k, a, b in zip(to.tolist(), of.tolist(), [*of[1:].tolist(), len(by)], strict=False):
            own = by[a:b]
            if len(own):
                out.append((k, pack(own.astype(np.uint32), low[own], high[own], size[own], route[own], _press(_take(text, start[index[own]], size[own].astype(np.int64)).tobytes()))))
        return pa.Table.from_batches([_batch(DEALT, key=[r[0] for r in out], slice=[number] * len(out), data=[r[1] for r in out])])

    return run


def first_holders(text: np.ndarray, size: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch starts in the answer, least document of each window): for each stretch's windows, who holds them first.

    text: the stretches' bytes; size, low: each stretch's bytes and least document.
    """
    gapped = np.zeros(len(text) + len(size), np.int64)  # a 0 after each stretch
    ends = np.cumsum(size + 1)
    real = np.ones(len(gapped), bool)
    real[ends - 1] = False
    gapped[real] = text.astype(np.int64) + 1
    order = suffix_array(gapped, 257)
    same = common_prefixes(gapped, order, 0)[order] >= SPAN
    group = np.cumsum(~same) - 1
    stretch = np.repeat(np.arange(len(size)), size + 1)
    least = np.minimum.reduceat(low[stretch[order]], np.flatnonzero(~same))
    holder = np.empty(len(gapped), np.int64)
    holder[order] = least[group]
    windows = size - SPAN + 1
    return np.cumsum(windows) - windows, holder[np.repeat(ends - size - 1 - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())]


def _match(dealt: pa.Table) -> pa.Table:
    """A shard: for each slice's stretches, the runs of windows that an earlier document than some holder has."""
    if dealt["key"][0].as_py() < 0:
        return dealt
    number, parts = dealt["slice"].to_numpy(), [unpack(x) for x in dealt["data"].to_pylist()]
    index, low, high, size, route = (np.concatenate([p[k] for p in parts]) for k in range(5))
    part = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    size = size.astype(np.int64)
    text = np.frombuffer(b"".join(_unpress(p[5]) for p in parts), np.uint8)
    hasher = SpanHasher()
    start = np.cumsum(size) - size
    each, one, place = np.unique(hasher.spans(hasher.sums(text), start, start + size), return_index=True, return_inverse=True)
    order = np.argsort(place, kind="stable")
    least = np.minimum.reduceat(low[order], np.searchsorted(place[order], np.arange(len(each))))
    # An anchor with a single stretch, however many slices hold it, has nothing to be sorted with.
    _, at, count = np.unique(route[one], return_inverse=True, return_counts=True)
    alone = count[at] == 1
    own = np.flatnonzero(alone[place] & (least[place] < high))
    answers = [(own, np.zeros(len(own), np.uint8), (size[own] - SPAN + 1).astype(np.uint8), least[place[own]])]
    ways = max(1, -(-int(size[one[~alone]].sum()) // ARRAY))
    way = np.where(alone, -1, (mix(route[one].astype(np.uint64)) % np.uint64(ways)).astype(np.int64))
    for k in range(ways):
        kinds = np.flatnonzero(way == k)
        if not len(kinds):
            continue
        at, holder = first_holders(_take(text, start[one[kinds]], size[one[kinds]]), size[one[kinds]], least[kinds])
        # Every slice's own copy of a stretch gets its runs.
        own = np.flatnonzero(way[place] == k)
        at = at[np.searchsorted(kinds, place[own])]
        windows = size[own] - SPAN + 1
        mine = holder[np.repeat(at - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())]
        whose, offset = np.repeat(np.arange(len(own)), windows), np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        use = mine < high[own][whose]
        fresh = use.copy()
        fresh[1:] &= (mine[1:] != mine[:-1]) | (whose[1:] != whose[:-1]) | ~use[:-1]
        over = use.copy()
        over[:-1] &= (mine[1:] != mine[:-1]) | (whose[1:] != whose[:-1]) | ~use[1:]
        a, b = np.flatnonzero(fresh), np.flatnonzero(over)
        answers.append((own[whose[a]], offset[a].astype(np.uint8), (b - a + 1).astype(np.uint8), mine[a]))
    which, offset, run, holder = (np.concatenate(x) for x in zip(*answers, strict=True))
    order = np.argsort(which, kind="stable")
    which, offset, run, holder = which[order], offset[order], run[order], holder[order]
    cut, rows = np.searchsorted(part[which], np.arange(len(parts) + 1)), []
    for k in range(len(parts)):
        x = slice(cut[k], cut[k + 1])
        if cut[k] < cut[k + 1]:
            rows.append((int(number[k]), pack(index[which[x]], offset[x], run[x], holder[x])))
    shard = dealt["key"][0].as_py()
    return pa.Table.from_batches([_batch(DEALT, key=[shard] * len(rows), slice=[r[0] for r in rows], data=[r[1] for r in rows])])


def _remove(path: str, rows: pa.Table) -> pa.Table:
    """A slice: its documents without the bytes of covered windows."""
    data, bucket = rows["data"].to_pylist(), rows["key"].to_numpy()
    home, *told = np.argsort(bucket, kind="stable").tolist()
    name, start, place = unpack(data[home])
    ids, begin, pressed = _load(path, name)
    raw = _unpress(pressed)
    text = np.frombuffer(raw, np.uint8)
    gone = np.zeros(len(text), bool)
    if told:
        start = np.cumsum(start).astype(np.int64)
        which, offset, run, holder = (np.concatenate(x) for x in zip(*(unpack(data[k]) for k in told), strict=True))
        order = np.argsort(which, kind="stable")
        which, offset, run, holder = which[order], offset[order].astype(np.int64), run[order].astype(np.int64), holder[order]
        lo, hi = np.searchsorted(which, place), np.searchsorted(which, place, "right")
        n = hi - lo
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(start, n)
        live = holder[row] < np.repeat(ids[np.searchsorted(begin, start, "right") - 1], n)
        row, at = row[live], at[live]
        depth = np.zeros(len(text) + 1, np.int32)
        np.add.at(depth, at + offset[row], 1)
        np.add.at(depth, at + offset[row] + run[row] - 1 + SPAN, -1)
        gone = np.cumsum(depth[:-1]) > 0
    opens = gone & ~np.concatenate([[False], gone[:-1]])
    removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(opens)])
    a, b = begin[:-1], begin[1:] - 1
    kept = [raw[x:y] if removed[x] == removed[y] else text[x:y][~gone[x:y]].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return pa.Table.from_batches([_batch(SCHEMA, doc_id=ids, n_bytes=b - a, n_removed=removed[b] - removed[a], n_spans=spans[b] - spans[a], kept=kept)])


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes): one row per document.

    Texts are UTF-8 bytes (null: none). Removed is each byte covered by a SPAN-byte string that also starts in a document
    with a smaller doc_id; strings are judged on the input and do not cross documents. Shorter and empty texts stay.
    Of rows with the same doc_id none is smaller than the other, so they keep what only they share.
    A null doc_id is smaller and larger than none: its row stays whole and takes nothing from others.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kept = F.coalesce("text", F.lit("")).cast("binary")
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", F.octet_length(kept).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), kept.alias("kept"))
    docs = docs.where(F.col("doc_id").isNotNull())
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shards = max(1, bytes_ // (20 * (1 << 20))), max(1, bytes_ // (6 << 20))
    parts = lambda n: int(max(n // 2, 12))
    path = fresh_path(docs.sparkSession, "slices")
    dealt = _deal(docs, buckets, path).repartition(parts(shards), "key")
    told = dealt.groupBy("key").applyInArrow(lean(_shared), DEALT).repartition(parts(shards), "slice")
    stretches = told.groupBy("slice").applyInArrow(lean(_stretches(shards, path)), DEALT).repartition(parts(shards), "key")
    matched = stretches.groupBy("key").applyInArrow(lean(_match), DEALT).repartition(parts(shards), "slice")
    return matched.groupBy("slice").applyInArrow(lean(lambda rows: _remove(path, rows)), SCHEMA).unionByName(nameless)
