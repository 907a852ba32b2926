"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose parameters were changed keeps its template.
Windows of template tokens are hash-joined with the benchmark's, matches are lined up, and the slots must agree:
one value of the item always stands for one value of the document, and the other way round. A window of placeholders
alone says nothing of its template, so it is joined by its values; next to a found window placeholders count as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, lean, materialize, small_batches
from .folding import Folded, fold
from .hashing import Sequence, SpanHasher, common, mix
from .packing import slices

#: Template tokens of a window, the share of an item's template tokens that must be found, the tokens found verbatim that
#: are enough of any item, and the fewest tokens of an item that may be reparameterised.
WINDOW, SHARE, LONG, LEAST = 8, 0.5, 32, 4
#: Windows of the benchmark that are sent to executors at once; a larger benchmark goes in blocks.
BLOCK_WINDOWS = 1 << 20
#: Neighbouring runs of which the fullest chain is kept.
SPAN = 128

SCHEMA = "doc_id bigint, item_id bigint, kind string, n_tokens bigint, n_item_tokens bigint, n_slots bigint, start bigint, end bigint"

# Units of measure that may follow a number.
UNITS = """
mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds gram grams ton tons
ml cl dl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours
day days week weeks month months year years k c f degrees percent mph kmh hz khz mhz ghz v w kw a j kj n pa bar usd eur
dollar dollars euro euros cent cents meter meters metre metres
"""

_BLANK, _LETTER, _DIGIT = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = _LETTER
_CLASS[range(48, 58)] = _DIGIT
_STOP = np.zeros(256, np.int32)
_STOP[list(b".!?:;\n\"")] = 1
_NUMBER, _NAME, _UNIT = (np.uint64(int(x)) for x in (0x6E756D, 0x6E616D, 0x756E69))


@dataclass
class Templates:
    """Template tokens of many texts: text number, token hash, whether a slot, the slot's value, byte range in its text."""

    text: np.ndarray
    token: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Canon:
    """Texts to template tokens."""

    def __init__(self) -> None:
        self.hasher = SpanHasher()
        raw = np.frombuffer(" ".join(UNITS.split()).encode(), np.uint8)
        ends = np.append(np.flatnonzero(raw == 32), len(raw))
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.units = np.sort(self.hasher.spans(self.hasher.sums(raw), starts, ends))

    def __call__(self, folded: Folded, names: bool = True) -> Templates:
        """names: whether names are placeholders; else they are words, as in texts whose case was changed."""
        data, begin, back = folded.data, folded.begin, folded.back
        kind = _CLASS[data]
        point = np.flatnonzero((data == 44) | (data == 46))
        point = point[(point > 0) & (point < len(data) - 1)]
        kind[point[(kind[point - 1] == _DIGIT) & (kind[point + 1] == _DIGIT)]] = _DIGIT
        before = np.concatenate([[_BLANK], kind[:-1]])
        start = np.flatnonzero((kind != before) & (kind != _BLANK))
        stop = np.flatnonzero((kind != before) & (before != _BLANK))
        if len(start) == 0:
            none = np.empty(0, np.int64)
            return Templates(none, none.astype(np.uint64), none.astype(bool), none.astype(np.uint64), none, none)
        text = np.searchsorted(begin, start, "right") - 1
        sums = self.hasher.sums(data)
        token = self.hasher.spans(sums, start, stop)
        value = token.copy()
        number = kind[start] == _DIGIT
        prior = np.concatenate([[False], number[:-1]])
        unit = prior & ~number & np.isin(token, self.units)
        big = folded.upper[start]
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        # A sentence's first word is a word like any other.
        name = big & ~number & ~unit & (stop - start > 1) & names
        name[0] = False
        name[1:] &= (text[1:] == text[:-1]) & (stops[start[1:]] == stops[stop[:-1]])
        # Neighbouring names are one name.
        more = name & np.concatenate([[False], name[:-1]])
        opens = np.flatnonzero(name & ~more)
        if len(opens):
            closes = np.flatnonzero(name & ~np.concatenate([more[1:], [False]]))
            value[opens] = self.hasher.spans(sums, start[opens], stop[closes])
            stop = stop.copy()
            stop[opens] = stop[closes]
        token[number], token[name], token[unit] = _NUMBER, _NAME, _UNIT
        keep = ~more
        return Templates(text[keep], token[keep], (number | name | unit)[keep], value[keep], back[start[keep]], back[stop[keep]])


def windows(t: Templates, size: int) -> np.ndarray:
    """The hash of the window of so many tokens that starts at each token; 0 where it would leave the text.

    A window without a word is hashed by its slots' values.
    """
    n = len(t.token) - size + 1
    out = np.zeros(len(t.token), np.uint64)
    if n <= 0:
        return out
    h, v = np.zeros(n, np.uint64), np.ones(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + t.token[k : k + n]
        v = v * np.uint64(0xC2B2AE3D27D4EB4F) + t.value[k : k + n]
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    h = np.where(slots[size:] - slots[:n] == size, v, h)
    whole = t.text[:n] == t.text[size - 1 :]
    out[:n][whole] = mix(h + np.uint64(size))[whole] | np.uint64(1)
    return out


def before(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The hash of the window one token before each; 0 at the start of a text."""
    out = np.zeros(len(h), np.uint64)
    out[1:] = np.where(text[1:] == text[:-1], h[:-1], 0)
    return out


@dataclass
class Table:
    """Windows of one size, by their hash and that of the window before.

    each: their distinct hashes; lefts: those of the windows before; key: number of the hash * len(lefts) + number of the one before, in order.
    """

    size: int
    each: np.ndarray
    lefts: np.ndarray
    key: np.ndarray
    item: np.ndarray
    place: np.ndarray


@dataclass
class Bench:
    """A block of the benchmark, ready to be joined: tables by window size, and each item's templates."""

    tables: list[Table]
    ids: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    token: np.ndarray
    slot: np.ndarray
    value: np.ndarray


def bench(items: list[tuple[int, str]], window: int, names: bool) -> Bench:
    """Items shorter than a window are one window of their own size."""
    t = Canon()(fold([x.encode() for _, x in items]), names)
    sizes = np.bincount(t.text, minlength=len(items))
    first = np.cumsum(sizes) - sizes
    tables = []
    for size in sorted({int(min(window, n)) for n in sizes if n}):
        h = windows(t, size)
        left = before(h, t.text)
        at = np.flatnonzero((h != 0) & (np.minimum(sizes, window)[t.text] == size))
        each, number = np.unique(h[at], return_inverse=True)
        lefts, other = np.unique(left[at], return_inverse=True)
        key = number * len(lefts) + other
        order = np.argsort(key, kind="stable")
        at = at[order]
        tables.append(Table(size, each, lefts, key[order], t.text[at], at - first[t.text[at]]))
    return Bench(tables, np.array([i for i, _ in items], np.int64), first, sizes, t.token, t.slot, t.value)


def seeds(t: Templates, b: Bench) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window's place in the texts, item, window's place in the item) of equal windows before which there are no equal ones.

    So a stretch that repeats itself in the item and in the text gives as many seeds as the two have windows together, not
    as many as they have pairs.
    """
    found = []
    for table in b.tables:
        h = windows(t, table.size)
        seen = np.zeros(1 << 20, bool)
        seen[(table.each >> np.uint64(44)).astype(np.int64)] = True
        at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)] & (h != 0))
        number = np.minimum(np.searchsorted(table.each, h[at]), len(table.each) - 1)
        live = table.each[number] == h[at]
        at, number = at[live], number[live]
        left = before(h, t.text)[at]
        other = np.minimum(np.searchsorted(table.lefts, left), len(table.lefts) - 1)
        same = (table.lefts[other] == left) & (left != 0)
        n = len(table.lefts)
        lo, hi = np.searchsorted(table.key, number * n), np.searchsorted(table.key, (number + 1) * n)
        mid = np.where(same, np.searchsorted(table.key, number * n + other), hi)
        after = np.where(same, np.searchsorted(table.key, number * n + other + 1), hi)
        for a, z in ((lo, mid), (after, hi)):
            m = z - a
            rows = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())
            found.append((np.repeat(at, m), table.item[rows], table.place[rows]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Chain:
    """Stretches of an item found one after the other in a text, and what their slots stand for."""

    n: int
    words: int  # tokens that are no slots, or slots of equal value
    slots: int
    same: bool
    to: dict[int, int]
    back: dict[int, int]
    start: int
    end: int  # in the text, as start
    place: int  # end in the item

    def then(self, at: int, end: int, line: int, t: Templates, b: Bench, first: int) -> Chain | None:
        """This chain and what a run adds to it, if its slots agree."""
        lo = max(at, self.end, self.place + line)
        theirs, mine = slice(first + lo - line, first + end - line), slice(lo, end)
        slot = b.slot[theirs]
        s, to, back, equal = int(np.count_nonzero(slot)), self.to, self.back, 0
        if s:  # maps are shared with the chain before where nothing is added to them
            to, back = dict(to), dict(back)
            for p, q in zip(b.value[theirs][slot].tolist(), t.value[mine][slot].tolist(), strict=True):
                if to.setdefault(p, q) != q or back.setdefault(q, p) != p:
                    return None
                equal += p == q
        return Chain(self.n + end - lo, self.words + end - lo - s + equal, self.slots + s, self.same and equal == s, to, back, self.start if self.n else lo, end, end - line)


class Runs:
    """Runs of an item in a text, in order of the text, and how much the fullest chain that ends with each holds.

    They lie in spans of SPAN runs twice, by their place in the text and in the item; of each span the fullest chain is known.
    """

    def __init__(self, at: np.ndarray, end: np.ndarray, line: np.ndarray, size: int):
        self.at, self.end, self.line, self.size = at, end, line, size
        self.full, spans = np.zeros(len(at), np.int64), len(at) // SPAN + 1
        self.by_place = np.argsort(end - line, kind="stable")
        self.places = (end - line)[self.by_place]
        self.span_of = np.empty(len(at), np.int64)
        self.span_of[self.by_place] = np.arange(len(at)) // SPAN
        self.in_text, self.in_item = np.zeros(spans, np.int64), np.zeros(spans, np.int64)

    def set(self, j: int, full: int) -> None:
        self.full[j] = full
        for top, span in ((self.in_text, j // SPAN), (self.in_item, self.span_of[j])):
            top[span] = max(top[span], full)

    def _totals(self, j: int, k: np.ndarray) -> np.ndarray:
        """What chains that end with the runs k hold together with run j; 0 where it cannot follow."""
        end, line, full = self.end[k], self.line[k], self.full[k]
        gain = self.end[j] - np.maximum(np.maximum(self.at[j], end), end - line + self.line[j])
        return np.where((gain > 0) & (full > 0) & (np.abs(line - self.line[j]) <= self.size), full + gain, 0)

    def before(self, j: int) -> Iterator[int]:
        """Runs whose chains are fuller with run j than it is alone, the fullest first, of equal ones the first in the text.

        A chain gains no more than the run's length, so spans whose fullest chain cannot reach the best total are not looked at. Of
        the two ways to cut runs into spans that is taken which leaves fewer of them.
        """
        low, n = int(np.searchsorted(self.at, self.at[j] - 3 * self.size)), int(self.end[j] - self.at[j])
        if low >= j:
            return
        text = self.in_text[: (j - 1) // SPAN + 1] + n
        text[: low // SPAN] = 0
        item = self.in_item[: int(np.searchsorted(self.places, self.end[j] - self.line[j])) // SPAN + 1] + n

        def look(bound: np.ndarray, by_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
            span = len(bound) - 1 - int(np.argmax(bound[::-1]))
            bound[span] = 0
            k = np.arange(span * SPAN, min(j, (span + 1) * SPAN)) if by_text else self.by_place[span * SPAN : (span + 1) * SPAN]
            k = k[(k >= low) & (k < j)]
            return k, self._totals(j, k)

        best = max(n + 1, int(look(item.copy())[1].max(initial=0)))
        bound = min(text, item, key=lambda x: int(np.count_nonzero(x >= best)))
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            if bound.max() >= best:
                seen.append(look(bound, bound is text))
                best = max(best, int(seen[-1][1].max(initial=0)))
                continue
            total = max((int(t.max(initial=0)) for _, t in seen), default=0)
            if total < best and best > n + 1:  # the best ones did not agree: others may now be in reach
                best = max(total, n + 1)
                continue
            if total <= n:
                return
            first, where = min((int(k[t == total].min()), i) for i, (k, t) in enumerate(seen) if (t == total).any())
            k, t = seen[where]
            t[k == first] = 0
            yield first


def chains(at: np.ndarray, end: np.ndarray, line: np.ndarray, t: Templates, b: Bench, item: int) -> Iterator[Chain]:
    """For each run, in order of the text, the fullest agreeing chain that ends with it.

    Two runs follow one another if they do so in the text and in the item, at lines not further apart than the item is long.
    """
    size, first, out = int(b.sizes[item]), int(b.first[item]), []
    runs = Runs(at, end, line, size)
    none = Chain(0, 0, 0, True, {}, {}, 0, 0, 0)
    for j, (x, y, z) in enumerate(zip(at.tolist(), end.tolist(), line.tolist(), strict=True)):
        own = none.then(x, y, z, t, b, first)
        out.append(own)
        if own is None:
            continue
        for k in runs.before(j) if size >= LEAST else ():
            longer = out[k].then(x, y, z, t, b, first)
            if longer:
                out[j] = longer
                break
        runs.set(j, out[j].n)
        yield out[j]


def matches(t: Templates, b: Bench, share: float, long: int = LONG) -> list[tuple]:
    """(text number, item number, verbatim, tokens, slots, start, end): each text's best agreeing match with an item."""
    at, item, place = seeds(t, b)
    if not len(at):
        return []
    # A seed's run goes as far as the templates agree.
    text, first = t.text[at], b.first[item]
    sizes = np.bincount(t.text)
    starts = np.cumsum(sizes) - sizes
    ours, theirs = Sequence(t.token), Sequence(b.token)
    left = common(ours, at, theirs, first + place, np.minimum(at - starts[text], place), back=True)
    right = common(ours, at, theirs, first + place, np.minimum(starts[text] + sizes[text] - at, b.sizes[item] - place))
    line, at, end = at - place, at - left, at + right
    order = np.lexsort((at, line, item, text))
    text, item, line, at, end = text[order], item[order], line[order], at[order], end[order]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (line[1:] != line[:-1]) | (at[1:] != at[:-1])
    text, item, line, at, end = text[new], item[new], line[new], at[new], end[new]
    order = np.lexsort((at, item, text))
    text, item, line, at, end = text[order], item[order], line[order], at[order], end[order]
    cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
    most = np.add.reduceat(end - at, cut)
    enough = most >= np.minimum(share * b.sizes[item[cut]], long)
    best: dict[tuple[int, int], tuple] = {}
    for lo, hi in zip(cut[enough].tolist(), np.append(cut[1:], len(at))[enough].tolist(), strict=True):
        key = (int(text[lo]), int(item[lo]))
        whole = int(b.sizes[key[1]])
        for c in chains(at[lo:hi], end[lo:hi], line[lo:hi], t, b, key[1]):
            if (c.n < share * whole and c.words < long) or (whole < LEAST and not (c.same and c.n == whole)):
                continue
            row = (c.same, c.n, c.slots, int(t.start[c.start]), int(t.end[c.end - 1]))
            if key not in best or (row[1], row[0]) > (best[key][1], best[key][0]):
                best[key] = row
                if c.same and c.n == whole:
                    break
    return [(*k, *v) for k, v in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: float = SHARE, long: int = LONG, block_windows: int = BLOCK_WINDOWS, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and benchmark item whose template the document holds.

    Returns doc_id, item_id, kind (verbatim, or reparameterised if slots differ), n_tokens and n_item_tokens (template
    tokens found and of the item), n_slots, start and end (bytes of the text). A match needs the given share of the
    item's tokens, or `long` tokens verbatim, and slots that agree; of several matches the verbatim and fuller one counts.
    Tokens are found in runs of a window at least, and runs that follow one another in the text as in the item add up,
    also with words put in or left out between them. An item without words in any window, such as a list of numbers, is
    found by its values. Items under LEAST tokens match verbatim and whole, wherever they occur. Case, in any script,
    punctuation and white space do not count. Of equally full matches the first in the text counts.
    The benchmark's windows go to the executors in blocks of a bounded size, documents stay where they are.
    Null and empty texts match nothing; repeated documents each have their rows; so have repeated items.
    """
    own = benchmark.select(F.col(item).cast("bigint").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("item_text"))
    # A text has no more windows than half its bytes.
    total = own.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_windows)))
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    if blocks == 1:
        return _search(docs, [(r.item_id, r.item_text) for r in own.toLocalIterator()], window, share, long)[0]
    # Rows are dealt to blocks one by one, so copies of an item do not meet in one. The driver holds one block at a time.
    path, out = fresh_path(spark, "items"), None
    own.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("bigint")).write.partitionBy("block").parquet(path)
    for k in range(blocks):
        part = spark.read.parquet(path).where(F.col("block") == k)
        found, sent = _search(docs, [(r.item_id, r.item_text) for r in part.toLocalIterator()], window, share, long)
        found = materialize(found, "found")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, items: list[tuple[int, str]], window: int, share: float, long: int) -> tuple[DataFrame, Broadcast]:
    """Rows of find_leaks for a block of items, and what was broadcast for it."""
    # Once with names as placeholders, once as words: a copy in capitals has names everywhere.
    sent = docs.sparkSession.sparkContext.broadcast([(names, bench(items, window, names)) for names in (True, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, benches = Canon(), sent.value
        b = benches[0][1]
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                keys = batch.column(0)[lo:hi]
                folded = fold([x or b"" for x in batch.column(1)[lo:hi].cast(pa.binary()).to_pylist()])
                best: dict[tuple, tuple] = {}
                for names, block in benches:
                    for d, i, same, n, *rest in matches(canon(folded, names), block, share, long):
                        if not names and not same:
                            continue
                        row = (same, n / max(1, int(block.sizes[i])), (d, i, same, n, *rest), int(block.sizes[i]))
                        if (d, i) not in best or row[:2] > best[d, i][:2]:
                            best[d, i] = row
                rows = [(*r[2], r[3]) for r in best.values()]
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": keys[d].as_py(), "item_id": int(b.ids[i]), "kind": "verbatim" if same else "reparameterised", "n_tokens": n, "n_item_tokens": size, "n_slots": s, "start": x, "end": y}
                        for d, i, same, n, s, x, y, size in rows
                    ],
                    pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), *((c, pa.int64()) for c in ("n_tokens", "n_item_tokens", "n_slots", "start", "end"))]),
                )

    return docs.mapInArrow(lean(run), SCHEMA), sent
