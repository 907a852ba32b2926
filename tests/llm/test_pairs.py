import collections
import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import jaccard_join as jj
from lodestone.llm import suffix_array as sa
from lodestone.llm import suffix_dedup as sd
from lodestone.llm.components import components

DOCS = "doc_id long, text string"


def brute_join(rows):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def near_copies(seed, n=160):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(40)}" for _ in range(r.randint(3, 80))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a  B"), (5, "x")]
    for k in range(6, n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"n{r.randrange(1000)}"
        rows.append((k, " ".join(w) + (" common tail of every page here" if r.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize(("size", "bucket"), [(4 << 20, 1 << 19), (600, 100)])
def test_join_equals_brute_force(spark, monkeypatch, size, bucket):
    monkeypatch.setattr(jj, "SLICE", size)
    monkeypatch.setattr(jj, "BUCKET", bucket)
    monkeypatch.setattr(jj, "TREE", 1 << 20 if size > 1000 else 640)
    rows = near_copies(size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.similar(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_join(rows)


def test_join_keeps_repeated_rows_and_takes_empty_tables(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(9, text, 1), (9, text, 2), (4, text.upper(), 3)], DOCS + ", component_id long")
    assert sorted(tuple(r) for r in jj.similar(df).collect()) == [(4, 2, 4), (9, 2, 4), (9, 2, 4)]
    assert jj.similar(df.limit(0)).count() == 0


def test_tree_finds_all_partners():
    r = random.Random(3)
    for _ in range(60):
        sets = [np.array(sorted(r.sample(range(40), r.randint(1, 30)))) for _ in range(r.randint(1, 20))]
        sets += [sets[0], sets[0][:-1]] if len(sets[0]) > 1 else []
        sizes = np.array([len(s) + r.choice([0, 0, 1]) for s in sets])
        tree, mark = jj.Tree(sets, sizes), np.zeros(40, np.int64)
        for k, x in enumerate(sets):
            want = [j for j, y in enumerate(sets) if 9 * len(np.intersect1d(x, y)) >= 4 * (sizes[k] + sizes[j])]
            assert sorted(tree.partners(x, int(sizes[k]), mark).tolist()) == want


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: y for x, y in up.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize(("letters", "buckets", "short"), [(1, 1024, 0), (2, 1024, 0), (3, 1024, 2048), (5, 1024, 0), (5, 2, 0), (5, 4, 5), (7, 3, 2048)])
def test_suffix_arrays(monkeypatch, letters, buckets, short):
    monkeypatch.setattr(sa, "BUCKETS", buckets)
    monkeypatch.setattr(sa, "SHORT", short)
    r = random.Random(letters)
    for _ in range(150):
        t = [r.randrange(letters) for _ in range(r.randint(1, 40))] * r.choice([1, 1, 3])
        x = np.array(t)
        order = sa.suffix_array(x, letters)
        assert order.tolist() == sorted(range(len(t)), key=lambda i, t=t: t[i:])
        shared = sa.common_prefixes(x, order, 0)
        for a, b in zip(order[1:], order[:-1], strict=True):
            n = 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n] != 0:
                n += 1
            assert shared[a] == n


def test_suffix_array_of_many_names():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    raw = "".join(r.choice(words) for _ in range(20_000)).encode()[:60_000]
    order = sa.suffix_array(np.frombuffer(raw, np.uint8).astype(np.int64), 257)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i : i + 200])


def brute_repeats(rows):
    first, raw = {}, [(k, (t or "").encode()) for k, t in rows]
    for k, b in raw:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(k, first.get(b[i : i + 50], k))
    out = collections.Counter()
    for k, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out[(k, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("size", "hot", "part"), [(3 << 20, 512, 1 << 19), (700, 512, 200), (500, 0, 90)])
def test_repeats_equal_brute_force(spark, monkeypatch, size, hot, part):
    for name, value in (("SLICE", size), ("HOT", hot), ("PART", part)):
        monkeypatch.setattr(sd, name, value)
    r = random.Random(2)
    base = "".join(r.choice("ab é\n") for _ in range(2000))
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 300), (6, base[:60]), (7, base[:60]), (7, base[:60] + "q")]
    for k in range(10, 90):
        a = r.randrange(1900)
        rows.append((k, base[a : a + r.randrange(120)] + "".join(r.choice("abc") for _ in range(r.randrange(90))) + base[a : a + r.randrange(70)]))
    df = spark.createDataFrame([(*x, "clash") for x in rows], DOCS + ", kept string")
    got = collections.Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in sd.remove_repeats(df).collect())
    assert got == brute_repeats(rows)


def test_repeats_of_nothing(spark):
    assert sd.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_without_an_id_stay(spark):
    rows = [(1, "a b c d e f g " * 20), (None, "a b c d e f g " * 20), (None, "A\tb  c"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, cut = jj.similar(df).collect(), sd.remove_repeats(df).collect()
    assert sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got)) == [(0, 0, 0), (0, 1, 0), (0, 7, 0), (1, 7, 1)]
    assert sorted((r.doc_id or 0, bytes(r.kept).decode(), r.n_removed, r.n_bytes) for r in cut) == sorted((k or 0, t or "", 0, len(t or "")) for k, t in rows)
