"""Vector codes, hard negatives and fingerprints against plain versions, and on odd tables."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives, imatch, int_vectors, queries, sql, vector_codes

DIR = "/root/testdata/sf0.001"
NEW = "op11_vector_codes op12_hard_negatives op13_imatch_fingerprints".split()
SCHEMA = "vec_id long, embedding array<float>, label int, x string"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR), con.execute(sql.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def plain_codes(rows, parts, entries, rounds):
    """Full search, all at once: (codes by key, errors by key, books)."""
    width = -(-max((len(v) for _, v in rows), default=1) // parts) * parts
    ids = np.array([i for i, _ in rows])
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (width - len(v)) for _, v in rows], np.int64).reshape(len(rows), parts, -1)
    first = np.lexsort((*x.reshape(len(rows), -1).T[::-1], ids))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((x.transpose(1, 0, 2)[:, :, None, :] - books[:, None, :, :]) ** 2).sum(3)
        code = d.argmin(2)
        if turn < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[code[p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    return sorted((int(i), bytes(code[:, n].astype(np.uint8)).hex(), int(d.min(2)[:, n].sum())) for n, i in enumerate(ids)), books


def test_codes_equal_the_full_search_and_prune(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 3
    kinds = {
        "groups": [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(700)],
        "ties": [(i // 2, [float(rng.integers(-2, 3)) / 256 for _ in range(8)]) for i in range(300)],
        "few": [(7, [0.5, -0.5, 1.0]), (3, [1.0])],
    }
    for kind, rows in kinds.items():
        df = spark.createDataFrame([(i, v, 1, "") for i, v in rows], SCHEMA).repartition(3)
        coded, books = vector_codes.encode(df, parts=4, entries=16, rounds=3)
        got = coded.collect()
        want, entries = plain_codes(rows, 4, 16, 3)
        assert sorted((r.vec_id, r.code.hex(), r.error) for r in got) == want, kind
        assert np.array_equal(books.entries, entries), kind
        if kind == "groups":
            assert sum(r.computed for r in got) < 0.2 * len(got) * 4 * 16  # the bounds decide about the others


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0] * 4, None, "a"), (1, [1.0] * 4, None, "b"), (None, [0.5] * 4, 2, None), (2, None, 1, ""), (3, [nan] * 4, 1, ""), (4, [inf, 0.0, 0.0, 0.0], 1, ""), (5, [1.0, None, 1.0, 1.0], 1, ""), (6, [3e38] * 4, 2, ""), (7, [], 2, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    coded, books = vector_codes.encode(df, carry=("label",), parts=2, entries=8)
    got = vector_codes.with_label_error(coded).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.label or 0) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 6, 2), (False, 7, 2), (True, 0, 2)]
    assert all(r.label_error == sum(x.error for x in got if x.label == r.label) for r in got)
    assert books.entries.max() == int_vectors.LIMIT and vector_codes.digest(books) == hashlib.sha256(books.text().encode()).hexdigest()
    empty, none = vector_codes.encode(df.limit(0), carry=("label",))
    assert vector_codes.with_label_error(empty).count() == 0 and none.text() == ""


def plain_negatives(rows, k=5, n=10):
    out = []
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v, _ in rows}
    for a, _, label in sorted(rows):
        if a % 100:
            continue
        scores = [(-int(np.dot(x[a], x[i])), i, l == label) for i, _, l in rows if i != a]
        for ps, p, _ in sorted(s for s in scores if s[2])[:k]:
            fits = sorted((s, i) for s, i, same in scores if not same and 30 * -ps <= 100 * -s <= 90 * -ps)[:n]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["groups", "same", "ties"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    """With groups, slices and samples so small that there are many of them."""
    for name, value in (("SAMPLE", 60), ("PIVOTS", 12), ("GROUP", 4), ("SLICE", 64)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    if kind == "ties":
        vectors = rng.integers(-2, 3, size=(900, 4)) / 256.0
    else:
        centres = rng.normal(size=(9, 8))
        vectors = np.round(centres[rng.integers(0, 9, 900)] + 0.1 * rng.normal(size=(900, 8)), 3)
        if kind == "same":
            vectors[rng.random(900) < 0.4] = vectors[0]  # one vector of many rows
    rows = [(i * 5, v, int(rng.integers(0, 3))) for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_cells_keep_rows_from_groups_that_they_cannot_serve(spark, monkeypatch):
    for name, value in (("SAMPLE", 200), ("PIVOTS", 20), ("GROUP", 10)):
        monkeypatch.setattr(hard_negatives, name, value)
    seen, real = [], hard_negatives.replicas

    def counted(cells, bounds):
        out = real(cells, bounds)
        seen.append((out.count(), cells.count() * bounds.select("group").distinct().count()))
        return out

    monkeypatch.setattr(hard_negatives, "replicas", counted)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 8)) * 4
    vectors = centres[rng.integers(0, 20, 2000)] + 0.02 * rng.normal(size=(2000, 8))
    df = spark.createDataFrame([(i * 10, v, i % 4) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>, label int")
    hard_negatives.mine(df, F.col("vec_id") % 100 == 0).count()
    assert len(seen) == 2 and all(sent < 0.35 * all_ for sent, all_ in seen), seen


def test_negatives_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1, "a"), (0, [1.0, 0.0], 1, "b"), (1, [1.0], 1, ""), (2, [0.5, 0.0], 2, ""), (2, [0.5, 0.0], 2, ""), (3, [0.5, 0.0], None, ""), (None, [0.5, 0.0], 2, ""), (4, None, 2, ""), (5, [nan, 0.5], 2, ""), (6, [0.5, None], 2, ""), (100, [0.0, 0.0], 5, ""), (7, [], 2, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 2, 65536, 32768)]
    names = df.withColumn("label", F.concat(F.lit("n"), "label"))
    assert sorted(map(tuple, hard_negatives.mine(names, F.col("vec_id") % 100 == 0).collect())) == got
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") == 77).count() == 0


def test_fingerprints_of_odd_rows(spark):
    words = [f"word{i}" for i in range(400)]
    text = lambda seed, n: " ".join(np.random.default_rng(seed).choice(words, n))
    rows = [(i, text(i, 60), "c") for i in range(60)] + [(60, text(3, 60), "c"), (61, None, "c"), (62, "", "c"), (None, text(4, 60), "c"), (None, None, None), (63, text(70, 30_000), "c"), (9, rows_text := text(9, 60), "c"), (64, "é" * 10, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    got = imatch.fingerprints(df.repartition(5)).collect()
    assert len(got) == len(rows) and rows_text
    of = lambda i: [r for r in got if r.doc_id == i]
    assert of(60)[0].fingerprint == of(3)[0].fingerprint  # equal texts
    assert len({r.fingerprint for r in got if r.doc_id in (61, 62)}) == 1 and of(61)[0].n_chars == 0
    assert [r.near_next for r in of(9)].count(1.0) == 1 and len(of(9)) == 2  # a repeated row follows its copy
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all(r.near_next == 0 for r in of(None)) and len(of(None)) == 2
    by_id = dict((i, t or "") for i, t, _ in rows if i is not None)
    for i, after in ((63, 62), (5, 4), (0, 64), (64, 63), (61, 60)):
        n = len(by_id[i])
        edited = by_id[i][: n - n // 3] + by_id[after][: n // 3]
        assert of(i)[0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
    assert imatch.fingerprints(df.limit(0)).count() == 0
    alone = imatch.fingerprints(df.where("doc_id = 64")).first()  # it comes after itself
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(("é" * 10).encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_fingerprints_tell_edited_from_other_texts(spark):
    got = queries.op13_imatch_fingerprints(spark, DIR)
    rows = got.where("n_chars > 300").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
