import os

import duckdb
import pytest

import __spark_entry__
from lodestone import catalog_pages as catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation events documents embeddings pages benchmark conversations".split()
CHECKED = "tokenize_counts bm25_topk vector_topk rrf_hybrid_topk hard_split_chunks recursive_chunks units_scoped_chunks mmr_topk eval_recall_at_k markdown_table heading_path_fill block_units page_properties lesson_hashes store_mutations state_mutations sync_run store_versions vector_index_rows".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 40
