import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from quiverlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "orders", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def as_sql(spark, name, folder):
    """A query's rows and those of its SQL over the embeddings in a folder."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    cols = ["qid", "rank", "id", "score"]
    got, want = registry.queries()[name](spark, f"file://{folder}").toPandas(), con.sql(registry.oracle_sql()[name]).df()
    return sorted(map(tuple, got[cols].values.tolist())), sorted(map(tuple, want[cols].values.tolist()))


def embeddings(folder, x, sizes):
    """Vectors as a table of embeddings, dealt over files of the given sizes."""
    (folder / "embeddings.parquet").mkdir()
    for k, (lo, n) in enumerate(zip(np.cumsum([0, *sizes]), sizes)):
        part = pa.table({"vec_id": np.arange(lo, lo + n), "embedding": pa.array(list(x[lo : lo + n].astype(np.float32)), pa.list_(pa.float32()))})
        pq.write_table(part, folder / "embeddings.parquet" / f"part-{k:04d}.parquet")


def test_staged_auto_over_many_rows(spark, tmp_path):
    """As its SQL from 32768 rows on, too."""
    embeddings(tmp_path, np.random.default_rng(3).standard_normal((33000, 64)), [16500, 16500])
    got, want = as_sql(spark, "staged_auto", tmp_path)
    assert len(got) == 500 and got == want


@pytest.mark.parametrize("name", ["staged_auto", "exact_topk"])
def test_ties_over_uneven_files(spark, tmp_path, name):
    """As its SQL over copies in batches of 1 to 39 rows: equal scores fall to the smaller id, whatever stands beside them."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 40, 24)
    x = np.resize(rng.standard_normal((23, 64)), (sizes.sum(), 64))
    embeddings(tmp_path, x, sizes.tolist())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got, want = as_sql(spark, name, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 500 and got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())
