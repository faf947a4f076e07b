"""The pair, model and test queries on assays do their whole job however the ids are spaced."""

from __future__ import annotations

from collections import defaultdict
from hashlib import md5

import duckdb
import pytest
from check_queries import compare

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def _expected(members: list[tuple[int, int]]) -> dict[str, int]:
    """Rows of every query from the sizes of the assays: a label's rows in ceil(n / 32) blocks by hash of the id."""
    labels, assays = defaultdict(list), defaultdict(list)
    for key, label in members:
        labels[label].append(key)
    for label, keys in labels.items():
        for k in keys:
            assays[label, int(md5(str(k).encode()).hexdigest()[:15], 16) % -(-len(keys) // 32)].append(k)
    pairs = sum(len(a) * (len(a) - 1) // 2 for a in assays.values())
    tests = [sum(int(md5(str(k).encode()).hexdigest()[:8], 16) % 5 == 0 for k in a) for a in assays.values()]
    cross = sum(t * (len(a) - t) for t, a in zip(tests, assays.values()))
    n, rows = len(assays), len(members)
    return {
        "sim_1": 4 * pairs, "sim_2": n, "sim_3": 4 * pairs, "sim_4": pairs, "sim_5": pairs, "sim_6": pairs + rows,
        "sim_7": 4 * n, "sim_8": 12 * n, "sim_10": pairs, "sim_11": n, "joi_10": pairs, "joi_11": cross, "agg_24": 4,
        "mod_9": rows, "udf_2": rows, "udf_3": rows, "sta_3_exact": n, "sta_8": n, "snk_5": 4 * n, "sta_9": n,
    }


@pytest.fixture(scope="module")
def spaced(tmp_path_factory, sf):
    """The embeddings with every id a thousand times as large."""
    path = tmp_path_factory.mktemp("spaced")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (vec_id * 1000 AS vec_id) FROM '{sf}/embeddings.parquet') TO '{path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    return str(path), con, _expected(con.execute("SELECT vec_id, label FROM embeddings").fetchall())


@pytest.mark.parametrize("name", list(_expected([])))
def test_spaced_ids_leave_the_whole_job(spark, spaced, name):
    path, con, expected = spaced
    got = QUERIES[name](spark, path).toPandas()
    assert len(got) == expected[name]
    assert compare(got, con.execute(ORACLES[name]).df()) == ""
