import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    return None if v is None or v != v else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_ways_of_a_million_parts(spark, tmp_path):
    """The order of a way's nodes is that of the SQL, also where parts outweigh lines."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT unnest([5, 700000, 1300000, 1999999])::BIGINT AS p_partkey, 'x' AS p_name, 'a b' AS p_type, 1 AS p_size) TO '{tmp_path}/part.parquet'")
    c.execute(f"COPY (SELECT 1::BIGINT AS l_orderkey, unnest([1300000, 5, 700000, 1999999])::BIGINT AS l_partkey, unnest([1, 2, 2, 1])::INT AS l_linenumber) TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = [(r.id, r.wkt) for r in entry.queries()["g2_way_geometry"](spark, str(tmp_path)).collect()]
    assert got == c.execute(entry.oracle_sql()["g2_way_geometry"]).fetchall()


#: Queries whose work on a row costs more than to move it.
COSTLY = ["f3_cql_spatial", "e23_collections", "e17_area_in_metres", "f9_crossing_rings", "r4_reprojected_output", "f9_valid_of_kind", "r7_synthetic"]


@pytest.mark.parametrize("name", COSTLY)
def test_costly_work_is_shared(spark, name):
    """A small file's rows are dealt out before the work on them, which no filter does earlier."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Repartition 4, true")
    assert below and "lambda" in above and "lambda" not in below


@pytest.mark.parametrize("name", ["j10_holes_g5_stitch", "g3_relation_lines", "g4_multipolygon_g6_collection"])
def test_relations_are_assembled_once(spark, name):
    """Neither a condition on the result nor rounds that no relation needs assemble them again."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_round_does_not_join_relations_with_their_kinds(spark):
    plan = entry.queries()["j7_members_j8_nested"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 5
