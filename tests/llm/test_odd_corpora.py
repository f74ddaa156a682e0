"""Every corpus query on empty tables, and on tables with null rows, repeated rows and extra columns of common names."""

from concurrent.futures import ThreadPoolExecutor

import pytest
import variants

from lumatable.llm import queries


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {k: variants.write(spark, tmp_path_factory.mktemp(k), k) for k in ("empty", "odd")}


def test_queries_run(spark, folders):
    def run(name):
        assert queries.QUERIES[name](spark, folders["empty"]).count() == 0, name
        queries.QUERIES[name](spark, folders["odd"]).write.format("noop").mode("overwrite").save()

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(run, sorted(queries.QUERIES)))


@pytest.mark.parametrize("name", ["p5_found", "p6_found", "p8_ids", "p9_containers", "p10_found"])
def test_odd_rows_change_nothing(spark, folders, name):
    query = queries.QUERIES[name]
    plain, odd = query(spark, variants.DATA).distinct(), query(spark, folders["odd"]).distinct()
    assert plain.exceptAll(odd).count() == 0 == odd.exceptAll(plain).count()
