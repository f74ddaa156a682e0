"""Every core query on empty tables, and on tables with null rows, repeated rows and extra columns of common names."""

from concurrent.futures import ThreadPoolExecutor

import pytest
import variants

from lumatable.plans.read_queries import QUERIES

ONE_ROW = {"image_count", "smart_counts", "saved_counts", "album_counts", "range_counts", "aesthetic_rank", "distinct_shots", "repaired_covers"}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {k: variants.write(spark, tmp_path_factory.mktemp(k), k) for k in ("empty", "odd")}


def test_queries_run(spark, folders):
    """All at once, as most of a small query's time is planning."""

    def run(name):
        query = QUERIES[name]
        assert (query(spark, folders["empty"]).count() == 0) == (name not in ONE_ROW), name
        query(spark, folders["odd"]).write.format("noop").mode("overwrite").save()

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(run, sorted(QUERIES)))


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p3_replayed", "p4_found", "p7_found", "p7_by_cells", "p7_near"])
def test_odd_rows_change_nothing(spark, folders, name):
    query = QUERIES[name]
    plain, odd = query(spark, variants.DATA).distinct(), query(spark, folders["odd"]).distinct()
    assert plain.exceptAll(odd).count() == 0 == odd.exceptAll(plain).count()
