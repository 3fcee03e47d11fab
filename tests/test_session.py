import os

from strandweave.session import cut_lineage, release_tables


def test_tables_are_deleted_at_the_end(spark):
    release_tables(spark)
    kept = [cut_lineage(spark.range(3)) for _ in range(2)]
    files = [f.removeprefix("file://") for k in kept for f in k.inputFiles()]
    assert sum(k.count() for k in kept) == 6 and all(os.path.exists(f) for f in files)
    assert release_tables(spark) == 2 and not any(os.path.exists(f) for f in files)
    assert release_tables(spark) == 0
