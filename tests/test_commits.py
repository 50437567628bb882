import threading

import pytest
from pyspark.sql import functions as F

from claimloom.sources.commits import CommitLog, Conflict
from claimloom.storage import new_path


def log(spark):
    return CommitLog(spark, new_path(spark, "log"), "id bigint, name string")


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], "id bigint, name string")


def test_rows_count_once_committed(spark):
    table = log(spark)
    assert table.read().count() == 0 and table.version() == 0
    left = table.write(rows(spark, 9))
    assert table.read().count() == 0
    assert [table.append(rows(spark, 1, 2)), table.append(rows(spark, 3))] == [0, 1]
    assert sorted(map(tuple, table.read().collect())) == [(1, "n1", 0), (2, "n2", 0), (3, "n3", 1)]
    with pytest.raises(Conflict):
        table.commit(left, 1)
    table.commit(left, 2)
    assert table.read().count() == 4


def test_two_writers_cannot_both_promote(spark):
    """Both see no champion; one commits, the other sees it then and has nothing left to do."""
    table, gate, results = log(spark), threading.Barrier(2), {}

    def writer(number):
        tries = []

        def choose(held):
            tries.append(held.count())
            if len(tries) == 1:
                gate.wait(60)
            return None if tries[-1] else rows(spark, number)

        results[number] = (table.decide(choose), tries)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (1, 2)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sorted(str(r[0]) for r in results.values()) == ["0", "None"] and table.read().count() == 1
    assert all(tries[0] == 0 for _, tries in results.values())


def test_appends_of_many_writers_all_count(spark):
    table = log(spark)
    threads = [threading.Thread(target=table.append, args=(rows(spark, n),)) for n in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert table.read().agg(F.sum("id"), F.count_distinct("commit")).first()[:] == (6, 4)
