import random

import pytest
from pyspark.sql import functions as F

from pairlens.functions.semilocal import window_lengths
from pairlens.operators.fuzzy import dealt_by_cost, lcs_length


def test_every_window_against_its_own_lcs():
    rng = random.Random(7)
    for _ in range(300):
        s, t = ("".join(rng.choice("ab é🙂") for _ in range(rng.randint(low, 30))) for low in (0, 1))
        for width in {1, len(t), max(1, len(t) // 2), min(max(1, len(s)), len(t))}:
            assert window_lengths(s, t, width).tolist() == [lcs_length(s, t[i:i + width]) for i in range(len(t) - width + 1)]
    with pytest.raises(ValueError):
        window_lengths("abc", "ab", 3)


def test_long_texts_are_numbered_beyond_16_bits():
    rng = random.Random(8)
    s, t = "".join(rng.choice("abcd") for _ in range(120)), "".join(rng.choice("abcd") for _ in range(33_000))
    got = window_lengths(s, t, 120)
    assert len(got) == 33_000 - 119
    for i in (0, 1, 16_000, 32_700, 32_880):
        assert got[i] == lcs_length(s, t[i:i + 120])


@pytest.mark.parametrize("bucket_rows", [10, 10_000])
def test_tasks_are_stretches_of_cost(spark, bucket_rows):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 5, 50, 900])) for i in range(800)]
    table = spark.createDataFrame(rows, "id long, c long")
    dealt, tasks = dealt_by_cost(table, F.col("c"), ["id"], "dealt", cost_of_a_task=2000, bucket_rows=bucket_rows)
    got = dealt.collect()
    assert dealt.columns == ["id", "c", "task"] and sorted((r.id, r.c) for r in got) == rows
    sums = [sum(r.c for r in got if r.task == t) for t in range(tasks)]
    assert sum(sums) == sum(c for _, c in rows) and max(sums) <= 2000 + 900 and min(sums[:-1]) >= 2000 - 900
    assert tasks == sum(sums) // 2000 + 1
    few, bounded = dealt_by_cost(table, F.col("c"), ["id"], "dealt", cost_of_a_task=1, most_tasks=7, bucket_rows=bucket_rows)
    assert bounded <= 8 and few.agg(F.max("task")).first()[0] < bounded


def test_nothing_is_one_task(spark):
    dealt, tasks = dealt_by_cost(spark.range(0), F.col("id"), ["id"], "dealt")
    assert tasks == 1 and dealt.count() == 0
