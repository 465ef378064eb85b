"""Daily deposits: stays are shuffled, not their days."""

import datetime

from pyspark.sql import functions as F

from rillwork.operators import rotation


def test_stays_are_shuffled_once_and_all_days_summed(spark):
    day = datetime.date(1969, 11, 20)
    stays = [(1, day, 50, 3, 0.5), (1, day + datetime.timedelta(30), 100, 4, 0.2), (2, day, 1, 5, 0.1), (2, day, 0, 9, 0.0)]
    made = rotation.daily_deposit(spark.createDataFrame(stays, "reach long, start date, days int, a long, bank double"), ["a"], "bank")
    plan = made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for reach, start, n, a, bank in stays:
        for d in range(n):
            key = (reach, start + datetime.timedelta(d))
            old = want.get(key, (0, 1.0))
            want[key] = (old[0] + a, min(old[1], bank))
    assert {(r.reach, r.day): (r.a, r.bank) for r in made.collect()} == want
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # days are made above the exchange
    assert made.agg(F.count("*")).first()[0] == len(want)
