"""The bootstrap of weekly returns over a whole table."""

from pyspark.sql import functions as F

from retroscope.operators import inference
from retroscope.plans import registry


def test_all_weeks_enter(spark, sf_dir):
    returns = registry._returns(spark, sf_dir).where("daily_return is not null")
    mean, weeks = returns.agg(F.avg("daily_return"), F.countDistinct(F.date_trunc("week", "session"))).first()
    got = registry.QUERIES["block_bootstrap_all_weeks"](spark, sf_dir).first()
    assert weeks > 100 and got.draws == 200
    assert abs(got.estimate - mean) < 1e-6 and got.low <= got.estimate <= got.high
    drawn = inference.block_draws(weeks, 4, 200, spark).agg(F.countDistinct("week_number")).first()[0]
    assert drawn == weeks
