"""SRC-05, SRC-06: payloads of any number of edges pass the guards, since there are as many payloads as they need."""

from pyspark.sql import functions as F

from evigraph.plans import stores
from tests.conftest import SF


def test_payloads_grow_in_number_not_in_size(spark):
    some = stores._payload(spark, SF)
    more = stores._payload(spark, SF, rows=200)
    sizes = [r["count"] for r in more.groupBy("payload").count().collect()]
    assert sum(sizes) == some.count() > 10_000
    assert max(sizes) < 400 and len(sizes) > 16
    assert some.select(F.count_distinct("payload")).first()[0] == 16
