"""GRA-10: rows are made for the edges that a walk takes, not for those behind its end."""

from evigraph.operators import walks


def test_mechanism_makes_no_rows_that_it_does_not_take(spark):
    """A root's edges are told by their places: of a service with many ways the first ones are read, however many there are."""
    rows = [("v", f"c{i}", "CALLS", f"{i}", False) for i in range(3)] + [(f"c{i}", "s", "CALLS", "0", False) for i in range(3)]
    rows += [("s", f"e{i:03}", "READS_ENTITY", "0", i == 150) for i in range(200)] + [("s", "e150", "READS_ENTITY", "1", False)]
    edges = spark.createDataFrame(rows, "src string, dst string, rel string, seq string, observed boolean")
    assert walks.first_ways(edges, 10).where("src = 's'").count() == 10
    assert {r["ways"] for r in walks.first_ways(edges, 10).where("src = 's'").collect()} == {200}
    steps = walks.mechanism(edges, spark.createDataFrame([("v",)], "id string"), max_steps=10).orderBy("order").collect()
    assert [r["order"] for r in steps] == list(range(1, 11))
    assert [r["dst"] for r in steps][6:] == ["e150", "e000", "e001", "e002"]
