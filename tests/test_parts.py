"""What pages add to the state of their documents."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from reportlens.streaming import state

from test_growth import pages


def test_a_page_is_one_part_of_its_document(spark):
    """A row per claim, each with its whole evidence, went to the state, beside a second reading of the pages for their sums."""
    given = pages(spark)
    rows = state.parts(given).collect()
    assert len(rows) == given.count()
    claims = [json.loads(c) for r in rows for c in r.claims]
    assert len(claims) > 5 and all({*c} == {*state.KEPT} for c in claims)


class Value:
    def __init__(self):
        self.kept, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.kept, self.calls = value, self.calls + 1


def test_a_document_reads_and_writes_its_state_once():
    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return value
    value, document = Value(), state.DocumentState(2)
    document.init(Handle())

    def part(ranks):
        return Row(**dict.fromkeys(state.NAMES, 1), ranks=ranks, claims=[f"c{r}" for r in ranks])
    for given, best in (([[5, 3], [4]], ["c3", "c4"]), ([[1], []], ["c1", "c3"])):
        value.calls = 0
        out, = document.handleInputRows(("d", None, None), iter(map(part, given)), None)
        assert out.claims == best and value.calls == 2
    assert out.scope1_total == 4 and out.scope3_count == 4 and out.year is None


def test_rank_keys_order_as_the_batch_does(spark):
    rows = [(s, p, k) for s in (0, 40, 100) for p in (None, -3, 0, 1, 2**31 - 1) for k in (0, 1, 121)]
    df = spark.createDataFrame(rows, "score int, page int, keyword_ord int").withColumn("rank", state.rank_key(F.col("score"), F.col("page"), F.col("keyword_ord")))
    a, b = (df.orderBy(*o).drop("rank").collect() for o in (["rank"], [F.desc("score"), "page", "keyword_ord"]))
    assert a == b
