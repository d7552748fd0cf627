"""Row folds reach the last row of the longest symbol."""

import __spark_entry__ as entry
from checks.common import bars
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_last_rows_have_folds(spark):
    last = bars(spark, SF).agg(F.max("pos")).first()[0]
    assert last > 700
    got = entry.queries()["folds_every_row_whole"](spark, SF)
    assert got.agg(F.max("pos"), F.max("last")).first() == (last, last - 399)
