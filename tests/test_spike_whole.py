"""Rows whose windows just lost the spike or the NaN are compared too."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def test_rows_after_the_spoilt_windows(spark):
    got = entry.queries()["sma_after_spike_whole"](spark, SF).where("pos in (29, 30, 209, 210, 319, 320, 499, 500)").collect()
    assert {r.pos for r in got} == {29, 30, 209, 210, 319, 320, 499, 500}
    assert all((r.sma_20 is None) == (r.pos in (29,) or r.pos == 319) for r in got)
    assert all((r.sma_200 is None) == (r.pos not in (210, 500)) for r in got)
