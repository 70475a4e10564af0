"""Every query with SQL equals it; the others run and have rows."""

import pytest
from compare import same

from cyclarium import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert same(catalog.queries()[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_hairpins_are_fitted_to_all_beads(spark):
    from cyclarium.queries.peaks import HAIRPINS, _peaks

    larger = "/root/testdata/sf0.01"
    beads = {(r.track, r.bead) for r in _peaks(spark, larger).select("track", "bead").distinct().collect()}
    assert max(b for _, b in beads) > 20
    assert {(r.track, r.bead, r.hpin) for r in catalog.queries()["fit_hairpins"](spark, larger).collect()} == {(*b, h) for b in beads for h in HAIRPINS}


@pytest.mark.parametrize(("name", "column", "kinds"), [("data_cleaning", "phase", set(range(8))), ("ramp_status", "status", {"ok", "fixed", "bad"})])
def test_all_kinds_of_rows_are_compared(spark, name, column, kinds):
    rows = catalog.queries()[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()
    assert {r[0] for r in rows} == kinds


def test_resolution_tells_the_skewness_over_cycles(spark, sf_dir):
    from cyclarium.operators.peaks import resolution

    means = [1.0, 2.0, 2.0, 7.0]
    events = spark.createDataFrame([("t", 1, 0, c, m + s, 4) for c, m in enumerate(means) for s in (-0.5, 0.5)], "track string, bead int, peak int, cycle int, avg double, length int")
    (row,) = resolution(events).collect()
    assert row.resolution == pytest.approx(5.5**0.5) and row.positionprecision == pytest.approx(5.5**0.5 / 2)
    assert row["skew"] == pytest.approx(sum((m - 3) ** 3 for m in means) / 4 / 5.5**1.5)
    rows = catalog.queries()["resolution"](spark, sf_dir).collect()
    assert any(r["skew"] for r in rows) and all(r["skew"] is None for r in rows if r["resolution"] == 0)
