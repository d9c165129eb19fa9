from __future__ import annotations

import pytest

from coinfold.operators import staking as K
from coinfold.plans import reports as R
from coinfold.plans import uk_cgt as UK
from coinfold.plans import us_lots as US
from coinfold.sources.testdata import LEDGER
from tests.test_ledger import ROWS, ledger


def test_withdrawals(spark):
    t = lambda w, a, g=None: {"transfer_direction": w, "asset": a, "trade_group_id": g, "source": "ethereum"}
    x = ledger(spark, [("2024-01-01", "TRANSFER", 5, 0, t("OUT", "ABC", "o")), ("2024-02-01", "TRANSFER", 5, 0, t("IN", "ABC", "g")), ("2024-02-01", "TRANSFER", 2, 0, t("IN", "RWD", "g")), ("2024-03-01", "TRANSFER", 9, 0, t("IN", "X", "h")), ("2024-03-01", "TRANSFER", 1, 0, t("IN", "Y", "h"))])
    assert [r.transaction_type for r in K.withdrawals(x).orderBy("id").collect()] == ["TRANSFER", "TRANSFER", "STAKING", "TRANSFER", "STAKING"]


def test_liquid_yield(spark):
    g = lambda a, i: {"asset": a, "trade_group_id": i}
    x = ledger(spark, [("2024-01-01", "SELL", 1.0, 100, g("SOL", "a")), ("2024-01-01", "BUY", 0.9, 100, g("MSOL", "a")), ("2024-06-01", "SELL", 0.9, 110, g("MSOL", "b")), ("2024-06-01", "BUY", 1.1, 110, g("SOL", "b"))])
    y = K.liquid_yield(x)
    got = {r.id: r for r in y.collect()}
    assert got["t03"].amount == pytest.approx(1.0) and (got["t03-lst-yield"].transaction_type, got["t03-lst-yield"].amount) == ("STAKING", pytest.approx(0.1))
    assert {r.id: r.amount for r in K.liquid_yield(y).collect()} == {i: r.amount for i, r in got.items()}


def test_time_clusters(spark):
    x = ledger(spark, [("2024-01-01T00:00:00", "BUY", 1, 1), ("2024-01-01T00:01:00", "BUY", 1, 1), ("2024-01-01T00:02:00", "BUY", 1, 1)])
    assert dict(K.time_clusters(x).collect()) == {"t00": "t00", "t01": "t00", "t02": "t02"}


def test_reports_and_files(spark, tmp_path):
    x = ledger(spark, ROWS)
    uk, us = R.uk_report(x), R.us_report(x, to_ccy="GBP")
    assert uk["by_year"].count() == 1 and us["summary"].where("year is null").first().gain_loss == 700.0
    R.write_csv(us["form_8949"], us["summary"], str(tmp_path / "us"))
    assert spark.read.option("header", True).csv(str(tmp_path / "us/detail")).count() == us["form_8949"].count()
    R.write_backup(x, spark.createDataFrame([("t00", 1.0)], "anchor_id string, total_fiat double"), str(tmp_path / "bk"))
    assert R.read_backup(spark, str(tmp_path / "bk"), LEDGER).count() == x.count()
    lots, disposals = R.breakdown(US.open_lots(US.lot_events(x, "GBP"), US.matches(x, to_ccy="GBP")), US.matches(x, to_ccy="GBP"))
    assert lots.count() == 0 and [r.missing_basis for r in disposals.collect()] == [True, False]
    assert {r.kind for r in R.data_health(x, US.matches(x)).collect()} == {"missing_basis", "coverage_gap"}


def test_perps_as_gains(spark):
    x = ledger(spark, [("2024-06-01", "SELL", 1, 10, {"instrument_kind": "perp", "realized_pnl": 100.0, "fee_fiat": 3.0}), ("2024-06-02", "SELL", 1, 10, {"instrument_kind": "perp", "realized_pnl": -40.0}), ("2024-06-03", "BUY", 1, 10, {"instrument_kind": "perp"})])
    rows = R.uk_with_perps(UK.cgt_rows(UK.uk_engine(UK.uk_legs(x))), x)
    y = UK.cgt_by_year(rows).first()
    assert (y.gains, y.losses, y.net, y.n_disposals) == (97.0, 40.0, 57.0, 2)


def test_positions_and_allocation(spark):
    x = ledger(spark, [("2023-01-01", "BUY", 2, 100), ("2023-01-01", "BUY", 1, 30, {"asset": "ETH"})])
    e = US.lot_events(x, "GBP")
    p = US.positions(US.open_lots(e, US.fifo_matches(e)), spark.createDataFrame([("BTC", 75.0), ("ETH", 50.0)], "asset string, price double"))
    assert tuple(R.portfolio_totals(p).first()) == (2, 200.0, 130.0, 70.0)
    assert {r.asset: r.percent for r in R.allocation(p).collect()} == {"BTC": 75.0, "ETH": 25.0}


def test_reports_pair_transfers_of_one_venue_and_of_one_hash(spark):
    from coinfold.operators import pairing as P

    t = lambda d, i, **k: {"transfer_direction": d, "id": i, **k}
    x = ledger(spark, [
        ("2023-01-01", "BUY", 10, 1000),
        ("2023-02-01", "TRANSFER", 2, 300, t("OUT", "h-out", on_chain_tx_id="h")), ("2023-02-09", "TRANSFER", 1.999, 300, t("IN", "h-in", on_chain_tx_id="h")),
        ("2023-02-02", "TRANSFER", 4, 500, t("OUT", "g-out", trade_group_id="g")), ("2023-02-20", "TRANSFER", 4, 500, t("IN", "g-in", trade_group_id="g")),
        ("2023-03-01", "TRANSFER", 3, 400, t("OUT", "x-crypto_earn_program_created")), ("2024-03-01", "TRANSFER", 3, 900, t("IN", "x-crypto_earn_program_withdrawn")),
        ("2024-04-20", "TRANSFER", 3, 900, t("IN", "y-crypto_earn_program_withdrawn")),
        ("2024-05-01", "TRANSFER", 1, 400, t("OUT", "o", source="a")), ("2024-05-02", "TRANSFER", 1, 400, t("IN", "i", source="b")),
    ])
    assert {(r.out_id, r.in_id) for r in P.internal_transfers(x).collect()} == {("h-out", "h-in"), ("g-out", "g-in"), ("x-crypto_earn_program_created", "x-crypto_earn_program_withdrawn"), ("o", "i")}
    assert R.uk_report(x)["rows"].count() == 0 and R.us_report(x)["form_8949"].count() == 0
