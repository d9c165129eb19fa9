"""The UK fold hands on the rows of many assets in one batch."""

from __future__ import annotations

from datetime import date, timedelta

import pyarrow as pa

from coinfold.plans import uk_cgt as UK


def test_rows_of_many_assets_share_batches():
    day = date(2024, 1, 1)
    events = [(f"A{n:05}", day + timedelta(days=i), "AD"[i % 2], "2" if i % 2 == 0 else "1", "10", f"{n}-{i}") for n in range(5000) for i in range(4)]
    names = ["asset", "day", "kind", "quantity", "value", "ids"]
    made = pa.Table.from_arrays([pa.array(c) for c in zip(*events, strict=True)], names)
    out = [b for b in UK._folds(iter(made.to_batches(max_chunksize=777))) if b.num_rows]
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    text = lambda r: tuple(str(round(v, 12)) if isinstance(v, UK.Decimal) else v for v in r)
    want = [text(r) for n in range(5000) for r in UK._fold(f"A{n:05}", [e[1:] for e in events[4 * n : 4 * n + 4]])]
    assert rows == want and len(rows) >= 10_000
    assert len(out) < 10
    assert not sum(b.num_rows for b in UK._folds(iter([])))
