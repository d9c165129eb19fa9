"""Rows in a stream's state as Arrow batches: a value of the state holds some thousand rows, not one."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa

#: The type of a state of such values.
PACKED = "rows binary"


def packed(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        w.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return (sink.getvalue().to_pybytes(),)


def unpacked(values: Iterable[tuple], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(v[0]).read_all() for v in values]
    return pa.concat_tables(tables).to_pandas() if tables else schema.empty_table().to_pandas()
