"""Ordered passes over keyed rows whose rule needs the state left by the row before.

Rows are dealt out by (key, segment) and sorted; a task goes through them in Arrow batches,
all keys of a batch at once, and carries one state row from batch to batch. A key is cut into
segments by its share of the rows: quantiles of a bounded sample of its order, so that a key
that holds most rows is spread over most tasks and a small key stays whole. The plan is the
same at every size; only the number of segments follows the data.

What state a later segment starts in comes from transition tables. For each segment of a cut
key a task works out, without knowing what came before, to which state every possible first
state leads: mostly one row, as the rules forget their past. The tables of one key are then
looked up one after the other, one row per segment, and the state rows found are put in front
of their segments for the pass proper.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rivulet.session import materialize

SEGMENT_ROWS = 1_000_000  # rows of a segment, about, on inputs that have as many
SAMPLES = 40              # sampled rows for each segment


class Cuts:
    """Where the keys that hold more than one part's share of the rows are cut: ``table`` (key,
    ``_cuts`` ascending), at most ``parts`` cuts in all, and the most cuts of one key."""

    def __init__(self, df: DataFrame, key: str, order: list[str], parts: int | None = None,
                 segment_rows: int = SEGMENT_ROWS):
        self.key, self.order = key, order
        narrow = df.select(key, *order)
        n = narrow.count()
        parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                             -(-n // segment_rows))
        fraction = min(1.0, SAMPLES * parts / max(n, 1))
        per = max(1, round(fraction * n / parts))  # sampled rows of one segment
        drawn = narrow.sample(fraction, seed=17) if fraction < 1 else narrow
        cuts = F.transform(F.sequence(F.lit(per), F.size("_s") - 1, F.lit(per)),
                           lambda i: F.get("_s", i))
        self.table = materialize(
            drawn.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_s"))
            .where(F.size("_s") > per).select(key, F.array_distinct(cuts).alias("_cuts")), "cuts")
        self.most = self.table.agg(F.max(F.size("_cuts"))).first()[0] or 0

    def mark(self, df: DataFrame, how: str = "left") -> DataFrame:
        """``df`` with ``_segs``, the number of its key's cuts, and ``_seg``, how many of them
        are at or before the row (binary search). ``how="inner"``: only rows of cut keys."""
        steps = [1 << k for k in reversed(range(self.most.bit_length()))]
        at = F.struct(*self.order)
        seg = F.lit(0)
        if steps:
            seg = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, s: F.when(
                F.get("_cuts", i + s - 1) <= at, i + s).otherwise(i))
        # As many cuts as there are parts: small whatever the input.
        return (df.join(F.broadcast(self.table), self.key, how).withColumn("_seg", seg)
                .withColumn("_segs", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts")))
                .drop("_cuts"))


def _ordered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.repartition(key, "_seg").sortWithinPartitions(key, "_seg", *order)


def group_starts(*columns) -> np.ndarray:
    """Positions at which any of the sorted Arrow columns changes, 0 included."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        values = c.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def array_of(table: pa.Table, name: str, fill=None) -> np.ndarray:
    """A column as a numpy array, times in microseconds; nulls as ``fill``."""
    column = table.column(name).combine_chunks()
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    if fill is not None and column.null_count:
        column = pc.fill_null(column, fill)
    return column.to_numpy(zero_copy_only=False)


def first_at(t: np.ndarray, low, high, value) -> np.ndarray:
    """First position in [low, high) whose ``t`` is at least ``value``, else high: one binary
    search for each entry, all at once. ``t`` ascends between ``low`` and ``high``."""
    low, high = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)
    while (low < high).any():
        mid = np.minimum((low + high) // 2, len(t) - 1)
        less = (low < high) & (t[mid] < value)
        high = np.where((low < high) & ~less, mid, high)
        low = np.where(less, mid + 1, low)
    return low


def _named(table: pa.Table, key: str, at: int) -> tuple:
    return table.column(key)[at].as_py(), table.column("_seg")[at].as_py()


def _starts(table: pa.Table, key: str) -> np.ndarray:
    return group_starts(table.column(key).combine_chunks(), table.column("_seg").combine_chunks())


def _replay(key: str, advance: Callable, close: Callable | None):
    def ended(states: pa.Table):  # states after a key's last row
        return close(states.filter(pc.equal(states.column("_seg"), states.column("_segs"))))

    def run(batches):
        held = carry = None
        for batch in batches:
            if not len(batch):
                continue
            tab = pa.Table.from_batches([batch])
            if carry is not None:
                if _named(tab, key, 0) == held:
                    tab = pa.concat_tables([carry, tab])
                elif close:
                    yield from ended(carry).to_batches()
            rows, states = advance(tab, _starts(tab, key))
            yield from rows.to_batches()
            if close and len(states) > 1:
                yield from ended(states.slice(0, len(states) - 1)).to_batches()
            held, carry = _named(tab, key, len(tab) - 1), states.slice(len(states) - 1)
        if carry is not None and close:
            yield from ended(carry).to_batches()
    return run


def _whole_groups(key: str, table: Callable, schema: pa.Schema):
    """``table(rows)`` for each (key, segment), which a task holds as a whole. Nothing follows a
    key's last segment, so that is only named."""
    def run(batches):
        held, parts = None, []
        for batch in batches:
            tab = pa.Table.from_batches([batch])
            starts = [*_starts(tab, key).tolist(), len(tab)]
            for a, b in zip(starts, starts[1:]):
                name = _named(tab, key, a)
                if name != held:
                    if parts:
                        yield from table(pa.concat_tables(parts), held).to_batches()
                    held, parts = name, []
                    last = name[1] == tab.column("_segs")[a].as_py()
                    if last:
                        yield from pa.Table.from_pylist(
                            [{key: name[0], "_seg": name[1], "piece": 0}], schema).to_batches()
                if not last:
                    parts.append(tab.slice(a, b - a))
        if parts:
            yield from table(pa.concat_tables(parts), held).to_batches()
    return run


def _looked_up(key: str, lookup: Callable, names: list[str]):
    """The state rows in front of a key's segments: ``lookup(state, table)`` is the state after
    a segment with that table; ``state`` is None before a key's first row."""
    def run(batches):
        held = state = schema = None
        pieces, out = [], []

        def after():
            table = pd.concat(pieces, ignore_index=True)
            if held[1] < 0:  # stored state
                return {c: table[c].iat[0] for c in names}
            return lookup(state, table)

        for batch in batches:
            tab = pa.Table.from_batches([batch])
            schema = pa.schema([tab.schema.field(c) for c in (key, "_seg", *names)])
            starts = [*_starts(tab, key).tolist(), len(tab)]
            for a, b in zip(starts, starts[1:]):
                name = _named(tab, key, a)
                if name != held:
                    state = after() if held is not None and held[0] == name[0] else None
                    pieces = []
                    held = name
                    if state is not None:
                        out.append({**{c: None if pd.isna(v) else v for c, v in state.items()},
                                    key: name[0], "_seg": name[1]})
                pieces.append(tab.slice(a, b - a).to_pandas(integer_object_nulls=True))
            if out:
                yield from pa.Table.from_pylist(out, schema).to_batches()
                out = []
    return run


def segmented_pass(df: DataFrame, key: str, order: list[str], *, schema: str, advance: Callable,
                   state_schema: str, table_schema: str, table: Callable, lookup: Callable,
                   stored: DataFrame | None = None, close: Callable | None = None,
                   parts: int | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``advance(rows, starts) -> (result, states)`` over each key's rows in ``order``. ``rows``
    is an Arrow table of whole runs of one or more (key, segment), from ``starts`` on, with the
    columns of ``df`` and of ``state_schema``. A run may begin with a state row: everything null
    but the key and the state. ``states`` holds one such row for each run, in the schema of
    ``rows``; ``close(states)`` makes result rows of the states after a key's last row.

    ``table(rows, (key, segment))`` is the transition table of one segment, in the columns key,
    ``_seg``, ``table_schema``; rows are kept in the order of ``piece``. ``lookup(state, table)``
    is the state after it, as a dict of the state's columns. ``stored`` holds state rows (key
    and state columns) that come before the rows of their keys."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields
             if f.name != key]
    kind = df.schema[key].dataType.simpleString()
    fields = [c.split() for c in state_schema.split(", ")]
    names = [n for n, _ in fields]
    no_state = [F.lit(None).cast(t).alias(n) for n, t in fields]
    cuts = Cuts(df, key, order, parts, segment_rows)
    columns = [key, *[c for c in df.columns if c != key], "_seg", "_segs"]
    of_tables = T.StructType.fromDDL(f"{key} {kind}, _seg int, {table_schema}")
    tables = _ordered(cuts.mark(df, "inner"), key, order).mapInArrow(
        _whole_groups(key, table, to_arrow_schema(of_tables)), of_tables)
    if stored is not None:  # the first state of a cut key comes before its first table
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in tables.schema.fields
                 if f.name not in (key, "_seg", *names)]
        tables = tables.unionByName(stored.join(F.broadcast(cuts.table.select(key)), key).select(
            key, F.lit(-1).alias("_seg"), *names, *blank))
    # Where the segments of a cut key begin; as few rows as there are cuts.
    states = materialize(
        tables.repartition(key).sortWithinPartitions(key, "_seg", "piece").mapInArrow(
            _looked_up(key, lookup, names), f"{key} {kind}, _seg int, {state_schema}"),
        "segment-states")
    begins = states.where("_seg > 0").join(
        F.broadcast(cuts.table.select(key, F.size("_cuts").alias("_segs"))), key)
    src = (cuts.mark(df).select(*columns, *no_state)
           .unionByName(begins.select(key, *empty, "_seg", "_segs", *names)))
    if stored is not None:
        first = stored.join(F.broadcast(cuts.table), key, "left").select(
            key, *empty, F.lit(0).alias("_seg"),
            F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts")).alias("_segs"), *names)
        src = src.unionByName(first)
    return _ordered(src, key, order).mapInArrow(_replay(key, advance, close), schema)
