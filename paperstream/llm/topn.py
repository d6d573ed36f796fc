"""Problem 2: the N best items of every group by a merge of sorted runs.

Scan tasks cut their rows into runs of bounded size, order each run by (group, rank) and keep a group's first N distinct
items of the run: a group of any size leaves at most N rows a run, so no key can grow hot. Runs are hashed into buckets by
group; the shuffle's files are the stored bucketed runs. A bucket's task merges its runs with a loser tree and, as soon as
N items of a group are out, moves every run that stands in this group to its next group without looking at the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperstream.llm.common import bucket_count

#: Rows of one sorted run in a scan task.
RUN_ROWS = 500_000


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers in the order of the values; null first. Equal values have equal numbers."""
    filled = column.combine_chunks()
    coded = pc.dictionary_encode(filled)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = np.empty(len(coded.dictionary) + 1, np.int64)
    order[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(coded.dictionary) + 1)
    order[-1] = 0
    return order[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy()]


def _keys(rows: pa.Table, groups: list[str], score: str, line: str, seq: str) -> tuple[np.ndarray, ...]:
    """Columns to compare, ascending: group, -score, line (null last), seq (null last)."""
    group = np.zeros(rows.num_rows, np.int64)
    for g in groups:
        codes = _codes(rows.column(g))
        group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1].astype(np.int64)
    last = np.iinfo(np.int64).max
    whole = lambda c: pc.fill_null(rows.column(c).cast(pa.int64()), last).to_numpy()
    return group, -rows.column(score).to_numpy() + 0.0, whole(line), whole(seq)


def _same(keys: tuple[np.ndarray, ...], at: int = 0) -> np.ndarray:
    """Whether each row equals the one before in keys[at:]."""
    out = np.zeros(len(keys[0]), bool)
    out[1:] = True
    for k in keys[at:]:
        out[1:] &= k[1:] == k[:-1]
    return out


def _run(rows: pa.Table, n: int, spec: tuple) -> pa.Table:
    """One sorted run with each group's first n distinct items."""
    keys = _keys(rows, *spec)
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    fresh = ~_same(keys)
    order, group = order[fresh], keys[0][fresh]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.array([], int)
    nth = np.arange(len(group)) - np.repeat(starts, np.diff([*starts, len(group)]))
    return rows.take(pa.array(order[nth < n]))


class LoserTree:
    """Tournament of run heads: the inner nodes hold losers, node 0 the winner; replacing the winner's head costs one path."""

    def __init__(self, heads: list[tuple | None]):
        self.k, self.heads = len(heads), heads
        self.node = [-1] * max(1, self.k)
        for run in range(self.k):
            self._climb(run, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _climb(self, run: int, building: bool = False) -> None:
        at, node = (run + self.k) // 2, self.node
        while at:
            other = node[at]
            if other < 0:
                if building:
                    node[at] = run
                    return
            elif self._before(other, run):
                node[at], run = run, other
            at //= 2
        node[0] = run

    def winner(self) -> int:
        return self.node[0]

    def replace(self, run: int, head: tuple | None) -> None:
        self.heads[run] = head
        self._climb(run)

    def rebuild(self) -> None:
        self.node = [-1] * max(1, self.k)
        for run in range(self.k):
            self._climb(run, building=True)


def merge_runs(keys: tuple[np.ndarray, ...], n: int) -> list[int]:
    """Row numbers of the first n distinct items of each group. The rows lie in natural runs: a run ends where the order breaks."""
    size = len(keys[0])
    if not size:
        return []
    less = np.zeros(size, bool)  # row < row before
    tie = np.ones(size - 1, bool)
    for k in keys:
        less[1:] |= tie & (k[1:] < k[:-1])
        tie &= k[1:] == k[:-1]
    bounds = [0, *np.flatnonzero(less).tolist(), size]
    new_group = np.r_[keys[0][1:] != keys[0][:-1], True]
    # the row after the last of this row's group within its run
    breaks = np.flatnonzero(new_group | np.r_[less[1:], True]) + 1
    following = breaks[np.searchsorted(breaks, np.arange(size), side="right")].tolist()
    rows = list(zip(*(k.tolist() for k in keys), strict=True))
    at, ends = bounds[:-1], bounds[1:]
    tree = LoserTree([rows[a] for a in at])
    out: list[int] = []
    group, taken, last = None, 0, None
    while (head := tree.heads[run := tree.winner()]) is not None:
        here = at[run]
        if head[0] != group:
            group, taken, last = head[0], 0, None
        if taken < n and head != last:
            out.append(here)
            taken, last = taken + 1, head
        at[run] = here = following[here] if taken >= n else here + 1
        tree.replace(run, rows[here] if here < ends[run] else None)
    return out


def top_n(df: DataFrame, n: int = 3, *, groups: tuple[str, ...] = ("doc_id", "field"), score: str = "confidence", line: str = "line_index", seq: str = "gen_seq", buckets: int | None = None) -> DataFrame:
    """(groups, seq, rank): per group the n items of highest score; ties by line ascending (null last), then seq ascending (null last).

    Null and NaN scores never count. A null in a group column is a group of its own. Rows equal in group, score, line and
    seq are one item. Groups with fewer than n items give fewer rows, an empty table gives none. Other columns are
    never read, whatever their names.
    """
    kinds = {c: df.schema[c].dataType for c in (*groups, line, seq)}
    taken = df.select(*groups, F.col(score).cast("double").alias("_score"), F.col(line).alias("_line"), F.col(seq).alias("_seq")).where(F.col("_score").isNotNull() & ~F.isnan("_score"))
    spec = (list(groups), "_score", "_line", "_seq")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= RUN_ROWS:
                yield from _run(pa.Table.from_batches(held), n, spec).combine_chunks().to_batches()
                held, count = [], 0
        if count:
            yield from _run(pa.Table.from_batches(held), n, spec).combine_chunks().to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        keys = _keys(rows, *spec)
        picked = merge_runs(keys, n)
        group = keys[0][picked]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        rank = (np.arange(len(group)) - np.repeat(starts, np.diff([*starts, len(group)])) + 1).astype(np.int32)
        out = rows.select([*groups, "_seq"]).take(pa.array(picked)).append_column("rank", pa.array(rank))
        yield from out.rename_columns([*groups, seq, "rank"]).combine_chunks().to_batches()

    schema = T.StructType([*(T.StructField(g, kinds[g]) for g in groups), T.StructField(seq, kinds[seq]), T.StructField("rank", T.IntegerType())])
    stored_runs = taken.mapInArrow(runs, taken.schema).repartition(buckets or bucket_count(df), *groups)
    return stored_runs.mapInArrow(merge, schema)
