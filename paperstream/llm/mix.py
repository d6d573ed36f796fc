"""Problem 7: a mix of sources in target shares by Pfair scheduling of source blocks.

The mix is a row of slots, each one block of `block_tokens`. A source of weight w is a periodic task: its j-th block
(from 0) is released at slot floor(j/w) and due by slot ceil((j+1)/w). In every slot the earliest deadline among the
released blocks goes first (ties: the later release, then the name), so after any slot each source is less than one block
from its exact share. Weights are exact fractions, so the schedule repeats after a common period: it is simulated from the
targets alone for one period, or for the whole mix where that is shorter, and is a table that blocks find their slot in by
an equi-join. Documents take their place in their source's stream by distributed running sums; nothing is gathered by source.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import ceil, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperstream.llm import bpe
from paperstream.llm.common import running_sums, stored

#: Tokens of one slot, and the most slots of a schedule: of larger mixes the blocks are larger, so each source is within a millionth of the mix of its share.
BLOCK_TOKENS, MOST_SLOTS = 8192, 1_000_000


def token_sizes(df: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("source",), vocabularies: str = bpe.VOCABULARIES) -> DataFrame:
    """(key, keep, n_tokens long): sizes of whole texts; null and empty texts have size 0. No shuffle."""
    columns = [key, *keep]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoding(vocabularies).encode_ordinary
        for batch in batches:
            sizes = [len(encode(bpe.clean(t))) if t else 0 for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*columns, "n_tokens"])

    return df.select(*columns, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, n_tokens bigint")


def pfair_slots(weights: dict[str, Fraction], most: int | None = None) -> list[str]:
    """The source of each slot of one period, or of its first `most` slots; weights sum to 1."""
    if not weights:
        return []
    period = lcm(*(w.denominator for w in weights.values()))
    given = dict.fromkeys(weights, 0)
    slots: list[str] = []
    release = lambda s: given[s] * weights[s].denominator // weights[s].numerator
    due = lambda s: -((-(given[s] + 1) * weights[s].denominator) // weights[s].numerator)
    # each source has one block that waits for its release or, released, for its turn
    waiting = [(0, s) for s in weights]
    ready: list[tuple[int, int, str]] = []
    heapify(waiting)
    for t in range(period if most is None else min(period, most)):
        while waiting and waiting[0][0] <= t:
            at, s = heappop(waiting)
            heappush(ready, (due(s), -at, s))
        _, _, chosen = heappop(ready)
        given[chosen] += 1
        heappush(waiting, (release(chosen), chosen))
        slots.append(chosen)
    return slots


def exact(share: float) -> Fraction:
    """The fraction a share is written as: 0.3 is three tenths."""
    return Fraction(repr(float(share)))


def plan_shares(supply: dict[str, int], targets: list[tuple[str, float | None, int | None]]) -> tuple[dict[str, Fraction], Fraction]:
    """(weight of each usable source, total size of the mix).

    Usable are sources with a positive target, at least one use and any tokens; their targets are scaled to 1. The total
    is the largest at which none of them is used more than its max_repeats allow. A source listed with two different
    targets or caps is an error.
    """
    usable: dict[str, tuple[Fraction, int]] = {}
    for source, share, repeats in sorted({t for t in targets if t[0] is not None and t[1] and 0 < t[1] < float("inf") and t[2] and t[2] > 0}):
        if source in usable:
            raise ValueError(f"{source!r} has more than one target")
        if supply.get(source, 0) > 0:
            usable[source] = (exact(share), repeats)
    whole = sum((v[0] for v in usable.values()), Fraction(0))
    weights = {s: v[0] / whole for s, v in usable.items()}
    total = min((Fraction(supply[s] * usable[s][1]) / w for s, w in weights.items()), default=Fraction(0))
    return weights, total


def _measured(documents: DataFrame, targets: DataFrame, vocabularies: str) -> tuple[DataFrame, dict, dict, Fraction, list]:
    """Placed documents of the listed sources and the plan. The targets table and the sums per listed source are the only rows the driver sees: one per row of mix_targets."""
    asked = [tuple(r) for r in targets.select("source", "target_share", "max_repeats").distinct().collect()]
    names = sorted({r[0] for r in asked if r[0] is not None})
    sized = stored(token_sizes(documents.where(F.col("source").isin(names)), vocabularies=vocabularies).where("n_tokens > 0"), "mix_sizes")
    order = F.xxhash64("doc_id")
    placed, totals = running_sums(sized.withColumn("place", order), ["source"], ["place", "doc_id"], "n_tokens", "mix_places")
    supply = {r["source"]: r["total"] for r in totals.collect()}
    weights, total = plan_shares(supply, asked)
    return placed, supply, weights, total, asked


def mix(documents: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, vocabularies: str = bpe.VOCABULARIES) -> DataFrame:
    """(slot, source, block, start, doc_id, repeat, n_tokens): the mix in order of slot, then start (the token offset in the source's stream).

    A source's stream is its documents in an order fixed by a hash of doc_id, over again for each repeat (counted from
    0, below max_repeats). A document belongs to the block in which it starts, and to the mix if it starts before the
    source's share of the total is full. Null and unlisted sources, listed sources without tokens, and texts of size 0
    have no part; without a usable source the mix is empty.
    """
    placed, supply, weights, total, asked = _measured(documents, targets, vocabularies)
    if not weights:
        return placed.where("false").select(F.lit(0).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("start"), "doc_id", F.lit(0).alias("repeat"), "n_tokens")
    repeats = {a[0]: a[2] for a in asked if a[0] in weights and a[1] and a[1] > 0 and a[2] and a[2] > 0}
    # one literal map per source, at most as many entries as mix_targets has rows
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("source")]
    block_tokens = max(block_tokens, ceil(total / MOST_SLOTS))
    quota = {s: ceil(w * total) for s, w in weights.items()}  # starts are whole numbers
    # a source's documents are repeated as often as its share needs, which is at most max_repeats
    needed = {s: max(1, min(repeats[s], -(-quota[s] // supply[s]))) for s in weights}
    slots, turn = slot_table(weights, ceil(total / block_tokens), {s: -(-quota[s] // block_tokens) for s in weights})
    used = placed.where(F.col("source").isin(list(weights))).withColumn("repeat", F.explode(F.sequence(F.lit(0), as_map(needed).cast("int") - 1)))
    used = used.withColumn("start", F.col("below") + F.col("repeat") * F.col("total")).where(F.col("start") < as_map(quota))
    used = used.withColumn("block", F.floor(F.col("start") / block_tokens))
    per_turn = as_map({s: max(1, n) for s, n in turn[1].items()})
    used = used.withColumns({"_turn": F.floor(F.col("block") / per_turn), "_own": F.col("block") % per_turn})
    table = placed.sparkSession.createDataFrame(slots)
    return used.join(table, ["source", "_own"]).select((F.col("_turn") * turn[0] + F.col("_slot")).alias("slot"), "source", "block", "start", "doc_id", "repeat", "n_tokens")


def slot_table(weights: dict[str, Fraction], total_slots: int, blocks: dict[str, int]) -> tuple[pa.Table, tuple[int, dict[str, int]]]:
    """(source, _own, _slot: the slot of a source's block within a turn; (slots of a turn, blocks of each source in a turn)).

    A turn is a period, after which all repeats, or the whole mix if that is shorter. Then each source's last block may
    not have had its slot yet; such blocks follow by their deadlines.
    """
    slots = pfair_slots(weights, total_slots)
    given = dict.fromkeys(weights, 0)
    rows: list[tuple[str, int, int]] = []
    for t, s in enumerate(slots):
        rows.append((s, given[s], t))
        given[s] += 1
    if len(slots) == total_slots and any(given[s] != weights[s] * total_slots for s in weights):
        left = sorted((ceil((j + 1) / weights[s]), s, j) for s in weights for j in range(given[s], blocks[s]))
        rows += [(s, j, len(slots) + i) for i, (_, s, j) in enumerate(left)]
        given = {s: max(given[s], blocks[s]) for s in weights}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    types = (pa.string(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["source", "_own", "_slot"]), (len(rows), given)


def kept(documents: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, vocabularies: str = bpe.VOCABULARIES) -> DataFrame:
    """(source, share_kept, repeats_kept) of every listed source with texts: whether the mix keeps what was asked - a share within two blocks or its longest document of the target, and no document more often than max_repeats."""
    made = stored(mix(documents, targets, block_tokens=block_tokens, vocabularies=vocabularies), "mix")
    block = F.greatest(F.lit(block_tokens), F.ceil(F.col("_all") / MOST_SLOTS))
    per = made.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    per = per.groupBy("source").agg(F.max("n").alias("n"), F.sum("tokens").alias("tokens"), F.max("longest").alias("longest"))
    asked = targets.select("source", "target_share", "max_repeats").distinct().join(per, "source")
    every = Window.partitionBy(F.lit(1))  # one row per listed source
    asked = asked.withColumns({"_all": F.sum("tokens").over(every), "_whole": F.sum("target_share").over(every)})
    off = F.abs(F.col("tokens") - F.col("target_share") / F.col("_whole") * F.col("_all"))
    return asked.select("source", (off <= 2 * F.greatest(block, "longest")).alias("share_kept"), (F.col("n") <= F.col("max_repeats")).alias("repeats_kept"))


def shares(documents: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, vocabularies: str = bpe.VOCABULARIES) -> DataFrame:
    """One row per listed source: (source, target_share, max_repeats, uses, documents, tokens, actual_share, deviation_blocks).

    uses: the most often one of its documents is used; deviation_blocks: distance from the target share, scaled to the
    sources that have documents, in blocks. A source without documents has zeros and null deviation.
    """
    made = stored(mix(documents, targets, block_tokens=block_tokens, vocabularies=vocabularies), "mix")
    per = made.groupBy("source").agg((F.max("repeat") + 1).alias("uses"), F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    whole = per.agg(F.sum("tokens").alias("_all"), F.collect_set("source").alias("_with"))  # one row, no more sources than listed
    asked = targets.select("source", "target_share", "max_repeats").distinct()
    report = asked.join(per, "source", "left").join(F.broadcast(whole))
    has = F.array_contains("_with", F.col("source"))
    scale = F.sum(F.when(has, F.col("target_share"))).over(Window.partitionBy(F.lit(1)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0))
    return report.select(
        "source", "target_share", "max_repeats", zero("uses"), zero("documents"), zero("tokens"),
        F.round(share, 6).alias("actual_share"),
        F.when(has, F.round((F.col("tokens") - F.col("target_share") / scale * F.col("_all")) / block_tokens, 4)).alias("deviation_blocks"),
    )
