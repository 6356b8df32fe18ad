"""Rows of groups that meet over lists of near vectors.

A vector's candidates travel as one row, packed, to every vector that lists it, and so do the anchors of a vector. A task
takes many vectors at a time and finds the best candidates of their anchors in one sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from veritrace.operators.streamed import MISSING, NAN

#: Anchors of one vector that go together at most, about.
PIECE = 8192
#: Packed rows that are looked at together, about; a vector's stay together.
ENTRIES = 200_000


def _known(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers or objects that tell the values apart in their order, and which are null."""
    null = values.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(values.type):
        return pc.fill_null(values, 0).to_numpy(zero_copy_only=False), null
    told = values.to_numpy(zero_copy_only=False)
    out = np.zeros(len(told), dtype=np.int64)
    out[~null] = np.unique(told[~null], return_inverse=True)[1]
    return out, null


def _unpacked(table: pa.Table) -> tuple[np.ndarray, pa.StructArray]:
    """The row number of each packed entry, and the entries."""
    column = table["entries"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy()), column.flatten()


def _met(table: pa.Table, k: int, listed: int, schema: pa.Schema) -> pa.RecordBatch:
    """The anchors of whole pieces, sorted by vector, piece and place, with what they find."""
    vid, piece, place = (table[c].to_numpy() for c in ("vid", "piece", "place"))
    slot = np.cumsum(np.concatenate([[True], (np.diff(vid) != 0) | (np.diff(piece) != 0)])) - 1
    distance = table["distance"].combine_chunks()
    null = distance.is_null().to_numpy(zero_copy_only=False)
    distance = pc.fill_null(distance, 0.0).to_numpy(zero_copy_only=False)
    distance = np.where(null, MISSING, np.where(np.isnan(distance), NAN, distance))
    # Vectors beyond a list may be as far as its last.
    limit = np.full(slot[-1] + 1, np.inf)
    last = place == listed
    limit[slot[last]] = distance[last]
    sure = (place > 0) & (distance < limit[slot])
    ask_row, ask = _unpacked(table.filter(pa.array(place == 0)))
    row, entry = _unpacked(table.filter(pa.array(sure)))
    n, gid = len(ask), pc.struct_field(ask, "gid").to_numpy()
    ask_slot = slot[place == 0][ask_row]
    width = int(max(gid.max(initial=0), pc.max(pc.struct_field(entry, "gid")).as_py() or 0)) + 1
    wanted, want = np.unique(ask_slot * width + gid, return_inverse=True)
    key = slot[sure][row] * width + pc.struct_field(entry, "gid").to_numpy()
    spot = np.minimum(np.searchsorted(wanted, key), max(len(wanted) - 1, 0))
    asked = np.flatnonzero(wanted[spot] == key) if len(wanted) else np.zeros(0, dtype=np.int64)
    spot, far, entry = spot[asked], distance[sure][row[asked]], entry.take(pa.array(asked))
    order = np.lexsort((_known(pc.struct_field(entry, "id"))[0], far, spot))
    spot, far, entry = spot[order], far[order], entry.take(pa.array(order))
    both, gone = _known(pa.concat_arrays([pc.struct_field(ask, "owner"), pc.struct_field(entry, "owner")]))
    starts, ends = np.searchsorted(spot, np.arange(len(wanted))), np.searchsorted(spot, np.arange(len(wanted)), side="right")
    at = starts[want][:, None] + np.arange(4 * k)
    there = at < ends[want][:, None]
    at = np.minimum(at, max(len(spot) - 1, 0))
    if len(spot):
        there &= (both[n:][at] != both[:n, None]) | (gone[n:][at] != gone[:n, None])
        there &= np.cumsum(there, axis=1) <= k
    picked = at[there]
    found = pa.StructArray.from_arrays(
        [pc.struct_field(entry, "id").take(pa.array(picked)), _distances(far[picked])], fields=list(schema.field("found").type.value_type)
    )
    offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    columns = [pc.struct_field(ask, "id"), pc.struct_field(ask, "owner"), ask_slot, pc.struct_field(ask, "gid"), pa.ListArray.from_arrays(pa.array(offsets), found, type=schema.field("found").type)]
    first = np.searchsorted(slot, np.arange(slot[-1] + 1))
    columns[2] = pa.array(vid[first][ask_slot])
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _distances(far: np.ndarray) -> pa.Array:
    return pa.array(np.where(far == NAN, np.nan, far), pa.float64(), mask=far == MISSING)


def _pieces(batches: Iterator[pa.RecordBatch], k: int, listed: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    schema, at, size = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if schema is None:
            fields = {f.name: f.type for f in batch.schema.field("entries").type.value_type}
            found = pa.list_(pa.struct([("candidate_id", fields["id"]), ("distance", pa.float64())]))
            schema = pa.schema([("anchor_id", fields["id"]), ("owner", fields["owner"]), ("vid", pa.int64()), ("gid", pa.int64()), ("found", found)])
        vid, piece = batch["vid"].to_numpy(), batch["piece"].to_numpy()
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (np.diff(vid) != 0) | (np.diff(piece) != 0)
        new[0] = (vid[0], piece[0]) != at
        at = (vid[-1], piece[-1])
        sizes = np.cumsum(pc.list_value_length(batch["entries"]).to_numpy())
        start, base = 0, 0
        for cut in np.flatnonzero(new):
            if size + (sizes[cut - 1] if cut else 0) - base >= ENTRIES and (held or cut > start):
                rows = [*held, *([batch.slice(start, cut - start)] if cut > start else [])]
                yield _met(pa.Table.from_batches(rows), k, listed, schema)
                held, start, size, base = [], cut, 0, sizes[cut - 1] if cut else 0
        held.append(batch.slice(start))
        size += int(sizes[-1] - base)
    if held:
        yield _met(pa.Table.from_batches(held), k, listed, schema)


def met_over_lists(asks: DataFrame, near: DataFrame, offers: DataFrame, k: int, listed: int) -> DataFrame:
    """Each of ``asks`` (anchor_id, owner, vid, gid) with ``found``, its nearest ``k`` candidates (candidate_id, distance)
    of its group and of other owners, over the first ``listed`` of its vector's list; fewer if those of its first ``4 * k`` are.

    ``near``: vid, cvid, distance, place. ``offers``: gid, cvid, candidate_id, c_owner."""
    spark = asks.sparkSession
    kind = {c: asks.schema[c].dataType.simpleString() for c in ("anchor_id", "owner")}
    pack = lambda i, o: F.collect_list(F.struct("gid", F.col(i).alias("id"), F.col(o).alias("owner"))).alias("entries")
    # The anchors of a common vector go in pieces.
    common = asks.groupBy("vid").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")).filter("pieces > 1")
    number = F.coalesce("pieces", F.lit(1))
    dealt = asks.join(common, "vid", "left").withColumn("piece", F.pmod(F.hash("anchor_id"), number))
    asked = dealt.groupBy("vid", "piece").agg(pack("anchor_id", "owner")).select("vid", "piece", F.lit(0).alias("place"), F.lit(None).cast("double").alias("distance"), "entries")
    packed = offers.groupBy("cvid").agg(pack("candidate_id", "c_owner"))
    met = near.filter(F.col("place") <= listed).join(packed, "cvid").join(common, "vid", "left")
    met = met.withColumn("piece", F.explode(F.sequence(F.lit(0), number - 1)))
    rows = asked.union(met.select("vid", "piece", F.col("place").cast("int"), "distance", "entries"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "vid", "piece").sortWithinPartitions("vid", "piece", "place")
    return rows.mapInArrow(
        lambda it: _pieces(it, k, listed),
        f"anchor_id {kind['anchor_id']}, owner {kind['owner']}, vid long, gid long, found array<struct<candidate_id: {kind['anchor_id']}, distance: double>>",
    )
