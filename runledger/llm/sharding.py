"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import own_names


def _preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of the order in which a shard wants the slots; any step serves as ``slots`` is prime."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = 65_537) -> list[int]:
    """The shard index of every slot: shards take turns, each claiming the first free slot of its own order.

    ``slots`` must be prime and no smaller than the number of shards; the table depends on these parameters
    alone, never on data. Removing a shard moves few slots besides its own.
    """
    if slots < max(2, len(shards)) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number no smaller than the number of shards")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, one at least")
    orders = [_preference(s, slots) for s in shards]
    table, tried, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, (offset, step) in enumerate(orders[:left]):
            while table[slot := (offset + tried[i] * step) % slots] >= 0:
                tried[i] += 1
            table[slot] = i
            left -= 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text form, modulo ``slots``; a null key counts as the empty text."""
    name = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = 65_537) -> DataFrame:
    """The rows of ``df`` with their ``slot`` and ``shard``, by one broadcast join with the lookup table.

    The table has ``slots`` rows of some 30 bytes whatever the data (about 2 MB at the default), which is the bound
    on what is broadcast. Nothing is shuffled: rows of a hot key stay where they are. Columns of ``df`` named
    ``slot`` or ``shard`` are replaced. Equal keys share a shard, null keys included; an empty table stays empty.
    """
    filled = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    key_slot, at, shard = own_names(df, "_key_slot", "_slot", "_shard")
    lookup = (
        df.sparkSession.range(1)
        .select(F.posexplode(F.split(F.lit(filled), ",")).alias("_at", "_index"))
        .select(F.col("_at").cast("long").alias(at), F.element_at(names, F.col("_index").cast("int") + 1).alias(shard))
    )
    rest = [F.col(c) for c in df.columns if c not in ("slot", "shard")]
    placed = df.select("*", slot_of(F.col(key), slots).alias(key_slot))
    return placed.join(F.broadcast(lookup), F.col(key_slot) == F.col(at), "left").select(
        *rest, F.col(key_slot).alias("slot"), F.col(shard).alias("shard")
    )
