"""State processors: rows taken in order of event time, open commits, known keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from runledger.schemas import EDGES

CHUNK = 10_000  # rows handed on at once


def _frames(rows: Iterator[tuple], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == CHUNK:
            yield pd.DataFrame(held, columns=list(columns), dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=list(columns), dtype=object)


class InOrder(StatefulProcessor):
    """Rows of a key wait as state until the watermark passes their time, and are then taken in order.

    Input has ``ms``, the row's time in milliseconds, and ``columns``, whose order is the order of rows. A row at or behind the watermark when
    it comes is late. Waiting rows are one list entry each, written once; rows of a key and a release are sorted in
    memory. One timer a key stands at its earliest waiting row.
    """

    output: Sequence[str] = ()

    def __init__(self, columns: Sequence[str], schema: str) -> None:
        self._columns, self._schema = list(columns), schema

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", f"ms long, {self._schema}")
        self._timer = handle.getValueState("timer", "at long")

    def _alarm(self, at: int | None) -> None:
        now = self._timer.get()[0] if self._timer.exists() else None
        if at is None or at == now or (now is not None and now < at):
            return
        if now is not None:
            self._handle.deleteTimer(now)
        self._timer.update((at,))
        self._handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        mark, least = timers.getCurrentWatermarkInMs(), None
        for frame in rows:
            frame = frame[["ms", *self._columns]].astype(object).where(lambda f: f.notna(), None)
            late = frame[[m <= mark for m in frame["ms"]]]
            if len(late):
                yield from _frames((self.late(key, r[1:]) for r in late.itertuples(index=False, name=None)), self.output)
            ahead = list(frame[[m > mark for m in frame["ms"]]].itertuples(index=False, name=None))
            if ahead:
                self._waiting.appendList(ahead)
                first = min(r[0] for r in ahead)
                least = first if least is None else min(least, first)
        self._alarm(least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self._waiting.get(), key=lambda r: r[0])
        ready = [r[1:] for r in rows if r[0] <= mark]
        rest = [tuple(r) for r in rows if r[0] > mark]
        self._waiting.put(rest) if rest else self._waiting.clear()
        self._timer.clear()
        self._alarm(rest[0][0] if rest else None)
        if ready:
            yield from _frames(self.take(key, sorted(map(tuple, ready), key=self.place)), self.output)

    def place(self, row: tuple):
        return row[0]

    def late(self, key, row: tuple) -> tuple:
        raise NotImplementedError

    def take(self, key, rows: list[tuple]) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class ReplayProcessor(InOrder):
    """Run state kept per run; requests are taken by (ts, seq). Rows are (us, seq, to_state)."""

    output = ("run_id", "seq", "from_state", "to_state", "accepted", "late")

    def init(self, handle) -> None:
        super().init(handle)
        self._state = handle.getValueState("state", "state string")
        self._edges = set(EDGES)

    def place(self, row: tuple):
        return row[0], row[1]

    def late(self, key, row: tuple) -> tuple:
        return key[0], row[1], None, row[2], None, True

    def take(self, key, rows: list[tuple]) -> Iterator[tuple]:
        now = self._state.get()[0] if self._state.exists() else "CREATED"
        for _, seq, target in rows:
            ok = (now, target) in self._edges
            yield key[0], seq, now, target, ok, False
            now = target if ok else now
        self._state.update((now,))


class HoldProcessor(InOrder):
    """Since when a rule's condition has been true without a break, per rule and label set. Rows are (us, value, cond, hold_s)."""

    output = ("rule", "labels", "us", "value", "cond", "since", "state", "late")

    def __init__(self, columns: Sequence[str], schema: str, step_us: int) -> None:
        super().__init__(columns, schema)
        self._step = step_us

    def init(self, handle) -> None:
        super().init(handle)
        self._held = handle.getValueState("held", "since long, last long")

    def late(self, key, row: tuple) -> tuple:
        return key[0], key[1], row[0], row[1], row[2], None, None, True

    def take(self, key, rows: list[tuple]) -> Iterator[tuple]:
        since, last = self._held.get() if self._held.exists() else (None, None)
        for at, value, cond, hold_s in rows:
            if not cond:
                since = None
            elif since is None or at - last > self._step:
                since = at
            last = at
            firing = since is not None and at - since >= hold_s * 1_000_000
            yield key[0], key[1], at, value, cond, since, "inactive" if since is None else "firing" if firing else "pending", False
        self._held.update((since, last))


class CommitProcessor(StatefulProcessor):
    """Open and committed checkpoints of one bucket; what is kept of one ends ``keep_ms`` after the batch of its last upload.

    A checkpoint has one row in ``held``; the shards of an open one have a row each, and their names a row per batch that brought new ones.
    One whose shards all come in one batch costs a look-up and an entry, or the entry alone while the bucket holds nothing. A timer a
    bucket and batch stands for all checkpoints of that batch; those met again since are passed over when it rings.
    Input has the numbers of an upload with 0 for unknown ones, and ``unknown``, a bit for each (``CommitProcessor.NUMBERS``).
    """

    NUMBERS = ("at", "rank", "part_no", "host_no", "size_bytes", "checkpoint_id")

    def __init__(self, keep_ms: int) -> None:
        self._keep = keep_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._held = handle.getMapState("held", "checkpoint_id long", "until long, n long, parts long, done boolean")
        self._names = handle.getMapState("names", "checkpoint_id long, part long", "shard_ids array<string>")
        self._shards = handle.getMapState("shards", "checkpoint_id long, shard_id string", "at long, rank long, part_no long, host_no long, size_bytes long")
        self._due = handle.getMapState("due", "until long", "checkpoint_ids array<long>")

    def _uploads(self, frame: pd.DataFrame) -> Iterator[tuple]:
        """(checkpoint, shard, need, (at, rank, part, host, size)) of each row, null where unknown."""
        numbers = [frame[c].tolist() for c in self.NUMBERS]
        for shard, need, unknown, *values in zip(frame["shard_id"].tolist(), frame["need"].tolist(), frame["unknown"].tolist(), *numbers):
            if unknown:
                values = [None if unknown >> i & 1 else v for i, v in enumerate(values)]
            *upload, checkpoint = values
            yield checkpoint, shard, need, tuple(upload)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        empty, now = not self._held.exists(), 0
        met: dict[int | None, tuple] = {}  # of each checkpoint of the batch: what is held, its uploads, and how many it needs
        for frame in rows:
            now = max(now, int(frame["ms"].max()))
            for checkpoint, shard, wanted, upload in self._uploads(frame):
                seen = met.get(checkpoint)
                if seen is None:
                    _, n, parts, done = (None if empty else self._held.getValue((checkpoint,))) or (0, 0, 0, False)
                    seen = met[checkpoint] = ((n, parts, done), [] if done else {}, [1])
                (*_, done), uploads, need = seen
                if done:
                    uploads.append(shard)
                    continue
                need[0] = max(need[0], wanted)
                if shard not in uploads or _order(upload) < _order(uploads[shard]):
                    uploads[shard] = upload
        until = now + self._keep
        yield from _frames((r for c, seen in met.items() for r in self._settle(c, until, *seen)), COMMIT_COLUMNS)
        earlier = self._due.getValue((until,))
        self._due.updateValue((until,), ([*(earlier[0] if earlier else []), *met],))
        self._handle.registerTimer(until)

    def _settle(self, checkpoint, until: int, held: tuple, uploads, need: list[int]) -> Iterator[tuple]:
        """Rows that the batch's uploads of a checkpoint give; what is kept of it is brought up to date."""
        n, parts, done = held
        if done:
            for shard in uploads:
                yield "late", checkpoint, None, None, None, shard
        else:
            known = {s: self._shards.getValue((checkpoint, s)) for s in uploads} if n else {}
            better = {s: u for s, u in uploads.items() if not known.get(s) or _order(u) < _order(tuple(known[s]))}
            fresh = [s for s in better if not known.get(s)]
            n += len(fresh)
            if n >= need[0]:
                sizes = {**dict(self._take(checkpoint, parts)), **{s: u[-1] for s, u in better.items()}}
                listed = sorted(sizes.items(), key=lambda i: (i[0] is not None, i[0] or ""))
                text = ",".join(":".join(str(x) for x in i if x is not None) for i in listed)
                yield "manifest", checkpoint, n, sum(z for z in sizes.values() if z is not None), text, None
                n, parts, done = 0, 0, True
            else:
                for shard, upload in better.items():
                    self._shards.updateValue((checkpoint, shard), upload)
                if fresh:
                    self._names.updateValue((checkpoint, parts), (fresh,))
                    parts += 1
        self._held.updateValue((checkpoint,), (until, n, parts, done))

    def _take(self, checkpoint, parts: int) -> Iterator[tuple]:
        """(shard, size) of each shard held of a checkpoint, which are then held no longer."""
        for part in range(parts):
            for shard in self._names.getValue((checkpoint, part))[0]:
                yield shard, self._shards.getValue((checkpoint, shard))[-1]
                self._shards.removeKey((checkpoint, shard))
            self._names.removeKey((checkpoint, part))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from _frames(self._expire(expiredTimerInfo.getExpiryTimeInMs()), COMMIT_COLUMNS)

    def _expire(self, at: int) -> Iterator[tuple]:
        for checkpoint in (self._due.getValue((at,)) or ([],))[0]:
            until, _, parts, _ = self._held.getValue((checkpoint,)) or (None, 0, 0, False)
            if until is None or until > at:
                continue
            for shard, _ in self._take(checkpoint, parts):
                yield "open", checkpoint, None, None, None, shard
            self._held.removeKey((checkpoint,))
        self._due.removeKey((at,))

    def close(self) -> None:
        pass


COMMIT_COLUMNS = ("kind", "checkpoint_id", "num_shards", "total_bytes", "listed", "shard_id")


def _order(upload: tuple) -> tuple:
    """Uploads by time, then rank, part, host; unknown values first."""
    return tuple((v is not None, v if v is not None else 0) for v in upload)


class KnownProcessor(StatefulProcessor):
    """Keys met in the last ``keep_ms``, by the times of batches."""

    def __init__(self, keep_ms: int) -> None:
        self._keep = keep_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        fresh, now = not self._until.exists(), 0
        for frame in rows:
            now = max(now, int(frame["ms"].max()))
            yield pd.DataFrame({"key": key[0], "sidecar": frame["sidecar"].unique(), "fresh": fresh})
        if not fresh:
            self._handle.deleteTimer(self._until.get()[0])
        self._until.update((now + self._keep,))
        self._handle.registerTimer(now + self._keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._until.clear()
        return iter(())

    def close(self) -> None:
        pass
