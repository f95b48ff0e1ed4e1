"""Keyed stream stages with their own expiry: single-use nonces, idempotent requests, devices, and profiles that replay stored results.

Every stage is one `transformWithStateInPandas` in append mode and hands its event-time column on, so stages can follow each other in one
query. What has to be forgotten carries its own expiry, and a timer on the watermark frees it; profiles and device sets stay. State lies in
RocksDB. A task sees one key's rows of one micro-batch at a time, which the source's rate limit bounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from wardline.streaming import fold as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = 4  # identities kept per device: sharing is at its most from there on


def state_on_disk(spark: SparkSession) -> None:
    """Keep stream state in RocksDB beside the executor: identities ever seen may outgrow memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _stage(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, event_time: str | None) -> DataFrame:
    state_on_disk(rows.sparkSession)
    grouped = rows.groupBy(*keys)
    if event_time is None:
        return grouped.transformWithStateInPandas(processor, schema, "append", "none")
    return grouped.transformWithStateInPandas(processor, schema, "append", "eventtime", eventTimeColumnName=event_time)


def _sorted(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


class _Expiring(StatefulProcessor):
    """State that a timer on the watermark clears once its expiry has passed. Rows themselves compare with the expiry, so it
    does not matter for results when the timer fires."""

    def close(self) -> None:
        pass

    def expires(self, seconds: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(seconds * 1000) + 1)


class _Nonces(_Expiring):
    """One nonce: when the use that counts expires."""

    def __init__(self, order: list[str], at: str, exp: str, out: str):
        self.order, self.at, self.exp, self.out = order, at, exp, out

    def init(self, handle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows, self.order)
        until = self.until.get()[0] if self.until.exists() else None
        before, used = until, []
        for at, exp in zip(pdf[self.at].tolist(), pdf[self.exp].tolist()):
            again = until is not None and at <= until
            if not again and exp >= at:  # a token that has expired itself uses nothing up
                until = exp
            used.append(int(again))
        if until != before:
            self.until.update((until,))
            self.expires(until)
        yield pdf.assign(**{self.out: used})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter([])


def nonce_stage(stream: DataFrame, nonce: str, event_time: str, at: str, exp: str, row_id: str, out: str = "replayed") -> DataFrame:
    """Add ``out`` to a stream with a watermark on ``event_time``: 1 where the row's nonce was used before and that use has not expired, else 0.

    ``at`` and ``exp`` are seconds since 1970: the row's time and its record's own expiry, until which the nonce is kept. After it the
    nonce may be used anew. Rows must have a nonce; rows of one micro-batch count in order of (at, row_id).
    """
    schema = f"{_ddl(stream.schema)}, `{out}` int"
    return _stage(stream, [nonce], _Nonces([at, row_id], at, exp, out), schema, event_time)


class _Requests(_Expiring):
    """One (caller, key): the fingerprint of its first request and until when it counts."""

    def __init__(self, order: list[str], fingerprint: str, at: str, keep: float):
        self.order, self.fingerprint, self.at, self.keep = order, fingerprint, at, keep

    def init(self, handle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "fingerprint string, until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows, self.order)
        first = tuple(self.first.get()) if self.first.exists() else None
        before, status = first, []
        for at, body in zip(pdf[self.at].tolist(), pdf[self.fingerprint].tolist()):
            if first is None or at > first[1]:
                first = (body, at + self.keep)
                status.append("first")
            else:
                status.append("replay" if body == first[0] else "conflict")
        if first != before:
            self.first.update(first)
            self.expires(first[1])
        yield pdf.assign(request=status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter([])


def request_stage(stream: DataFrame, caller: str, key: str, fingerprint: str, event_time: str, at: str, row_id: str, keep: float) -> DataFrame:
    """Add ``request`` to a stream of requests that all have a key: first, replay (the same fingerprint again within ``keep`` seconds of the
    first) or conflict (another one). After that time the key is free again."""
    return _stage(stream, [caller, key], _Requests([at, row_id], fingerprint, at, keep), f"{_ddl(stream.schema)}, request string", event_time)


class _Devices(StatefulProcessor):
    """One device: the identities that used it, as far as they matter."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "identities array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows, ["ts", "event_id"])
        known = list(self.known.get()[0]) if self.known.exists() else []
        before, share = len(known), []
        scored = ~pdf["request"].isin(["replay", "conflict"]) if "request" in pdf else pd.Series(True, pdf.index)
        for who, counts in zip(pdf["identity_id"], scored):
            if counts and len(known) < SEEN and who not in known:
                known.append(who)
            share.append(min(max(len(known) - 1, 0) / (SEEN - 1), 1.0))
        if len(known) > before:
            self.known.update((known,))
        yield pdf.assign(device_sharing=share)

    def close(self) -> None:
        pass


def device_stage(stream: DataFrame, event_time: str | None = None) -> DataFrame:
    """Add ``device_sharing`` per event, keyed by device. The state is at most four identities per device. Replayed and conflicting requests
    (column ``request``, if there is one) do not use a device."""
    return _stage(stream, ["device_id"], _Devices(), f"{_ddl(stream.schema)}, device_sharing double", event_time)


NAMES = [f.split()[0] for f in T.RESULT.split(", ")]
ANSWER = f"{T.RESULT}, request string"


class _Profiles(StatefulProcessor):
    """One identity: its profile, and the results of keyed requests until they expire."""

    def __init__(self, params: T.Params):
        self.params = params

    def init(self, handle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", "profile string")
        self.results = handle.getMapState("results", "request_key string", "until double, result string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows, ["ts", "kind", "event_id"])
        s = T.State.load(self.profile.get()[0]) if self.profile.exists() else T.State()
        out = []
        for row in pdf.itertuples(index=False):
            request = getattr(row, "request", None)
            if row.kind == 2:
                T.settle(s, bool(row.passed))
            elif request == "replay":
                out.append(self.replayed(row))
            elif request == "conflict":
                out.append((*self.bare(row), "conflict"))
            else:
                on_time = row.ts_seconds >= s.last_ts
                result = T.advance(s, row, self.params) if on_time else T.late(s, row)
                s.last_ts = max(s.last_ts, row.ts_seconds)
                if request == "first":
                    self.keep(row, result)
                out.append((*result, "scored"))
        self.profile.update((s.dump(),))
        yield pd.DataFrame.from_records(out, columns=[*NAMES, "request"])

    def bare(self, row) -> tuple:
        return tuple(getattr(row, n) if n in ("event_id", "identity_id", "ts", "event_type", "geo", "amount") else None for n in NAMES)

    def keep(self, row, result: tuple) -> None:
        plain = {n: v for n, v in zip(NAMES, result) if n not in ("event_id", "identity_id", "ts")}
        self.results.updateValue((row.request_key,), (row.request_until, json.dumps(plain)))
        self.handle.registerTimer(int(row.request_until * 1000) + 1)

    def replayed(self, row) -> tuple:
        """The stored result under the new event's id and time; nothing is scored again. A result that came late or is gone is null."""
        kept = self.results.getValue((row.request_key,)) if self.results.containsKey((row.request_key,)) else None
        plain = json.loads(kept[1]) if kept is not None else {}
        return (*(getattr(row, n) if n in ("event_id", "identity_id", "ts") else plain.get(n) for n in NAMES), "replay")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000.0
        gone = [tuple(k) for k, v in self.results.iterator() if v[0] <= now]
        for k in gone:
            self.results.removeKey(k)
        return iter([])

    def close(self) -> None:
        pass


def trust_stream(rows: DataFrame, params: T.Params = T.Params(), event_time: str | None = None) -> DataFrame:
    """Streaming trust decisions over prepared rows (events and outcomes); late events come out as LATE.

    With columns request, request_key and request_until (see `request_stage`) the first result of a key is kept and given back to its
    replays; ``request`` says scored, replay or conflict.
    """
    return _stage(rows, ["identity_id"], _Profiles(params), ANSWER, event_time)
