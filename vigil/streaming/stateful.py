"""Stateful streaming operators: the flow meter, and triggers over anchored or gap-closed windows of one key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.functions.net import probable_reply
from vigil.operators.flowmeter import RECORD, Conversation, keyed
from vigil.params import TCP, FlowMeter, Scan

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class MeterProcessor(StatefulProcessor):
    """Conversations of the flow meter; an event-time timer ends one after its timeout."""

    def __init__(self, p: FlowMeter = FlowMeter()):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("conversation", "state string")

    def _load(self) -> Conversation | None:
        got = self.held.get()
        return Conversation(**json.loads(got[0])) if got is not None else None

    def _save(self, c: Conversation) -> None:
        self.held.update((json.dumps(c.__dict__),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((c.last_ts + c.timeout(self.p)) * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packets = pd.concat(list(rows)).sort_values(["ts"], kind="stable")
        now, out = self._load(), []
        for x in packets.itertuples():
            if now and x.ts - now.last_ts >= now.timeout(self.p):
                out.append(now.export(True))
                now = None
            if now is None:
                now = Conversation(x.src_ip, x.dst_ip, int(x.src_port), int(x.dst_port), int(x.proto), x.ts, x.ts, x.ts)
            out += now.add(x.ts, x.src_ip, int(x.src_port), int(x.ip_len), int(x.ttl), int(x.tcp_flags), bytes(x.payload or b""), self.p)
        if now:
            self._save(now)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._load()
        if now is not None:
            self.held.clear()
            yield pd.DataFrame([now.export(True)])

    def close(self) -> None:
        pass


def meter_stream(packets: DataFrame, p: FlowMeter = FlowMeter(), late: str = "30 seconds") -> DataFrame:
    """Flow records of a stream of packets; the watermark lies above the idle time, so idle exports aren't late."""
    rows = keyed(packets).withColumn("event_time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))).withWatermark("event_time", late)
    return rows.groupBy("key").transformWithStateInPandas(MeterProcessor(p), RECORD, "Append", "EventTime")


SCAN_FIRING = "src_ip string, n long, score double, failed long, first_ts double, last_ts double"


class ScanProcessor(StatefulProcessor):
    """Threshold random walk of one source: targets, walk and trigger of its open session."""

    def __init__(self, p: Scan = Scan()):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", "first double, last double, score double, n long, failed long, next long")
        self.targets = handle.getMapState("targets", "dst_ip string, dst_port int", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p, out = self.p, []
        flows = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state = self.walk.get()
        first, last, score, n, failed, limit = state if state is not None else (None, None, 0.0, 0, 0, p.targets)
        for x in flows.itertuples():
            if n and x.first_ts - last > p.gap_s:
                self.targets.clear()
                first, last, score, n, failed, limit = None, None, 0.0, 0, 0, p.targets
            first = x.first_ts if first is None else first
            last = x.last_ts if last is None else max(last, x.last_ts)
            target = (x.dst_ip, int(x.dst_port))
            if self.targets.containsKey(target):
                continue
            self.targets.updateValue(target, (True,))
            n, failed = n + 1, failed + (not x.synack_seen)
            score += p.trw.on_success if x.synack_seen else p.trw.on_failure
            score = 0.0 if score <= p.trw.lower else score
            if score >= p.trw.upper and n >= limit:
                limit = 2 * n
                out.append((key[0], n, score, int(failed), first, last))
        self.walk.update((first, last, score, n, int(failed), limit))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((last + p.gap_s) * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["src_ip", "n", "score", "failed", "first_ts", "last_ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The gap has passed in event time, so the session is over and its state goes."""
        self.walk.clear()
        self.targets.clear()
        return iter(())

    def close(self) -> None:
        pass


def scan_stream(flows: DataFrame, p: Scan = Scan(), late: str = "30 seconds") -> DataFrame:
    """Firings of the scan detector as flows arrive; a source's state goes once the watermark has passed its session's gap."""
    reply = probable_reply(F.col("mode"), F.col("src_port"), F.col("dst_port"))
    event_time = F.timestamp_micros(F.round(F.col("last_ts") * 1e6).cast("long"))
    tcp = flows.filter((F.col("proto") == TCP) & (F.col("export_index") == 0) & ~reply).select("src_ip", "dst_ip", "dst_port", "seq", "first_ts", "last_ts", "synack_seen", event_time.alias("event_time"))
    return tcp.withWatermark("event_time", late).groupBy("src_ip").transformWithStateInPandas(ScanProcessor(p), SCAN_FIRING, "Append", "EventTime")


def flood_windows(flows: DataFrame, window_s: int = 5, late: str = "30 seconds") -> DataFrame:
    """Counts of each target's windows as they close, with Spark's own windowed aggregation."""
    reply = probable_reply(F.col("mode"), F.col("src_port"), F.col("dst_port"))
    rows = flows.filter((F.col("export_index") == 0) & ~reply).withColumn("event_time", F.timestamp_micros(F.round(F.col("last_ts") * 1e6).cast("long"))).withWatermark("event_time", late)
    return rows.groupBy(F.window("event_time", f"{window_s} seconds").alias("w"), F.col("dst_ip").alias("target")).agg(
        F.count("*").alias("new_flows"), F.approx_count_distinct("src_ip").alias("sources"), F.count_if(F.col("syn_seen") & ~F.col("synack_seen")).alias("syn_only"), F.sum("bytes_fwd").alias("bytes")
    ).select("target", F.col("w.start").alias("start"), "new_flows", "sources", "syn_only", "bytes")
