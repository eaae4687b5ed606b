"""Intake, ingestion, activation, history and counters as streams. State is keyed, bounded by watermarks or by what one key needs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from corpuslake.sources.scratch import checkpointed
from corpuslake.sources.writers import chunk_store


SEEN = ["document_id", "source_url", "observed_at"]
TIMELINE = ["timeline_date", "timeline_type"]
STORED = "document_id string, source_url string, observed_at timestamp, timeline_date string, timeline_type string"


def observations(source: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each observation with its timeline once, as far back as the watermark reaches."""
    return source.withWatermark("observed_at", lateness).dropDuplicatesWithinWatermark([*SEEN, *TIMELINE])


def taken_in(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, conflicts) of a batch of observations: an observation (document_id, source_url, observed_at) that isn't stored is new, with the least
    of its timelines where it has several; timelines other than the stored or the new one are conflicts."""
    rows = batch.select(*SEEN, F.struct(*TIMELINE).alias("own")).distinct()
    first = rows.groupBy(*SEEN).agg(F.min("own").alias("first"))
    old = stored.select(*SEEN, F.struct(*TIMELINE).alias("old"))
    met = first.join(old, SEEN, "left")
    new = met.filter("old IS NULL").select(*SEEN, "first.*")
    kept = met.select(*SEEN, F.coalesce("old", "first").alias("kept"))
    clash = rows.join(kept, SEEN).filter("NOT (own <=> kept)").select(*SEEN, "own.*")
    return new, clash


def _append(df: DataFrame, path: str, number: int, *by: str) -> None:
    """The rows of a batch; a batch that is run again replaces its own files."""
    marked = df.withColumn("batch", F.lit(number))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path)


def stream_observations(source: DataFrame, sink: str, conflicts: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Append new observations to ``sink``, and those that clash with what is stored to ``conflicts`` (``taken_in``). Repeats within the watermark are
    dropped as they come; of what is stored only the days of a batch are read."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], f"{STORED}, day date, batch long").write.mode("append").partitionBy("day", "batch").parquet(sink)  # makes the folder
        days = [r.day for r in batch.select(F.to_date("observed_at").alias("day")).distinct().collect()]
        stored = spark.read.schema(f"{STORED}, day date, batch long").parquet(sink).filter(F.col("day").isin(days) & (F.col("batch") != number))
        new, clash = taken_in(batch, stored)
        _append(new.withColumn("day", F.to_date("observed_at")), sink, number, "day")
        _append(clash, conflicts, number)

    return observations(source, lateness).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checked_bundles(bundles: DataFrame, stored: DataFrame) -> DataFrame:
    """The bundles (extraction, chunks) of a batch, each content of an id once, with ``mark`` (of the chunks) and ``outcome``: ``write``; ``stored`` where the same chunks are
    stored already; ``invalid`` where count or hashes are wrong; ``conflict`` where an id comes or is stored with other chunks too. ``stored``: extraction_id, mark."""
    mark = F.sha2(F.to_json(F.transform("chunks", lambda c: F.struct(c["document_id"].alias("d"), c["content_sha256"].alias("h")))), 256)
    each = bundles.select("extraction.*", "chunks").withColumn("mark", F.coalesce(mark, F.lit(""))).dropDuplicates(["extraction_id", "mark"])
    right = (F.size("chunks") == F.col("chunk_count")) & F.forall("chunks", lambda c: (F.sha2(c["content"], 256) == c["content_sha256"]) & (c["extraction_id"] == F.col("extraction_id")))
    several = each.groupBy("extraction_id").agg((F.count("*") > 1).alias("several"))
    known = stored.select("extraction_id", F.col("mark").alias("_mark"))
    met = each.join(several, "extraction_id", "left").join(known, "extraction_id", "left")
    outcome = F.when(F.col("_mark") == F.col("mark"), "stored").when(F.col("_mark").isNotNull() | F.coalesce("several", F.lit(False)), "conflict").when(F.coalesce(right, F.lit(False)), "write").otherwise("invalid")
    return met.withColumn("outcome", outcome).drop("several", "_mark")


#: What a stream of bundles keeps: the chunks, a mark of each extraction that is stored, and the bundles that were turned away.
MARKS, REJECTED = "extraction_id string, mark string", "extraction_id string, document_id string, outcome string"


def ingest(batch: DataFrame, number: int, path: str) -> None:
    """Write the valid bundles of a batch as one version of ``chunk_store``: chunks, marks and rejected bundles together. A batch that comes again does nothing. Of
    what is stored only the buckets that the batch's ids fall into are read."""
    store = chunk_store(batch.sparkSession, path)
    entry = store.entry()
    keys = batch.select("extraction.extraction_id")
    if "marks" in entry["tables"]:
        stored = store.read("marks", store.buckets_of(keys), entry["version"])
    else:
        stored = batch.sparkSession.createDataFrame([], MARKS)
    marked = checkpointed(checked_bundles(batch, stored))
    fine = marked.filter("outcome = 'write'")
    rows = fine.select(F.posexplode("chunks").alias("chunk_ordinal", "c")).select("chunk_ordinal", "c.*")
    turned = marked.filter("outcome IN ('invalid', 'conflict')").select("extraction_id", "document_id", "outcome")
    store.commit({"chunks": rows, "marks": fine.select("extraction_id", "mark"), "rejected": turned}, mark=("ingest", number))


def stream_ingest(bundles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each valid bundle's chunks, once for each extraction id: what is stored is never replaced. Bundles that are wrong, or that clash with others of
    their id (``checked_bundles``), go to ``rejected`` and block no other."""
    return bundles.writeStream.foreachBatch(lambda batch, number: ingest(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LOGGED = "act_number string, language string, seq long, action string, extraction_id string, previous_id string"


class Activation(StatefulProcessor):
    """Active and previous extraction of one act and language. With ``ordered`` entries wait for the watermark and are then taken in the order of their times."""

    def __init__(self, ordered: bool = False):
        self.ordered = ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("mapping", "now string, before string")
        if self.ordered:
            self.waiting = handle.getListState("waiting", "at long, seq long, action string, extraction_id string")

    def _taken(self, key: Any, entries: list[tuple]) -> pd.DataFrame:
        """The log's rows for entries (seq, action, extraction_id), in their order."""
        now, before = self.state.get() if self.state.exists() else (None, None)
        out = []
        for seq, action, extraction in entries:
            if action == "activate":
                before, now = (now if now is not None else before), extraction
            elif before is not None:
                now, before = before, now
            else:
                continue
            out.append((*key, seq, action, now, before))
        self.state.update((now, before))
        return pd.DataFrame(out, columns=["act_number", "language", "seq", "action", "extraction_id", "previous_id"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if not self.ordered:
            yield self._taken(key, [(r.seq, r.action, r.extraction_id) for r in pd.concat(rows).sort_values("seq").itertuples()])
            return
        held = [(r.at.value // 1_000_000, int(r.seq), r.action, r.extraction_id) for r in pd.concat(rows).itertuples()]
        self.waiting.appendList(held)
        for at in {h[0] for h in held}:
            self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Entries up to the timer's time go; later ones wait on."""
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due, rest = sorted(h for h in held if h[0] <= until), [h for h in held if h[0] > until]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield self._taken(key, [h[1:] for h in due]) if due else pd.DataFrame()

    def close(self) -> None:
        pass


def stream_activation(log: DataFrame) -> DataFrame:
    """The log with the mapping after each entry; needs the RocksDB state store. Entries of a key come in the order of ``seq``."""
    return log.groupBy("act_number", "language").transformWithStateInPandas(Activation(), LOGGED, "Append", "None")


def stream_activation_in_order(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The same for entries (with a time ``at``) that arrive in any order: each waits until the watermark, ``lateness`` behind the latest time, has passed it, and a key's are
    taken in the order of at, then seq. What waits is bounded by the lateness; entries that come after the watermark are left out."""
    marked = log.withWatermark("at", lateness)
    return marked.groupBy("act_number", "language").transformWithStateInPandas(Activation(True), LOGGED, "Append", "EventTime")


def keep_state_in_rocksdb(spark: SparkSession) -> SparkSession:
    """The session, set to the state store that stateful processors need; queries that are running keep theirs. The session's streams are named because
    they bring up what keeps track of the stores; a processor over a table fails without it."""
    _ = spark.streams
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class History(StatefulProcessor):
    """The messages of one thread that its newest turns within the budget need."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("messages", "pos int, role string, tokens int")
        self.begun = handle.getValueState("begun", "yes boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        old = list(self.kept.get()) if self.kept.exists() else []
        new = [(int(r.pos), r.role, int(r.tokens)) for r in pd.concat(rows).sort_values("pos").itertuples()]
        messages = [tuple(x) for x in old] + new
        if not self.begun.exists():
            self.begun.update((True,))
            messages = messages[1:] if messages[0][1] != "user" else messages
        turns = [messages[i : i + 2] for i in range(0, len(messages), 2)]
        total, first = 0, len(turns)
        while first and (first == len(turns) or total + sum(m[2] for m in turns[first - 1]) <= self.budget):
            first -= 1
            total += sum(m[2] for m in turns[first])
        kept = [m for t in turns[first:] for m in t]
        if kept:
            self.kept.put(kept)
        else:
            self.kept.clear()
        yield pd.DataFrame({"thread_id": [key[0]], "kept_messages": [len(kept)], "kept_tokens": [sum(m[2] for m in kept)], "last_pos": [kept[-1][0] if kept else -1]})

    def close(self) -> None:
        pass


def stream_history(messages: DataFrame, budget: int) -> DataFrame:
    """thread_id and what a reader would be given after each batch of messages; older turns are forgotten, as they can never fit again. A table of messages is one batch."""
    return messages.groupBy("thread_id").transformWithStateInPandas(History(budget), "thread_id long, kept_messages int, kept_tokens long, last_pos int", "Update", "None")


def counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", kind: str = "event_type", time: str = "ts") -> DataFrame:
    """start, kind, n over tumbling windows of event time, for streams and tables alike."""
    marked = events.withWatermark(time, lateness) if events.isStreaming else events
    return marked.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
