"""Change capture from tables to collections.

Events: ``op`` (insert, update, delete, truncate), ``table``, ``lsn``, ``seq``, ``row`` (map of text), and maybe
``old_row`` with an earlier key. An event is named by (lsn, seq). A batch is committed by one manifest together with
the names of its events, so it is applied whole or not at all, what was applied is skipped by name, and an event that
comes late is applied, but doesn't undo a later one of its id. What can't be applied becomes a dead letter; every
other event of its id still counts.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.errors import EngineError, InvalidArgument
from vectorloom.functions.columns import id_text, parse_vector
from vectorloom.operators.collection import Collection
from vectorloom.plans import filters

EVENT = "op string, table string, lsn long, seq int, row map<string,string>, old_row map<string,string>"


@dataclass(frozen=True)
class Mapping:
    table: str
    collection: str
    id_column: str
    embedding_column: str
    filter: str | None = None

    def __post_init__(self):
        if self.table.count(".") != 1 or not all(self.table.split(".")):
            raise InvalidArgument("tables are named schema.table")
        if not self.collection or not self.id_column or not self.embedding_column:
            raise InvalidArgument("collection, id column and embedding column are needed")
        if self.filter is not None:
            filters.parse(self.filter)


def read_config(config: dict) -> list[Mapping]:
    """{"tables": [...]}; unknown keys are refused, tables and collections must differ."""
    if set(config) - {"tables"} or not config.get("tables"):
        raise InvalidArgument("a config has tables, one or more")
    known = {"table", "collection", "id_column", "embedding_column", "filter"}
    for t in config["tables"]:
        if set(t) - known:
            raise InvalidArgument(f"unknown keys: {sorted(set(t) - known)}")
    out = [Mapping(**t) for t in config["tables"]]
    if len({m.table for m in out}) < len(out) or len({m.collection for m in out}) < len(out):
        raise InvalidArgument("tables and collections must differ")
    return out


def load_config(engine, path: str) -> list[Mapping]:
    """``read_config`` of a JSON file on any Hadoop file system."""
    try:
        config = json.loads(engine._read(path))
    except ValueError as e:
        raise InvalidArgument(f"{path}: {e}") from e
    if not isinstance(config, dict):
        raise InvalidArgument(f"{path}: an object with tables is needed")
    return read_config(config)


def _passes(m: Mapping) -> Column:
    if m.filter is None:
        return F.lit(True)
    names = {name: "string" for name, _, _ in filters.parse(m.filter)}
    return filters.predicate(m.filter, names, lambda c: F.col("row")[c])


def transform(events: DataFrame, mappings: list[Mapping], dims: dict[str, int] | None = None) -> DataFrame:
    """collection, lsn, seq, part, op, id, values, carry, error of every event that means something.

    ``op`` is upsert, delete, truncate or error; ``carry`` marks an update without its embedding, which keeps the
    vector known before. ``dims``: the dimension of each collection; a vector of another one is an error.
    """
    if "old_row" not in events.columns:
        events = events.withColumn("old_row", F.lit(None).cast("map<string,string>"))
    out = None
    for m in mappings:
        e = events.where(F.col("table") == m.table)
        key, text = id_text(F.col("row")[m.id_column]), F.col("row")[m.embedding_column]
        values, passes = parse_vector(text), _passes(m)
        dim = (dims or {}).get(m.collection)
        fits = F.size(values) == dim if dim else F.lit(True)
        carry = (F.col("op") == "update") & ~F.coalesce(F.map_contains_key("row", F.lit(m.embedding_column)), F.lit(False))
        op = (
            F.when(F.col("op") == "truncate", "truncate").when(key.isNull(), "error").when(F.col("op") == "delete", "delete")
            .when((F.col("op") == "insert") & ~passes, "skip").when((F.col("op") == "update") & ~passes, "delete")
            .when(~F.col("op").isin("insert", "update"), "error").when(carry, "upsert").when(values.isNull() | ~fits, "error").otherwise("upsert")
        )
        error = F.when(F.col("op") == "truncate", None).when(key.isNull(), "no id").when(~F.col("op").isin("insert", "update", "delete"), "unknown op").when(values.isNull(), "bad vector").otherwise("wrong dimension")
        one = e.select(F.lit(m.collection).alias("collection"), "lsn", "seq", F.lit(1).alias("part"), op.alias("op"), key.alias("id"), values.alias("values"), carry.alias("carry"), F.when(op == "error", error).alias("error"))
        old = id_text(F.col("old_row")[m.id_column])
        moved = e.where((F.col("op") == "update") & old.isNotNull() & ~old.eqNullSafe(key))
        moved = moved.select(F.lit(m.collection).alias("collection"), "lsn", "seq", F.lit(0).alias("part"), F.lit("delete").alias("op"), old.alias("id"), F.lit(None).cast("array<float>").alias("values"), F.lit(False).alias("carry"), F.lit(None).cast("string").alias("error"))
        both = one.where("op <> 'skip'").unionByName(moved)
        out = both if out is None else out.unionByName(both)
    return out


def net_ops(changes: DataFrame) -> DataFrame:
    """The last operation of each id by (lsn, seq), after the last truncate; updates without a vector look back."""
    good = changes.where("op <> 'error'")
    cut = good.where("op = 'truncate'").groupBy("collection").agg(F.max(F.struct("lsn", "seq")).alias("cut"))
    good = good.where("op <> 'truncate'").join(F.broadcast(cut), "collection", "left")  # a row a collection
    good = good.where("cut is null or struct(lsn, seq) > cut")
    by = Window.partitionBy("collection", "id")
    order = by.orderBy("lsn", "seq", "part")
    since = F.last(F.when(F.col("op") == "delete", F.struct(F.lit(True).alias("gone"), F.lit(None).cast("array<float>").alias("v"))).when(~F.col("carry"), F.struct(F.lit(False).alias("gone"), F.col("values").alias("v"))), ignorenulls=True)
    state = since.over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(by.orderBy(F.col("lsn").desc(), F.col("seq").desc(), F.col("part").desc()))
    out = good.withColumn("state", state).withColumn("n", last).where("n = 1")
    return out.select("collection", "op", "id", F.when(F.col("op") == "upsert", F.col("state.v")).alias("values"), (F.col("op") == "upsert").alias("up") & F.col("state.v").isNull(), "lsn", "seq").toDF("collection", "op", "id", "values", "carry", "lsn", "seq")


def _after(lsn: Column, seq: Column, at) -> Column:
    return (lsn > at["lsn"]) | (lsn == at["lsn"]) & (seq > at["seq"])


_DEAD = ["collection", "lsn", "seq", "id", "error"]


def apply_batch(events: DataFrame, mappings: list[Mapping], collections: dict[str, Collection], dead: Callable[[DataFrame], None] | None = None) -> dict[str, int]:
    """Apply events; returns operations by collection. Safe to repeat.

    ``dead`` takes what can't be applied: (collection, lsn, seq, id, error), for malformed events, vectors of a wrong
    dimension and updates that bring no vector to an id without one.
    """
    done: dict[str, int] = {}
    for m in mappings:
        c = collections[m.collection]
        mine = events.where(F.col("table") == m.table).dropDuplicates(["lsn", "seq"])
        before = c.applied()
        if c._m.applied:
            mine = mine.join(before.select("lsn", "seq").distinct(), ["lsn", "seq"], "left_anti")
        if not mine.head(1):
            done[m.collection] = 0
            continue
        changes = transform(mine, [m], {m.collection: c.config.dim})
        cut = changes.where("op = 'truncate'").agg(F.max(F.struct("lsn", "seq"))).first()[0]
        net = net_ops(changes)
        live = c.snapshot()
        if c._m.applied:  # events that came late change nothing that a later one settled
            span = mine.agg(F.min("lsn")).first()[0]
            later = before.where(F.col("lsn") >= span)
            last_cut = later.where("cut").agg(F.max(F.struct("lsn", "seq"))).first()[0]
            settled = later.where("id is not null").groupBy("id").agg(F.max(F.struct("lsn", "seq")).alias("at"))
            net = net.join(settled, "id", "left").where("at is null or struct(lsn, seq) > at").drop("at")
            if last_cut is not None:
                net = net.where(_after(F.col("lsn"), F.col("seq"), last_cut))
            gone_before = settled
        else:
            gone_before = None
        kept = live.select("id", F.col("values").alias("before"), F.col("metadata").alias("had"))
        carried = F.when(F.col("carry") & (F.lit(cut is None)), F.col("before")).otherwise(F.col("values"))
        net = net.join(kept, "id", "left").withColumn("values", carried)
        blind = net.where("op = 'upsert' and values is null")
        good = net.where("op = 'delete' or values is not null")
        good = good.select("op", "id", "values", F.when(F.col("op") == "upsert", F.coalesce("had", F.create_map().cast("map<string,string>"))).alias("metadata"))
        if cut is not None:
            gone = live.select("id")
            if gone_before is not None:
                newer = gone_before.where(_after(F.col("at.lsn"), F.col("at.seq"), cut))
                gone = gone.join(newer.select("id"), "id", "left_anti")
            gone = gone.join(good.select("id"), "id", "left_anti")
            good = good.unionByName(gone.select(F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("values"), F.lit(None).cast("map<string,string>").alias("metadata")))
        if dead:
            wrong = changes.where("op = 'error'").select(*_DEAD)
            dead(wrong.unionByName(blind.select("collection", "lsn", "seq", "id", F.lit("no vector known").alias("error"))))
        names = changes.where("op <> 'error'").select("lsn", "seq", F.when(F.col("op") != "truncate", F.col("id")).alias("id"), (F.col("op") == "truncate").alias("cut"))
        names = names.unionByName(mine.select("lsn", "seq", F.lit(None).cast("string").alias("id"), F.lit(False).alias("cut"))).distinct()
        at = c._m.log_rows
        c.apply_changes(good, names)
        done[m.collection] = max(0, c._m.log_rows - at) if c._m.open_rows else good.count()
    return done


class CircuitOpen(EngineError):
    """Too many flushes in a row have failed: no more are tried until a new writer is made."""


@dataclass
class Writer:
    """Applies batches with retries; a batch that fails is kept, in order, for the next flush.

    A flush is tried ``retries`` times more, each after a wait that doubles and has up to half of itself added at
    random. ``breaker`` failed flushes in a row open the circuit.
    """

    mappings: list[Mapping]
    collections: dict[str, Collection]
    dead: Callable[[DataFrame], None] | None = None
    retries: int = 4
    backoff: float = 0.1
    breaker: int = 3
    sleep: Callable[[float], None] = time.sleep
    pending: list[DataFrame] = field(default_factory=list)
    failures: int = 0
    applied: int = 0

    def apply(self, events: DataFrame) -> None:
        if self.failures >= self.breaker:
            raise CircuitOpen(f"{self.failures} flushes failed")
        self.pending.append(events)
        self.flush()

    def flush(self) -> None:
        if self.failures >= self.breaker:
            raise CircuitOpen(f"{self.failures} flushes failed")
        while self.pending:
            try:
                self._send(self.pending[0])
            except Exception as e:
                self.failures += 1
                if self.failures >= self.breaker:
                    raise CircuitOpen(f"{self.failures} flushes failed, the last by {e}") from e
                raise
            self.failures = 0
            self.applied += 1
            self.pending.pop(0)

    def _send(self, events: DataFrame) -> None:
        wait = self.backoff
        for attempt in range(self.retries + 1):
            if attempt:
                self.sleep(wait + random.uniform(0, wait / 2))
                wait *= 2
            try:
                apply_batch(events, self.mappings, self.collections, self.dead)
                return
            except InvalidArgument:  # no retry mends it
                raise
            except Exception:
                if attempt == self.retries:
                    raise


def read_events(spark: SparkSession, path: str, files: int = 256) -> DataFrame:
    """A stream of event files, at most ``files`` of them a batch."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(path)


def stream(events: DataFrame, mappings: list[Mapping], collections: dict[str, Collection], checkpoint: str, dead_letters: str | None = None, interval: str = "1 second", once: bool = False, writer: Writer | None = None):
    """A streaming query that applies events batch by batch; what can't be applied is appended to ``dead_letters``.

    A batch whose flush fails stops the query after the retries; started again, it has the batch from its checkpoint.
    """
    keep = (lambda df: df.write.mode("append").parquet(dead_letters)) if dead_letters else None
    writer = writer or Writer(mappings, collections, keep)

    def write(batch: DataFrame, _: int) -> None:
        writer.pending.clear()  # a batch that failed comes again by itself
        writer.apply(batch.persist())
        batch.unpersist()

    out = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)).start()


def reconcile(source: DataFrame, ids: DataFrame, mapping: Mapping) -> DataFrame:
    """(id, kind): missing, orphaned or malformed, from source rows and a collection's ids.

    A malformed row is its own kind, and an id that has one is never orphaned.
    """
    types = dict(source.dtypes)
    keep = filters.predicate(mapping.filter, types) if mapping.filter else F.lit(True)
    key = id_text(F.col(mapping.id_column))
    vector = F.col(mapping.embedding_column)
    values = parse_vector(vector) if types[mapping.embedding_column] == "string" else vector
    wanted = source.where(keep).select(key.alias("id"), values.isNotNull().alias("good"))
    broken = wanted.where("id is null or not good").select("id", F.lit("malformed").alias("kind"))
    known = wanted.where("id is not null").groupBy("id").agg(F.max("good").alias("good"))
    both = known.join(ids.select("id", F.lit(True).alias("have")), "id", "full_outer")
    kind = F.when(F.col("good").isNull(), "orphaned").when(F.col("good") & F.col("have").isNull(), "missing")
    return both.select("id", kind.alias("kind")).where("kind is not null").unionByName(broken)


def reconcile_summary(source_rows: int, engine_ids: int, found: DataFrame) -> DataFrame:
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    return found.agg(count("missing"), count("orphaned"), count("malformed")).select(F.lit(source_rows).cast("long").alias("source_rows"), F.lit(engine_ids).cast("long").alias("engine_ids"), "missing", "orphaned", "malformed", (F.col("missing") + F.col("orphaned")).alias("discrepancies"))


def repair(source: DataFrame, collection: Collection, mapping: Mapping) -> int:
    """Write what is missing and delete what is orphaned; malformed rows are left alone."""
    found = reconcile(source, collection._ids(), mapping)
    values = parse_vector(F.col(mapping.embedding_column))
    rows = source.select(id_text(F.col(mapping.id_column)).alias("id"), values.alias("values")).where(F.size("values") == collection.config.dim).dropDuplicates(["id"])
    fix = found.where("kind = 'missing'").join(rows, "id").select(F.lit("upsert").alias("op"), "id", "values")
    gone = found.where("kind = 'orphaned'").select(F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("values"))
    both = fix.unionByName(gone).withColumn("metadata", F.create_map().cast("map<string,string>"))
    at = collection._m.log_rows
    collection.apply_changes(both)
    return collection._m.log_rows - at


@dataclass
class Reconciler:
    """Passes over one mapping, with what they found kept as counters; ``repairs`` also mends."""

    source: Callable[[], DataFrame]
    collection: Collection
    mapping: Mapping
    repairs: bool = False
    counters: dict[str, float] = field(default_factory=lambda: {"passes": 0, "missing": 0, "orphaned": 0, "malformed": 0, "repaired": 0, "last_run_seconds": 0.0})

    def run(self) -> dict[str, float]:
        """One pass; returns its own counts."""
        began, source = time.monotonic(), self.source()
        kinds = {r["kind"]: r["count"] for r in reconcile(source, self.collection._ids(), self.mapping).groupBy("kind").count().collect()}
        got = {k: kinds.get(k, 0) for k in ("missing", "orphaned", "malformed")}
        got["repaired"] = repair(source, self.collection, self.mapping) if self.repairs and got["missing"] + got["orphaned"] else 0
        for k, n in got.items():
            self.counters[k] += n
        self.counters["passes"] += 1
        self.counters["last_run_seconds"] = time.monotonic() - began
        return got

    def run_every(self, interval: float, passes: int, sleep: Callable[[float], None] = time.sleep) -> dict[str, float]:
        for i in range(passes):
            if i:
                sleep(interval)
            self.run()
        return self.counters
