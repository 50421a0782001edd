"""Writing to a target and reading it back: batches of one field set, two phases, an outcome for every row."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.paged import CaptureError
from tidemark.sources.snapshot import work_table

WRITTEN, FAILED, UNKNOWN, NOT_ATTEMPTED = "WRITTEN", "FAILED", "OUTCOME_UNKNOWN", "NOT_ATTEMPTED"
#: Most keys and most ids that one read-back request may name.
KEYS_A_REQUEST, IDS_A_REQUEST = 20, 50


class UnknownOutcome(Exception):
    """The sender can't say whether the target took a batch."""


def payloads(intents: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for what a record gets in one phase: its fields in order and their values; from intents of one row a field."""
    one = F.sort_array(F.collect_list(F.struct("field", "value")))
    rows = intents.groupBy(*key, "classification", "sequence", "phase").agg(one.alias("v"))
    return rows.select(*key, "classification", "sequence", "phase", F.transform("v", lambda x: x["field"]).alias("fields"), F.transform("v", lambda x: x["value"]).alias("values"))


def send_rows(rows: DataFrame, key: Sequence[str], send: Callable, size: int = 100) -> DataFrame:
    """(key..., phase, sequence, status) of every row of ``payloads``, after sending them in batches.

    A batch has at most ``size`` rows of one classification and one set of fields.
    ``send(classification, fields, rows, token)`` gives a truth value for each row, or
    raises ``UnknownOutcome``; then the batch's rows are unknown, the rest of the
    partition isn't attempted, and nothing is sent again.  The token is the batch's digest: a
    task that runs again after an executor was lost offers the same batches with the same
    tokens, so the sender can tell.
    """
    fields = [f for f in rows.schema if f.name in key]
    schema = T.StructType([*fields, *[f for f in rows.schema if f.name in ("phase", "sequence")], T.StructField("status", T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        stopped = False

        def flush() -> pa.RecordBatch:
            nonlocal held, stopped
            if stopped:
                status = [NOT_ATTEMPTED] * len(held)
            else:
                records = [{**{k: r[k] for k in key}, **dict(zip(r["fields"], r["values"], strict=True))} for r in held]
                token = hashlib.sha256(json.dumps([held[0]["phase"], held[0]["sequence"], held[0]["classification"], records], default=str, sort_keys=True).encode()).hexdigest()
                try:
                    status = [WRITTEN if ok else FAILED for ok in send(held[0]["classification"], tuple(held[0]["fields"]), records, token)]
                except UnknownOutcome:
                    status, stopped = [UNKNOWN] * len(held), True
            out = [{**r, "status": s} for r, s in zip(held, status, strict=True)]
            held = []
            return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=kinds)

        for batch in batches:
            kinds = pa.schema([*(batch.schema.field(n) for n in names[:-1]), ("status", pa.string())])
            for r in batch.to_pylist():
                if held and (len(held) >= size or (held[0]["classification"], held[0]["fields"]) != (r["classification"], r["fields"])):
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    # neighbours in a partition share a field set; keys deal the rows out, so a common field set is no hot key
    ordered = rows.repartition(*key).sortWithinPartitions("classification", "fields", *key)
    return ordered.mapInArrow(run, schema)


def two_phase_load(intents: DataFrame, key: Sequence[str], send: Callable, size: int = 100) -> DataFrame:
    """(key..., phase, sequence, status) of all intents, sent dataset by dataset, first all of phase 1, then phase 2.

    Phase 2 is for fields that refer to what phase 1 writes; a row that phase 1 didn't
    write isn't attempted in phase 2.  After a step with an unknown outcome no further
    step is sent: its rows are not attempted.  Every step's outcomes are a written table
    before the next one begins.
    """
    rows = work_table(payloads(intents, key), "load-rows")
    steps = sorted((r["phase"], r["sequence"]) for r in rows.select("phase", "sequence").distinct().collect())  # two for each dataset
    done, stopped = None, False
    for phase, sequence in steps:
        own = rows.filter((F.col("phase") == phase) & (F.col("sequence") == sequence))
        lost = own.limit(0)
        if stopped:
            own, lost = own.limit(0), own
        elif done is not None and phase > 1:
            failed = done.filter((F.col("sequence") == sequence) & (F.col("status") != WRITTEN)).select(*key)
            own, lost = own.join(failed, list(key), "left_anti").select(own.columns), own.join(failed, list(key), "left_semi").select(own.columns)
        step = send_rows(own, key, send, size).unionByName(lost.select(*key, "phase", "sequence", F.lit(NOT_ATTEMPTED).alias("status")))
        step = work_table(step, "load-step")
        stopped = stopped or not step.filter(F.col("status") == UNKNOWN).isEmpty()
        done = step if done is None else done.unionByName(step)
    return done if done is not None else rows.select(*key, "phase", "sequence", F.lit(NOT_ATTEMPTED).alias("status"))


def read_back(keys: DataFrame, columns: Sequence[str], fetch: Callable, values: str, size: int = KEYS_A_REQUEST) -> DataFrame:
    """The target's rows for exactly the whole keys in ``keys``: (columns..., values...), as many as there are for a key.

    ``fetch(columns, keys)`` gives dictionaries for at most ``size`` keys (``IDS_A_REQUEST``
    for a single id column); a row with another key is an error.  ``values`` is the
    schema of what comes beside the key.  Keys with a null have no exact match and aren't asked for.
    """
    most = IDS_A_REQUEST if len(columns) == 1 and size == KEYS_A_REQUEST else size
    whole = keys.select(*columns).na.drop().distinct()
    extra = keys.sparkSession.createDataFrame([], values).schema
    schema = T.StructType([*whole.schema.fields, *extra.fields])
    names, n = schema.names, len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            own = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for at in range(0, len(own), most):
                asked = own[at : at + most]
                known, rows = set(asked), fetch(tuple(columns), asked)
                for r in rows:
                    if tuple(r[c] for c in names[:n]) not in known:
                        raise CaptureError(f"read back a row that wasn't asked for: {[r[c] for c in names[:n]]}")
                if rows:
                    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in rows], schema=kinds)

    return whole.mapInArrow(run, schema)
