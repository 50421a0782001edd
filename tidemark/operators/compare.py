"""Matching with a target, classification, differences, references and pinned comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.convert import values_equal
from tidemark.plans.validate import topological

CLASSES = ("CREATE", "UPDATE", "UNCHANGED", "AMBIGUOUS", "BLOCKED")


def target_index(target: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per whole key: how many target rows have it and the first one's payload (by all its values)."""
    whole = target.na.drop(subset=list(keys))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct(*[F.col(f"`{c}`") for c in payload])).alias("match"))


def matched(source: DataFrame, target: DataFrame, keys: Mapping[str, str], payload: Sequence[str]) -> DataFrame:
    """Source rows with ``n_matches`` and ``match``; the target is reduced to one row per key first, so rows never multiply."""
    index = target_index(target, list(keys.values()), payload).select(*[F.col(f"`{t}`").alias(f"{t}__t") for t in keys.values()], "n_matches", "match")
    test = [source[s] == index[f"{t}__t"] for s, t in keys.items()]
    out = source.join(index, test, "left").drop(*[f"{t}__t" for t in keys.values()])
    return out.withColumn("n_matches", F.coalesce("n_matches", F.lit(0)).cast("long"))


def classified(blocked: Column, matches: Column, differs: Column, lacks_required: Column, create_policy: str = "create", diff_blocks: Column | None = None) -> Column:
    """Five-way class, by precedence: blocked, ambiguous, create (or blocked), create-only policy, update or unchanged."""
    create = F.when(F.lit(create_policy == "block") | F.coalesce(lacks_required, F.lit(False)), F.lit("BLOCKED")).otherwise(F.lit("CREATE"))
    out = F.when(F.coalesce(blocked, F.lit(False)), F.lit("BLOCKED")).when(matches > 1, F.lit("AMBIGUOUS")).when(matches == 0, create)
    if create_policy == "create_only":
        return out.otherwise(F.lit("UNCHANGED"))
    if diff_blocks is not None:
        out = out.when(F.coalesce(diff_blocks, F.lit(False)), F.lit("BLOCKED"))
    return out.when(differs, F.lit("UPDATE")).otherwise(F.lit("UNCHANGED"))


def class_counts(decisions: DataFrame, column: str = "classification") -> DataFrame:
    """Rows of each of the five classes, absent ones with 0."""
    base = decisions.sparkSession.createDataFrame([(c,) for c in CLASSES], f"{column} string")
    found = decisions.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return base.join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


def differences(fields: Sequence[tuple[str, Column, Column, str]]) -> Column:
    """Array of (field, existing, proposed, policy) of the fields that differ; ``fields``: name, source, target, null policy."""
    items = [F.when(~values_equal(s, t, p), F.struct(F.lit(n).alias("field"), t.cast("string").alias("existing"), s.cast("string").alias("proposed"), F.lit(p).alias("policy"))) for n, s, t, p in fields]
    return F.array_compact(F.array(*items))


def set_change(existing: Column, proposed: Column, operation: str) -> Column:
    """Struct (final, changed) of a many-to-many field: replace, add or remove, whatever the order."""
    norm = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    a, b = norm(existing), norm(proposed)
    final = {"replace": b, "add": norm(F.array_union(a, b)), "remove": norm(F.array_except(a, b))}[operation]
    return F.struct(final.alias("final"), (final != a).alias("changed"))


def resolve_references(rows: DataFrame, parents: DataFrame, keys: Mapping[str, str], parent_blocked: str | None = None, out: str = "reference") -> DataFrame:
    """Each row with the status of a reference: NOT_FOUND, AMBIGUOUS, BLOCKED_BY_DEPENDENCY, RESOLVED, or EMPTY for a blank key."""
    blocked = F.max(F.col(parent_blocked).cast("int")) if parent_blocked else F.lit(0)
    index = parents.groupBy(*[F.col(f"`{t}`").alias(f"{t}__t") for t in keys.values()]).agg(F.count(F.lit(1)).alias("n__"), blocked.alias("b__"))
    joined = rows.join(index, [rows[s] == index[f"{t}__t"] for s, t in keys.items()], "left")
    empty = F.lit(False)
    for s in keys:
        empty = empty | rows[s].isNull()
    status = F.when(empty, "EMPTY").when(F.col("n__").isNull(), "NOT_FOUND").when(F.col("n__") > 1, "AMBIGUOUS").when(F.col("b__") > 0, "BLOCKED_BY_DEPENDENCY").otherwise("RESOLVED")
    return joined.withColumn(out, status).drop("n__", "b__", *[f"{t}__t" for t in keys.values()])


def id_to_key(rows: DataFrame, column: str, parents: DataFrame, id_column: str, keys: Sequence[str], out: str) -> DataFrame:
    """Surrogate id to the parent's business key; an id without a parent, or with several, is flagged and has no key.

    Parents are reduced to one row per id first, so rows never multiply.
    """
    one = F.count(F.lit(1)) == 1
    index = parents.groupBy(F.col(id_column).alias("id__")).agg(F.when(one, F.min(F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))).alias(out), (~one).alias("m__"))
    joined = rows.join(index, rows[column] == index["id__"], "left")
    return joined.withColumns({f"{out}_missing": rows[column].isNotNull() & F.col("id__").isNull(), f"{out}_ambiguous": F.coalesce("m__", F.lit(False))}).drop("id__", "m__")


def ids_to_keys(rows: DataFrame, row: str, column: str, parents: DataFrame, id_column: str, key: str, out: str) -> DataFrame:
    """Arrays of ids to sorted arrays of keys; an id without one parent counts as missing."""
    long = rows.select(row, F.explode(column).alias("id__")).distinct()
    index = parents.groupBy(F.col(id_column).alias("id__")).agg(F.when(F.count(F.lit(1)) == 1, F.min(F.col(key).cast("string"))).alias("k__"))
    named = long.join(index, "id__", "left")
    grouped = named.groupBy(row).agg(F.array_sort(F.collect_set("k__")).alias(out), F.count_if(F.col("k__").isNull()).alias(f"{out}_missing"))
    return rows.join(grouped, row, "left").withColumns({out: F.coalesce(out, F.array().cast("array<string>")), f"{out}_missing": F.coalesce(f"{out}_missing", F.lit(0)).cast("long")})


def composite_keys(tables: Mapping[str, DataFrame], parts: Mapping[str, Sequence[str | tuple[str, str]]], id_column: str = "id") -> dict[str, DataFrame]:
    """(id, key, key_missing, key_ambiguous) of every dataset, whose business key may hold its parents' keys.

    ``parts``: dataset -> components in order, an own column or (column with a parent's id,
    parent dataset).  Parents come first, one join for each reference; a cycle raises
    ValueError with its datasets.  A key is nested JSON; it is null where an own component
    is, or where a parent is missing, repeated or has none.
    """
    edges = [(p[1], d) for d, own in parts.items() for p in own if not isinstance(p, str)]
    loops = sorted(d for p, d in edges if p == d)
    if loops:
        raise ValueError(f"cycle among {', '.join(loops)}")
    done: dict[str, DataFrame] = {}
    for d in topological(parts, edges):
        rows = tables[d].select(F.col(id_column).alias("id"), *[F.col(p if isinstance(p, str) else p[0]).alias(f"c{i}__") for i, p in enumerate(parts[d])])
        missing, ambiguous, shown = F.lit(False), F.lit(False), []
        for i, p in enumerate(parts[d]):
            if isinstance(p, str):
                shown.append(F.to_json(F.array(F.col(f"c{i}__").cast("string"))))
                missing = missing | F.col(f"c{i}__").isNull()
                continue
            one = F.count(F.lit(1)) == 1
            index = done[p[1]].groupBy(F.col("id").alias(f"i{i}__")).agg(F.when(one, F.min("key")).alias(f"k{i}__"), (~one | F.bool_or("key_ambiguous")).alias(f"a{i}__"))
            rows = rows.join(index, rows[f"c{i}__"] == index[f"i{i}__"], "left")
            shown.append(F.concat(F.lit("["), F.col(f"k{i}__"), F.lit("]")))
            ambiguous = ambiguous | F.coalesce(f"a{i}__", F.lit(False))
            missing = missing | F.col(f"k{i}__").isNull()
        inner = F.concat_ws(",", *[F.substr(x, F.lit(2), F.char_length(x) - 2) for x in shown])
        done[d] = rows.select("id", F.when(~missing & ~ambiguous, F.concat(F.lit("["), inner, F.lit("]"))).alias("key"), (missing & ~ambiguous).alias("key_missing"), ambiguous.alias("key_ambiguous"))
    return done


def grouped_issues(issues: DataFrame) -> DataFrame:
    """By code, message, severity, dataset and field: affected rows; the row only where it is one."""
    out = issues.groupBy("code", "message", "severity", "dataset", "field").agg(F.count_distinct("row").alias("affected"), F.min("row").alias("row"))
    return out.withColumn("row", F.when(F.col("affected") == 1, F.col("row")))


def grouped_resolutions(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("dataset", "field", "status", "n_matches").agg(F.count(F.lit(1)).alias("affected_count"))


PINNED = ("SCHEMA_CHANGED", "BASELINE_MISSING", "CONCURRENT_CHANGE", "UPDATE", "EXTERNAL_CHANGE_NOT_WRITTEN", "UNCHANGED")


def pinned_field(prepared: Column, baseline: Column, live: Column, has_baseline: Column, has_live: Column, written: bool = True) -> Column:
    """Outcome of one field from what is proposed, what was captured and what is there now."""
    moved = ~baseline.eqNullSafe(live)
    wanted = ~prepared.eqNullSafe(baseline)
    return (
        F.when(~has_baseline, "BASELINE_MISSING")
        .when(~has_live, "SCHEMA_CHANGED")
        .when(F.lit(not written) & moved, "EXTERNAL_CHANGE_NOT_WRITTEN")
        .when(F.lit(not written), "UNCHANGED")
        .when(moved & wanted & ~prepared.eqNullSafe(live), "CONCURRENT_CHANGE")
        .when(moved & ~wanted, "EXTERNAL_CHANGE_NOT_WRITTEN")
        .when(wanted & ~prepared.eqNullSafe(live), "UPDATE")
        .otherwise("UNCHANGED")
    )


def pinned_row(fields: Sequence[Column]) -> Column:
    """The most severe outcome of a row's fields."""
    every = F.array(*fields)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in PINNED:
        out = out.when(F.array_contains(every, name), F.lit(name))
    return out


def write_intents(decisions: DataFrame, key: Sequence[str], fields: Sequence[tuple[str, Column, Column]], sequence: int = 0, deferred: Sequence[str] = ()) -> DataFrame:
    """One row per field to write: all of a new row's values, the differing ones of an updated row.

    Fields in ``deferred`` are written in a second phase, when their targets exist.
    """
    items = [
        F.when((F.col("classification") == "CREATE") | ((F.col("classification") == "UPDATE") & ~s.eqNullSafe(t)), F.struct(F.lit(n).alias("field"), s.cast("string").alias("value"), F.lit(2 if n in deferred else 1).alias("phase")))
        for n, s, t in fields
    ]
    live = decisions.filter(F.col("classification").isin("CREATE", "UPDATE"))
    return live.select(*key, "classification", F.lit(sequence).alias("sequence"), F.explode(F.array_compact(F.array(*items))).alias("i")).select(*key, "classification", "sequence", "i.phase", "i.field", "i.value")


def eligible_rows(rows: DataFrame, eligible: DataFrame, key: Sequence[str]) -> DataFrame:
    """Only quality-eligible rows go back into a comparison."""
    return rows.join(eligible.select(*key).distinct(), list(key), "left_semi")


READY = {"CREATE": "ready", "UPDATE": "ready", "UNCHANGED": "ready", "AMBIGUOUS": "needs_review", "BLOCKED": "blocked"}


def readiness(classification: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for c, r in READY.items():
        out = out.when(classification == c, F.lit(r))
    return out
