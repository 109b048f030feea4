"""Changes of a store's tables, applied in order and once each."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import history
from .store import MIGRATED, Store


class MigrationError(RuntimeError):
    pass


@dataclass(frozen=True)
class Migration:
    """A version (digits), and what gives the new contents of tables by name from a store that has all versions before."""

    version: str
    change: Callable[[Store], dict[str, DataFrame]]


#: Tables of a new store.
TABLES = {
    "scans": "id long, target string, started string",
    "endpoints": "scan_id long, url string, method string, status int, kind string",
    "findings": "scan_id long, fp string, ordinal long, seen_at timestamp, name string, severity string, confidence string, evidence string, remediation string, cwe string, cve string",
}

# Columns of findings that the fourth version adds, and their defaults.
EVIDENCE = (("stage", "POSSIBLE"), ("confidence_score", 0), ("observed_at", ""), ("source", ""), ("request_sha256", ""), ("response_sha256", ""), ("baseline_sha256", ""), ("evidence_metadata", "{}"))


def with_defaults(rows: DataFrame, columns: Sequence[tuple[str, object]]) -> DataFrame:
    """rows with those of the columns that it lacks, and defaults in place of nulls in the others."""
    missing = {name: F.lit(default) for name, default in columns if name not in rows.columns}
    return rows.withColumns(missing).fillna({name: default for name, default in columns if name in rows.columns})


def _initial(store: Store) -> dict[str, DataFrame]:
    return {name: store.spark.createDataFrame([], schema) for name, schema in TABLES.items() if store.read(name) is None}


def _history(store: Store) -> dict[str, DataFrame]:
    return {"history": history(None, store.read("findings"))} if store.read("history") is None else {}


def _evidence(store: Store) -> dict[str, DataFrame]:
    return {"findings": with_defaults(store.read("findings"), EVIDENCE)}


#: The second version is indexes, which these tables don't have.
MIGRATIONS = (Migration("001", _initial), Migration("003", _history), Migration("004", _evidence))


def _check(store: Store, step: Migration, name: str, rows: DataFrame) -> None:
    """Changes only add: each column that was there is there, with its type."""
    old = store.read(name)
    types = dict(rows.dtypes)
    if name == MIGRATED or not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise MigrationError(f"migration {step.version} may not write {name}")
    if old is not None and (lost := [c for c, t in old.dtypes if types.get(c) != t]):
        raise MigrationError(f"migration {step.version} loses or changes columns of {name}: {', '.join(lost)}")


def migrate(store: Store, steps: Sequence[Migration] = MIGRATIONS) -> int:
    """Applies the steps that haven't been applied, in the order of their versions, and gives their number.

    A step's tables are written under names that don't count, and count together with the row of the step in the table of migrations, whose writing
    Spark's committer completes in one place. If a step fails, tables stay as the step before left them, its error names it, and the next call begins with it;
    what it wrote is removed first. One writer at a time, as for the store. A step may give no tables; two of one version are an error.
    """
    ordered = sorted(steps, key=lambda s: (int(s.version), s.version))
    if len({int(s.version) for s in ordered}) < len(ordered):
        raise MigrationError("two migrations have one version")
    done = 0
    for step in ordered:
        known = store.applied()
        if step.version in known:
            continue
        try:
            store.forget(step.version)
            changes = step.change(store)
            for name, rows in changes.items():
                _check(store, step, name, rows)
            for name, rows in changes.items():
                store.write(name, rows, step.version)
            row = store.spark.range(1).select(F.lit(step.version).alias("version"), F.current_timestamp().alias("applied_at"))
            old = store.read(MIGRATED)
            store.write(MIGRATED, row if old is None else old.unionByName(row))
        except MigrationError:
            raise
        except Exception as e:
            raise MigrationError(f"migration {step.version} failed: {e}") from e
        done += 1
    return done
