"""Reports as JSON text and back, with schemas that do not depend on the frames that wrote them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCORES = "completeness double, validity double, schema_consistency double, record_consistency double, health_score double"
_COUNTS, _RATES = "map<string,bigint>", "map<string,double>"

HEALTH_REPORT = (
    f"records_expected bigint, records_received bigint, {_SCORES}, status string, violations_by_field {_COUNTS}, violations_by_code {_COUNTS}, failure_signals array<string>, "
    f"null_rates {_RATES}, filled_cells bigint, valid_records bigint, null_counts {_COUNTS}, weights {_RATES}, thresholds {_RATES}"
)
_EVIDENCE = (
    "baseline_health: double, current_health: double, health_delta: double, baseline_record_count: bigint, current_record_count: bigint, record_count_delta: bigint, fingerprint_changed: boolean, "
    f"null_rate_deltas: {_RATES}, fields_broken_now: array<string>, fields_broken_baseline: array<string>, newly_broken_fields: array<string>, recovered_fields: array<string>"
)
DETECTION_REPORT = f"detected boolean, severity string, confidence double, reason string, signals array<string>, triggering_rules array<string>, evidence struct<{_EVIDENCE}>"


def to_text(reports: DataFrame, keys: Sequence[str], name: str = "report") -> DataFrame:
    """The keys and all other columns as one JSON object, nulls written out."""
    rest = [c for c in reports.columns if c not in keys]
    return reports.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(name))


def from_text(rows: DataFrame, schema: str, name: str = "report") -> DataFrame:
    """The other columns of ``rows`` and the members of the JSON object in ``name``; unknown members are left out.

    Members that are missing are null. Text that is no JSON object raises when
    the row is read; a null text gives nulls.
    """
    kept = [c for c in rows.columns if c != name]
    return rows.select(*kept, F.from_json(name, schema, {"mode": "FAILFAST"}).alias("_report")).select(*kept, "_report.*")


def write_json(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines, one object a row, nulls written out; an existing folder is replaced."""
    reports.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
