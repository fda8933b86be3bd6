"""Typed readers, sinks, call scans and written stages."""

from cohort_spark.sources.stages import save_named, stage
from cohort_spark.sources.tables import (
    read_positional,
    read_table,
    schema_from_codes,
    write_table,
)
from cohort_spark.sources.variants import land_calls, landed_variants, load_calls, scan_variants

__all__ = ["land_calls", "landed_variants", "load_calls", "read_positional", "read_table", "save_named",
           "scan_variants", "schema_from_codes", "stage", "write_table"]
