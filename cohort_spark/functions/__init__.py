"""Column expressions: NULL rules, dates, text, ordered rules, exact tests."""

from cohort_spark.functions.classify import classify, with_class, with_dictionary_class
from cohort_spark.functions.dates import exact_years, round_half_even, year_of
from cohort_spark.functions.exact import binom_p, fisher_tests
from cohort_spark.functions.nulls import is_in, missing_to, n_unique, not_in
from cohort_spark.functions.text import (
    first_field,
    first_integer,
    first_number,
    matches,
    matches_ci,
    remove_first,
    split_fields,
    to_number,
)

__all__ = [
    "binom_p", "classify", "exact_years", "first_field", "first_integer",
    "first_number", "fisher_tests", "is_in", "matches", "matches_ci",
    "missing_to", "n_unique", "not_in", "remove_first", "round_half_even",
    "split_fields", "to_number", "with_class", "with_dictionary_class",
    "year_of",
]
