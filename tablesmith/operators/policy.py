"""Decisions of an ingest as expressions: refine, verify, verdicts, drift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import REVIEW_BELOW

# Flags that call for a refinement, methods whose tables a program wrote, and the numbers of the verdicts.
REFINE_FLAGS = ("no_obvious_header", "merged_header_uncertain", "multi_row_header", "malformed_rows", "single_row_island", "weak_header_names")
MACHINE_METHODS = ("script", "agent", "vision", "pdf-docling")
NEAR_THRESHOLD, PASS_BONUS, PASS_CAP, FAIL_CAP = 0.08, 0.07, 0.97, 0.75


def should_refine(flags: Column, vouched: Column, mode: str = "auto", available: bool = True) -> Column:
    """Whether a table goes to refinement; never without a model or after a whole-file exploration has vouched for it."""
    if mode == "never" or not available:
        return F.lit(False)
    wanted = F.lit(True) if mode == "always" else F.coalesce(F.arrays_overlap(flags, F.array(*map(F.lit, REFINE_FLAGS))), F.lit(False))
    return wanted & ~F.coalesce(vouched, F.lit(False))


def should_verify(method: Column, confidence: Column, rows: Column, schema_seen: Column, mode: str = "always", available: bool = True) -> Column:
    """Whether a table is checked by running again: in mode auto if a program wrote it, its confidence is near the threshold, or its schema is new."""
    if mode == "never" or not available:
        return F.lit(False)
    some = F.coalesce(rows, F.lit(0)) > 0
    if mode == "always":
        return some
    near = F.round(F.abs(confidence - REVIEW_BELOW), 9) <= NEAR_THRESHOLD
    return some & (F.coalesce(method.isin(*MACHINE_METHODS), F.lit(False)) | F.coalesce(near, F.lit(True)) | ~F.coalesce(schema_seen, F.lit(False)))


def after_verdict(confidence: Column, ok: Column) -> Column:
    """The confidence after a check; without one it stays."""
    return F.when(ok, F.round(F.least(F.lit(PASS_CAP), confidence + PASS_BONUS), 6)).when(~ok, F.least(confidence, F.lit(FAIL_CAP))).otherwise(confidence)


def needs_review(confidence: Column, ok: Column) -> Column:
    return F.coalesce(after_verdict(confidence, ok) < REVIEW_BELOW, F.lit(True)) | F.coalesce(~ok, F.lit(False))


def drift_action(on_drift: Column, issues: Column) -> Column:
    """``block`` a drifted delivery of a frozen contract, ``proceed`` with one of another, ``none`` without drift."""
    return F.when(F.coalesce(issues, F.lit(0)) == 0, "none").when(on_drift == "freeze", "block").otherwise("proceed")
