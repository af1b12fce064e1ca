"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import credentials, crosssplit, groupsplit, leakage, lookalikes, mixing, oddsketch, sourcecheck

Query = Callable[[SparkSession, str], DataFrame]


def _on(function: Callable[..., DataFrame], *names: str) -> Query:
    """A query that applies `function` to the named tables."""
    return lambda spark, folder: function(*(table(spark, folder, name) for name in names))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on(credentials.found, "holdout", "owasp_entries"),
        "p1_redaction": _on(credentials.redaction, "holdout", "owasp_entries"),
        "p3_found": _on(crosssplit.found, "holdout", "raw_entries"),
        "p3_report": _on(crosssplit.report, "holdout", "raw_entries"),
        "p4_found": _on(groupsplit.found, "holdout", "raw_entries"),
        "p4_assign": _on(groupsplit.assign, "holdout", "raw_entries", "split_targets"),
        "p4_report": _on(groupsplit.report, "holdout", "raw_entries", "split_targets"),
        "p5_found": _on(oddsketch.found, "owasp_entries", "samples"),
        "p5_groups": _on(oddsketch.groups, "owasp_entries", "samples"),
        "p6_found": _on(sourcecheck.found, "samples"),
        "p6_rates": _on(sourcecheck.rates, "samples"),
        "p7_found": _on(leakage.found, "documents", "eval_items"),
        "p7_report": _on(leakage.report, "documents", "eval_items"),
        "p8_mix": _on(mixing.mix, "documents", "mix_targets"),
        "p8_shares": _on(mixing.shares, "documents", "mix_targets"),
        "p9_found": _on(lookalikes.found, "documents"),
        "p9_consistent": _on(lookalikes.consistent, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": crosssplit.FOUND_SQL,
        "p4_found": groupsplit.FOUND_SQL,
        "p5_found": oddsketch.FOUND_SQL,
        "p7_found": leakage.FOUND_SQL,
        "p7_report": leakage.REPORT_SQL,
        "p9_found": lookalikes.FOUND_SQL,
        "p9_consistent": lookalikes.CONSISTENT_SQL,
    }
