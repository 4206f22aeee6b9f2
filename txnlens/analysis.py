"""One entry point for an analysis over source files.

    from txnlens.analysis import FraudAnalysis
    fa = FraudAnalysis.from_files(spark, transactions="…/transactions/", users="…/users/",
                                  cards="…/cards/", labels="…/labels.json", mcc="…/mcc.csv")
    fa.report("txn_by_channel").show()
    for name in fa.available(): fa.report(name).write.parquet(f"…/reports/{name}")

Every report is a lazy DataFrame; the cleaned tables are built once and shared.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from txnlens.plans.catalog import REPORTS
from txnlens.plans.tables import Tables
from txnlens.sources.staging import stage, stage_by_id

# which inputs each report reads (transactions are always given)
_NEEDS = {
    "users": ("table_shape", "table_info", "users_head", "user_features_head", "null_counts",
              "duplicate_rows", "describe_users", "describe_credit_score", "clean_users",
              "user_features", "income_quantiles", "iqr_bounds", "income_high_outliers",
              "income_low_outliers", "gender_counts", "gender_means", "credit_bands", "retired_means",
              "user_correlations", "customer_risk", "risk_band_counts"),
    "cards": ("card_features_head", "card_features", "dark_web_cards", "unmatched_card_transactions",
              "dark_web_by_card_type", "customer_risk", "risk_band_counts"),
    "labels": ("label_counts", "label_shares", "fraud_by_channel"),
    "mcc": ("merchant_categories",),
}


class FraudAnalysis:
    """All reports over one set of input tables."""

    def __init__(self, tables: Tables, given: set[str]):
        self.tables = tables
        self._given = given

    @classmethod
    def from_files(cls, spark: SparkSession, transactions, users=None, cards=None, labels=None, mcc=None,
                   **options) -> FraudAnalysis:
        """Paths (or lists of paths) of the source files; options go to ``Tables.from_files``."""
        tables = Tables.from_files(spark, transactions, users, cards, labels, mcc, **options)
        given = {name for name, path in (("users", users), ("cards", cards), ("labels", labels),
                                         ("mcc", mcc)) if path is not None}
        return cls(tables, given)

    def stage(self, path: str | None = None, by_year: bool = True,
              files_per_value: int | None = None) -> FraudAnalysis:
        """Write the cleaned transactions with features once; later reports read that copy.

        Running many reports then reads Parquet (pruned columns, pushed filters,
        ``year`` partitions) instead of parsing and cleaning the source files
        each time. ``path`` defaults to a folder under ``spark.checkpoint.dir``.
        """
        staged = stage(self.tables.transactions, path, ["year"] if by_year else None,
                       files_per_value=files_per_value)
        self.tables.use("transactions", staged)
        return self

    def stage_by_id(self, buckets: int, path: str | None = None) -> FraudAnalysis:
        """Write cleaned transactions and labels once, bucketed by id; their joins then need no exchange.

        ``path``: a folder for both, by default one under ``spark.checkpoint.dir``.
        """
        for name in ("transactions", *(["labels"] if "labels" in self._given else [])):
            folder = os.path.join(path, name) if path else None
            table = f"txnlens_{name}_{uuid.uuid4().hex}"
            self.tables.use(name, stage_by_id(getattr(self.tables, name), table, "id", buckets, folder))
        return self

    def available(self) -> list[str]:
        """Names of the reports the given inputs allow."""
        missing = {n for need, names in _NEEDS.items() if need not in self._given for n in names}
        return [name for name in REPORTS if name not in missing]

    def report(self, name: str) -> DataFrame:
        if name not in REPORTS:
            raise KeyError(f"unknown report {name!r}")
        if name not in self.available():
            raise ValueError(f"report {name!r} needs an input that was not given")
        return REPORTS[name](self.tables)
