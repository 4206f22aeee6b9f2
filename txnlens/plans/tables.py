"""The input tables of the reports, from benchmark tables or from source files.

A ``Tables`` object hands out lazy DataFrames: raw and cleaned transactions,
raw and cleaned users, cards, fraud labels and category codes. Each is built
on first use and then shared by every report asking for it (plans only: every
report still reads and processes the data in full when it runs).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from txnlens.operators.cleaning import clean_transactions, clean_users
from txnlens.operators.features import card_features, txn_features, user_features
from txnlens.sources import adapters
from txnlens.sources.files import read_cards, read_label_map, read_mcc, read_transactions, read_users


class Tables:
    """Lazy report inputs built from loader callables (each returns a raw DataFrame)."""

    def __init__(self, raw_transactions: Callable[[], DataFrame],
                 raw_users: Callable[[], DataFrame] | None = None,
                 raw_cards: Callable[[], DataFrame] | None = None,
                 labels: Callable[[], DataFrame] | None = None,
                 mcc: Callable[[], DataFrame] | None = None,
                 currency_symbol: str | None = None,
                 transactions_text: Callable[[], DataFrame] | None = None,
                 label_text: Callable[[], DataFrame] | None = None,
                 texts: dict[str, Callable[[], DataFrame]] | None = None):
        self._loaders = {**(texts or {}), "transactions_text": transactions_text, "label_text": label_text, "raw_transactions": raw_transactions, "raw_users": raw_users,
                         "raw_cards": raw_cards, "labels": labels, "mcc": mcc}
        self._currency_symbol = currency_symbol

    def _load(self, name: str) -> DataFrame:
        loader = self._loaders.get(name)
        if loader is None:
            raise ValueError(f"no {name.replace('raw_', '')} table was given")
        return loader()

    @cached_property
    def raw_transactions(self) -> DataFrame:
        return self._load("raw_transactions")

    @cached_property
    def clean_transactions(self) -> DataFrame:
        return clean_transactions(self.raw_transactions, self._currency_symbol)

    @cached_property
    def transactions(self) -> DataFrame:
        """Cleaned transactions with features."""
        return txn_features(self.clean_transactions)

    @cached_property
    def raw_users(self) -> DataFrame:
        return self._load("raw_users")

    @cached_property
    def clean_users(self) -> DataFrame:
        return clean_users(self.raw_users)

    @cached_property
    def users(self) -> DataFrame:
        """Cleaned users with features."""
        return user_features(self.clean_users)

    @cached_property
    def cards(self) -> DataFrame:
        """Cards with features."""
        return card_features(self._load("raw_cards"))

    @cached_property
    def transactions_text(self) -> DataFrame:
        """The transactions as text columns, as a CSV gives them."""
        return self._load("transactions_text")

    @cached_property
    def label_text(self) -> DataFrame:
        """The labels as pieces of their JSON object."""
        return self._load("label_text")

    def text(self, name: str) -> DataFrame:
        """Users, cards or codes (``mcc``) as text columns, as a CSV gives them."""
        return self._load(f"{name}_text")

    @cached_property
    def labels(self) -> DataFrame:
        return self._load("labels")

    @cached_property
    def mcc(self) -> DataFrame:
        return self._load("mcc")

    def use(self, name: str, df: DataFrame) -> None:
        """Serve ``df`` as table ``name`` from now on (e.g. a staged copy)."""
        if name not in ("transactions", "users", "cards", "labels", "mcc"):
            raise ValueError(f"cannot replace {name!r}")
        self.__dict__[name] = df

    @classmethod
    def from_benchmark(cls, spark: SparkSession, sf_dir: str) -> Tables:
        """The banking tables derived from the benchmark tables in ``sf_dir``."""
        return cls(lambda: adapters.txn_raw(spark, sf_dir), lambda: adapters.users_raw(spark, sf_dir),
                   lambda: adapters.cards(spark, sf_dir), lambda: adapters.fraud_labels(spark, sf_dir),
                   lambda: adapters.mcc_codes(spark, sf_dir),
                   transactions_text=lambda: adapters.transactions_text(spark, sf_dir),
                   label_text=lambda: adapters.label_text(spark, sf_dir),
                   texts={"users_text": lambda: adapters.users_text(spark, sf_dir), "cards_text": lambda: adapters.cards_text(spark, sf_dir),
                          "mcc_text": lambda: adapters.mcc_text(spark, sf_dir)})

    @classmethod
    def from_files(cls, spark: SparkSession, transactions, users=None, cards=None, labels=None, mcc=None,
                   date_format: str | None = None, card_date_format: str | None = None,
                   currency_symbol: str | None = None, strict: bool = False,
                   renames: dict[str, dict[str, str]] | None = None, quoted_breaks: bool = False, quoted_commas: bool = False) -> Tables:
        """Source files: CSV for transactions, users, cards and categories, the JSON label map.

        ``renames`` maps a table name (``transactions``, ``users``, ``cards``,
        ``mcc``) to ``{file column: schema column}`` for sources whose headers differ.
        ``quoted_breaks``: CSV fields may hold line breaks; ``quoted_commas``: labels may hold commas.
        """
        renames = renames or {}

        def opt(path, read):
            return None if path is None else (lambda: read(path))
        return cls(lambda: read_transactions(spark, transactions, date_format, strict,
                                             renames.get("transactions"), quoted_breaks=quoted_breaks),
                   opt(users, lambda p: read_users(spark, p, strict, renames.get("users"), quoted_breaks=quoted_breaks)),
                   opt(cards, lambda p: read_cards(spark, p, card_date_format, strict, renames.get("cards"), quoted_breaks=quoted_breaks)),
                   opt(labels, lambda p: read_label_map(spark, p, quoted_commas=quoted_commas)),
                   opt(mcc, lambda p: read_mcc(spark, p, renames.get("mcc"), quoted_breaks=quoted_breaks)),
                   currency_symbol)
