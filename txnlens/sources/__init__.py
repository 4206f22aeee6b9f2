"""Inputs and outputs: source-file readers, benchmark-table adapters, staging."""

from txnlens.sources.files import (  # noqa: F401
    good_rows, parse_failures, read_cards, read_label_map, read_mcc, read_transactions, read_typed_csv, read_users, rejected_rows,
    rejection_counts, write_checked,
)
from txnlens.sources.staging import stage  # noqa: F401
