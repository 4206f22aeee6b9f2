"""txnlens.functions."""
