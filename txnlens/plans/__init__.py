"""txnlens.plans."""
