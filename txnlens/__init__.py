"""Card-transaction and fraud analytics as Spark DataFrame jobs.

Layout:

* ``txnlens.sources``    readers for the CSV/JSON inputs, benchmark adapters, staging
* ``txnlens.functions``  column expressions (numbers, dates, missing values)
* ``txnlens.operators``  cleaning, features and the reports
* ``txnlens.plans``      the named query catalogue and its SQL oracle
* ``txnlens.streaming``  the same cleaning and reports over a file stream
"""

__version__ = "0.1.0"
