"""branchstone: versioned, typed feature tables on PySpark."""
