"""seqlake: versioned key-value data as an append-only change log, queried with Spark."""
