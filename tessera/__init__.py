"""An analytics engine on Spark: one queryable surface over tables, change logs, documents, text, graphs, chains and ledgers."""
