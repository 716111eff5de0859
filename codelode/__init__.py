"""Analytics over code-memory tables, declared as Spark plans."""
