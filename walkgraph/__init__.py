"""PySpark engine for follow graphs: random-walk stores, ranks and event streams."""
