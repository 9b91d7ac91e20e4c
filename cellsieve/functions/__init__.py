"""Column to Column functions with Python literal semantics."""
