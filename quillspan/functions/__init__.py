"""Column functions: built-in expressions only, but for the embedding hook in ``vectors``."""
