"""Language-model extraction behind a replaceable backend."""
