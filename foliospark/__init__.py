"""foliospark: a PySpark engine for wiki-style page dumps and text corpora."""
