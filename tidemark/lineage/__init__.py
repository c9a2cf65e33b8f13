"""SQL text to lineage: lexer, parser and analyzer, run once a project inside Spark."""
