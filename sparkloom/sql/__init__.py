"""The SQL dialect: lexer, parser, checks, translation to DataFrames, engine."""
