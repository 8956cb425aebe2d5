"""Writers of delimited text, CSV sets and SQLite files."""
