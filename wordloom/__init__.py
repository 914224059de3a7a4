"""wordloom: WordPiece tokenization and text-corpus operators as PySpark DataFrame transformations."""
