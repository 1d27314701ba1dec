"""Programs of lookup tables: their rewriting, evaluation and storage."""
