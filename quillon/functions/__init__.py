"""Scalar functions as Column -> Column: texts, hashes, scores, vectors."""
