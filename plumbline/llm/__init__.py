"""Operators for preparing training data: documents, pages and conversations in, tables out."""
