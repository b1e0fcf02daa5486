"""Bilingual question-answering corpora and conversations as PySpark DataFrame jobs."""
