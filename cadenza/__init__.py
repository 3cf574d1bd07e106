"""Narration planning over corpora, as Spark DataFrame operators."""
