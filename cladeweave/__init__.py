"""Sequence-curation and tree-comparison operators expressed as Spark DataFrame plans."""
