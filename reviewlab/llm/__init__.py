"""Operators of a training-data pipeline: near and line dedup, tokenising, packing,
language-model scoring, language and quality classifiers, sketches.

Nothing else in the package imports this one.
"""
