"""Operators for preparing text corpora: ten methods and the pipeline that chains five of them."""
