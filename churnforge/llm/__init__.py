"""Operators of a training-data pipeline (chat formatting, token files, dedup, packing and the like).

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries only where it can be imported.
"""
