"""Operators on DataFrames: names analytics, dictionaries, blocks of pages, pauses, normalisation, pronunciation."""
