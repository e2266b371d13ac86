"""Operators for training-data preparation.

Common rules of all operators here: they read only the columns that they name, so further columns, whatever
their names, are ignored; null texts count as empty unless a docstring says otherwise; repeated rows are kept
and judged one by one; an empty table gives an empty result with the same schema.
"""
