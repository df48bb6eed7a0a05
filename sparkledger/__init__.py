"""Spark-native evaluation of question answering over financial reports.

Scalars are Column expressions, operators are DataFrame functions that Catalyst plans as one query, and Python runs
only where an operator needs it: sandboxed programs, free-form arithmetic, resampling and model prediction.
"""
