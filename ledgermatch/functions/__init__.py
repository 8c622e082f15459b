"""Scalar helpers. Each takes and returns Spark SQL text, for ``selectExpr`` and ``F.expr``.

They are all built-in functions, so they stay inside whole-stage code generation.
"""
