"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the driver entry adds its queries only when it can be imported.
"""
