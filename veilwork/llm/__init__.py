"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; :mod:`veilwork.llm.registry` derives the
``opN_<name>`` queries from them.
"""
