"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; its queries live in
:mod:`corpusloom.llm.queries`.
"""
