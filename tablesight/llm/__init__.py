"""Training-data pipeline operators: packing, deduplication, fingerprints, sharding,
classifiers and token counts over document tables.

Nothing else in the library imports this subpackage. ``llm.queries`` registers one
``opN_<name>`` query per operator.
"""
