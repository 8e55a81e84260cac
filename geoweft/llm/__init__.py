"""Training-data operators: packing, dedup, tokens, decontamination, language, URL, sharding, toxicity.

Nothing else in the package imports this subpackage.
"""
