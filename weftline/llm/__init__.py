"""Operators for preparing training text at scale: near-duplicate joins, tokenising, packing, language and
toxicity models, archives and filters. Nothing outside this subpackage imports it."""
