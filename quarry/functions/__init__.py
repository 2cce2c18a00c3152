from quarry.functions.keys import canonical_key, canonical_value, tautology

__all__ = ["canonical_key", "canonical_value", "tautology"]
