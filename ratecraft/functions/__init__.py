"""Column-expression helpers (JVM-side, codegen friendly)."""

from .numeric import half_even, round_doubles, safe_ratio

__all__ = ["half_even", "round_doubles", "safe_ratio"]
