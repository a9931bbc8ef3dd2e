"""The functions over series lists, by name in REGISTRY."""

from gridtide.functions import across, combine, naming, pointwise, select, windows
from gridtide.functions.registry import REGISTRY, apply

__all__ = ["REGISTRY", "across", "apply", "combine", "naming", "pointwise", "select", "windows"]
