"""Shared-folder tables that cut lineage: rows written where every executor can read them."""

from gridtide.shared import Scratch, shared_folder, written

__all__ = ["Scratch", "shared_folder", "written"]
