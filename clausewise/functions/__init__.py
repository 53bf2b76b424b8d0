"""Functions over texts: as column expressions where Spark has what they need, else as Arrow-batched columns."""

from clausewise.functions.text import condition, display_width, joined_cell, nfc, recipient, wide_class

__all__ = ["condition", "display_width", "joined_cell", "nfc", "recipient", "wide_class"]
