"""Imports every query module of the subpackage."""

from pitchline.llm import (  # noqa: F401
    conversations, decontaminate, licenses, line_dedup, mixing, phrases, prefix_bpe, pseudonyms, quality_rules, resampling, simhash, simple8b,
    substring_dedup)
from pitchline.llm.registry import ORACLES, QUERIES  # noqa: F401
