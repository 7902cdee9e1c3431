"""Loads every module that registers a query."""

from __future__ import annotations

from . import (best_fit, embed_dedup, infill, langid, licences, lm_score, mixing, near_dedup,  # noqa: F401
               packing, phrases, pii, quality, token_shards)
from .registry import ORACLES, QUERIES  # noqa: F401
import corpus_pipeline  # noqa: F401,E402  registers "pipeline"
