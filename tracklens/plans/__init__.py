"""The registered queries of the engine."""

from . import composite, cues, diagnostics, evaluation, events, export, features, looming, quality, streams, summaries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "composite", "cues", "diagnostics", "evaluation", "events", "export", "features", "looming", "quality", "streams", "summaries"]
