"""tidemail — mail-corpus analytics as Spark DataFrame operators.

Sub-packages:
  sources    readers and writers (CSV with pandas-style bad-line rules, Parquet,
             JSON mail intake, verdict and artifact sinks, the ``emails`` view)
  functions  column expressions (text cleaning, sender rules, verdicts,
             templates, deterministic randomness, HTML)
  operators  relational operators (splits, row index, metrics, profiles,
             tokens, model, gates, batch UDF hook)
  plans      multi-step jobs (synthetic table generator, train/evaluate, analyze)
  streaming  Structured Streaming scorer
"""

from tidemail.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
