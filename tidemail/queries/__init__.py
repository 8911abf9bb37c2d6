"""Registered queries (one module per area); importing registers them."""

from tidemail.queries import (corpus, csvio, generator, html, intake, metrics, pieces, profiles,  # noqa: F401
                              stream, tokens, verdicts)
