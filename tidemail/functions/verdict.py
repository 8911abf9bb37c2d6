"""Verdict columns: confidence, label decoding, display texts, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names produced by the classifier.
NEGATIVE_LABEL = "LABEL_0"
EVAL_NEGATIVE_LABELS = ["LABEL_0", "Safe"]

# Verdict texts shown to the user.
HEADLINE_PHISH = "Possible phishing detected"
HEADLINE_SAFE = "No phishing detected"
PATTERN_PHISH = "The AI model detected patterns similar to those found in phishing messages"
PATTERN_SAFE = "The AI model did NOT detect patterns found in phishing in this message"
SENDER_TRUSTED = "This email was sent from an official {org} account"
SENDER_UNTRUSTED = "This email was NOT sent from an official {org} account"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confidence(score) -> Column:
    """floor(score * 100) as bigint; the score of the predicted class."""
    return F.floor(_c(score) * F.lit(100.0)).cast("bigint")


def decode_serving(label) -> Column:
    """F8: anything but the negative label counts as phishing."""
    return _c(label) != F.lit(NEGATIVE_LABEL)


def decode_eval(label) -> Column:
    """negative label or ``Safe`` → 0, anything else → 1."""
    return F.when(_c(label).isin(EVAL_NEGATIVE_LABELS), F.lit(0)).otherwise(F.lit(1))


def verdict_texts(phish, accuracy, trusted, org: str) -> dict[str, Column]:
    """the four display lines, as plain text."""
    p, t = _c(phish), _c(trusted)
    return {
        "headline": F.when(p, F.lit(HEADLINE_PHISH)).otherwise(F.lit(HEADLINE_SAFE)),
        "confidence_line": F.format_string("Confidence: %d%%", _c(accuracy)),
        "pattern_line": F.when(p, F.lit(PATTERN_PHISH)).otherwise(F.lit(PATTERN_SAFE)),
        "sender_line": F.when(t, F.lit(SENDER_TRUSTED.format(org=org)))
                        .otherwise(F.lit(SENDER_UNTRUSTED.format(org=org))),
    }


def iso_ts(ts) -> Column:
    """ISO-8601 with milliseconds and ``Z`` (the session time zone must be UTC
    for zoned timestamps; wall-clock timestamps are printed as stored)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
