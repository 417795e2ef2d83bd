"""Text expressions: report fields, secrets, figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revpulse import fixed

# (?d): only \n ends a line; (?U): \s covers all Unicode spaces; (?s): dot spans lines.
_LINES = "(?dU)"
_BLOCKS = "(?dUs)"
_STRIP = r"(?dU)^\s+|\s+\z"

# Two code points that are never text mark what a match was until the wording is put in.
_MARK, _END = "﷐", "﷑"
_SECRET = "(?iU)" + fixed.SECRETS


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _extract(text: Column, flags: str, pattern: str, must_contain: str) -> Column:
    """First group of a pattern, empty when absent.

    Every match contains ``must_contain``, and finding a literal is far cheaper than
    starting the pattern at each character of a long text.
    """
    return F.when(text.contains(must_contain), F.regexp_extract(text, flags + pattern, 1)).otherwise(F.lit(""))


def report_body(text: Column) -> Column:
    """The marked block of a report, or the whole text when there is none."""
    pattern = _BLOCKS + fixed.REPORT_BLOCK
    marked = text.contains("ANOMALY_REPORT_START") & text.rlike(pattern)
    return F.when(marked, F.regexp_extract(text, pattern, 1)).otherwise(text)


def report_confidence(body: Column) -> Column:
    """Stated confidence in 0..1 (85 means 0.85); null when absent."""
    value = _extract(body, _LINES, fixed.REPORT_CONFIDENCE, "onfidence").try_cast("double")
    share = F.when(value > 1.0, value / 100.0).otherwise(value)
    return F.when(value.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def report_loss(body: Column) -> Column:
    """Stated loss; null when absent or not a number."""
    value = _extract(body, _LINES, fixed.REPORT_LOSS, "stimated")
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def report_cause(body: Column) -> Column:
    return squeeze(_extract(body, _BLOCKS, fixed.REPORT_CAUSE, "oot"))


def report_action(body: Column) -> Column:
    return squeeze(_extract(body, _BLOCKS, fixed.REPORT_ACTION, "ecommended"))


def last_long_paragraph(text: Column) -> Column:
    """The start of the last long paragraph, as reports state it; empty when there is none."""
    paragraphs = F.filter(
        F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > fixed.PARAGRAPH_MIN
    )
    return F.coalesce(F.substring(F.try_element_at(paragraphs, F.lit(-1)), 1, fixed.PARAGRAPH_SHOWN), F.lit(""))


def masked(text: Column) -> Column:
    """key=value secrets and DSN passwords replaced, in one left-to-right pass.

    Both kinds are alternatives of one pattern, because a second pass would see the
    first pass's output.  An unmatched group is empty, so the marks tell them apart.
    """
    marked = F.regexp_replace(text, _SECRET, f"$1{_MARK}$2{_END}")
    dsn = F.replace(marked, F.lit(f"{_MARK}:{_END}"), F.lit(":[REDACTED]@"))
    return F.replace(dsn, F.lit(f"{_MARK}{_END}"), F.lit(": [REDACTED]"))


def rupees(amount: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(amount.cast("double"), 2))
