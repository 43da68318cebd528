"""Instructions and links hidden in source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of embedded instructions.
INSTRUCTIONS = (
    r"ignore\s+(?:all\s+)?previous\s+instructions",
    r"disregard\s+(?:the\s+)?system\s+message",
    r"return\s+[^.]{0,100}\b(?:verified|approved|true)\b",
    r"mark\s+(?:this|the)\s+(?:claim|value)\s+as\s+verified",
    r"(?:exfiltrate|leak|print|reveal)\s+(?:the\s+)?(?:key|secret|prompt|credential)",
    r"(?:assistant|developer|system)\s*:\s*",
)
LINK = r"https?://\S+"
VERB = r"(?:visit|open|fetch|send)\b"


def security_flags(text: Column) -> Column:
    """Sorted flags of a text."""
    instruction = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in INSTRUCTIONS))
    exfiltration = text.rlike(f"(?i){LINK}") & text.rlike(f"(?i){VERB}")
    return F.array_compact(F.array(F.when(instruction, "document-instruction"), F.when(exfiltration, "document-exfiltration-url")))


def is_admissible(text: Column, requested_status: Column) -> Column:
    """There is evidence, it isn't suspicious, and no status is asked for that only reviewers give."""
    asked = F.coalesce(requested_status, F.lit("")).isin("verified", "approved")
    return (F.coalesce(text, F.lit("")) != "") & (F.size(security_flags(text)) == 0) & ~asked
