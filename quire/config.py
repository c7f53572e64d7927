"""Defaults of the document portal.

Every value below is a default argument somewhere in the library; callers
can pass their own.
"""

from __future__ import annotations

from importlib import resources

# --- fixed values: must equal the portal's configuration for equal results ---
# Classification markings in configuration order (first match wins, so the
# longer "sensitive but unclassified" is tried before "unclassified").
CLASSIFICATIONS = [
    "sensitive but unclassified",
    "confidential",
    "secret",
    "noforn",
    "unclassified",
]
# Paragraph markings, in configuration order.
PARA_MARKINGS = ["SBU", "C", "S", "noforn", "U"]
# Display labels of the document page; anything else is "Uncategorized".
CLASSIFICATION_LABELS = {
    "noforn": "Noforn",
    "secret": "Secret",
    "sensitive but unclassified": "Sensitive But Unclassified",
    "unclassified": "Unclassified",
}
UNCATEGORIZED = "Uncategorized"
# Header defaults.
DEFAULT_ADDRESSEE = "The Secretary"
DEFAULT_CATEGORY = "Information Memo"
UNKNOWN = "unknown"
# Body wrapper and scrape targets.
HTML_CLASS = "document"
SCRAPE_HTML_IDS = ["tier3-landing-content", "middlecolumn"]
# Characters removed from HTML before flattening.
REMOVE_CHARS = "\xa0"
# Placeholder body when no start line is found.
NO_START_BODY = "<p>Could not locate start of document - check logs</p>"
# Serving limits and cutoffs.
FEED_LIMIT = 10
TRENDING_DOCS = 30
TRENDING_TERMS = 5
SEARCH_LIMIT = 20
RELATED_LIMIT = 3
RELATED_CUTOFF = 0.95
CHECK_CUTOFF = 0.99
CHECK_LIMIT = 10
PREVIEW_FEED = 50
PREVIEW_RELATED = 15
HEADER_LINES = 5
TOP_TERMS = 3
NGRAM_MAX = 3
# Document-frequency band of the top-term filter, as shares of n.
BAND_LOWER = 0.05
BAND_UPPER = 0.5
# Token rule: runs of two or more word characters (letters, digits, _).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# --- end of fixed values ---


def english_stop_words() -> list[str]:
    """Spark's default English stop list (shipped as a resource file so the
    SQL oracle can use the same words without a JVM)."""
    text = resources.files("quire.resources").joinpath(
        "stopwords_english.txt").read_text(encoding="utf-8")
    return [w for w in text.splitlines() if w]
