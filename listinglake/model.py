"""Schemas. Explicit everywhere: nothing is inferred, and an absent optional key reads as null."""

from __future__ import annotations

# One wide row per log entry; the columns an entry's kind does not use are null.
OBSERVED, CLASSIFIED, REPLACED, RENDERED = "observed", "classified", "replaced", "rendered"
KINDS = [OBSERVED, CLASSIFIED, REPLACED, RENDERED]
METAL, OTHER, PENDING = "Metal", "Other", "Pending"
LLM, USER = "LLM", "User"

KEY = ["venue_id", "url"]
GIG_FIELDS = ["title", "date", "poster_url", "description"]

LOG_SCHEMA = (
    "_type string, seq bigint, recorded_at timestamp_ntz, venue_id string, url string, "
    "title string, date date, poster_url string, description string, "
    "genre string, source string, llm_model string, use_vision boolean, "
    "input_tokens int, output_tokens int, "
    "by_venue_id string, by_url string, "
    "file string, gig_count int, logical_date date"
)
LOG_COLUMNS = [field.split()[0] for field in LOG_SCHEMA.split(", ")]

# The newline-delimited JSON a log file holds, one object per entry.
LOG_JSON_SCHEMA = (
    "_type string, seq bigint, recordedAt string, "
    "gig struct<title: string, venue: string, date: string, url: string, "
    "posterUrl: string, description: string>, "
    "venue string, url string, genre string, source string, llmModel string, useVision boolean, "
    "inputTokens int, outputTokens int, byVenue string, byUrl string, "
    "file string, gigCount int, logicalDate string"
)

LISTING_SCHEMA = (
    "venue_id string, listing_pos bigint, url string, title string, date date, "
    "poster_url string, description string"
)
PAGES_SCHEMA = "venue_id string, url string, page_no int, status int, body string"
