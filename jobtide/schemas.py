"""Schemas of the tables; feeds and exports are read with these and never inferred."""

from __future__ import annotations

RAW_POSTING = (
    "source string, source_order int, seq long, company string, title string, location string, apply_url string, description string, "
    "term_default string, posted_at timestamp, posted_precision string, remote_hint boolean, source_id string, sponsorship string, degrees array<string>"
)
POSTING = (
    "id string, dedupe_key string, company string, title string, term string, location string, remote boolean, apply_url string, source string, "
    "first_seen_at timestamp, last_seen_at timestamp, posted_at timestamp, posted_precision string, tier int, score int, score_rationale string, "
    "disqualifiers array<string>, recruiter_name string, recruiter_title string, recruiter_url string, draft_note string, status string, "
    "applied_at timestamp, company_norm string, title_norm string, location_norm string, source_id string, source_url string, final_url string, "
    "link_status string, link_checked_at timestamp, tier_source string"
)
BASELINE = "id string, seeded_at timestamp"
EXCLUDED = "id string, company string, title string, apply_url string, term string, source string, filter_reason string, filter_version string, seen_at timestamp"
SUPPRESSION = "baseline_id string, title string, source string, company string, posted_at timestamp, title_norm string, first_at timestamp, last_at timestamp, times_seen long"
SIGHTING = "id string, last_seen_run string, missed_runs int, first_missed_at timestamp"
NOTIFICATION = "posting_id string, tier int, sent_at timestamp"
SCORE_CACHE = "posting_id string, score int, rationale string, tier_source string, scored_at timestamp, model string"
