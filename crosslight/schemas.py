"""Schemas of what lies between the stages."""

from __future__ import annotations

#: Raw payload with its origin, as a receiver lands it.
ENVELOPE = "tenant_id string, feed_id string, vendor string, batch_id string, received_at long, payload string"

#: Common model of a normalised event.
EVENT = (
    "tenant_id string, feed_id string, event_id string, vendor string, event_time long, event_time_original string, received_at long, "
    "vendor_request_id string, vendor_event_id string, linked_request_id string, client_ip string, client_ip_shared boolean, client_asn long, "
    "client_country string, request_host string, request_path string, request_query string, request_method string, user_agent string, http_status int, "
    "ja4 string, verdict string, verdict_reason string, rule_id string, rule_ids array<string>, score double, score_kind string, waf_attack_score int, "
    "waf_action string, waf_source string, matched_rule string, violation string, ingest_version long"
)
EVENT_COLUMNS = [part.split()[0] for part in EVENT.split(", ")]
