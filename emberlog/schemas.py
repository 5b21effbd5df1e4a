"""Row types and fixed values of the library."""

from __future__ import annotations

#: One parsed login attempt, or n equal ones that a log line sums up. source and line_no place it.
LOGIN_EVENT = "ts timestamp, user string, ip string, outcome string, source string, line_no bigint, invalid_user boolean, n int"
#: A line that couldn't be parsed, with the reason.
UNPARSED = "source string, line_no bigint, reason string, text string"
#: One validated security event; absent texts are empty.
SECURITY_EVENT = "ts timestamp, severity string, title string, source string, description string, ip string, user string, origin string"
REJECTED = "origin string, reason string"

#: Severities from most to least severe, their labels, and the names accepted for them.
SEVERITIES = ("critica", "alta", "media", "baja", "info")
SEVERITY_LABELS = ("Crítica", "Alta", "Media", "Baja", "Informativa")
SEVERITY_ALIASES = {
    "critical": "critica", "crítica": "critica", "crítico": "critica", "critico": "critica",
    "high": "alta", "medium": "media", "med": "media", "low": "baja",
    "informational": "info", "informativa": "info",
}
URGENT = ("critica", "alta")
#: What stands for an empty account in a failed attempt, and for an event without a source.
EMPTY_USER, NO_SOURCE = "(vacío)", "(sin fuente)"
