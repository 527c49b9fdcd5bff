"""Requests to the query service: their shapes, defaults and texts. Plain Python: one request at a time."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

# The kinds of query, and what the second shape carries along.
QUERY_TYPES = ("brand_lookup", "audience_dive", "outreach_angle", "data_pull", "email_findings")
DEFAULT_TYPE = "data_pull"
HINTS = ("intentHint", "intent_hint", "intent")
CARRIED = ("strategistContext", "debug", "intentHint", "intent", "mode")


@dataclass
class Request:
    prompt: str
    query_type: str = DEFAULT_TYPE
    extra_context: dict = field(default_factory=dict)
    prior_conversation_context: object = None


def known_type(name: object) -> str:
    return name if name in QUERY_TYPES else DEFAULT_TYPE


def normalised(body: dict, carried: tuple[str, ...] = CARRIED) -> Request:
    """A request from either shape: ``prompt`` with ``query_type``, or ``query`` with an intent under
    one of three names, of which the fields of the ``carried`` names go along. Unknown kinds are data
    pulls; a body of neither shape is refused."""
    prior = body.get("prior_conversation_context") or body.get("priorConversationContext")
    text = lambda name: body.get(name) if isinstance(body.get(name), str) and body.get(name) else None
    if (prompt := text("prompt")) is not None:
        return Request(prompt, known_type(body.get("query_type")), {}, prior)
    if (query := text("query")) is not None:
        hint = next((body[h] for h in HINTS if body.get(h)), None)
        extra = {name: bool(body[name]) if name == "debug" else body[name] for name in carried if body.get(name)}
        return Request(query, known_type(hint), extra, prior)
    raise ValueError("a request needs a prompt or a query")


def segment_text(generation: str | None = None, gender: str | None = None, income: str | None = None) -> str:
    return ", ".join(x for x in (generation, gender, income) if x)


def salvaged(text: str, name: str) -> str | None:
    """The string field of a JSON object that may be cut off in the middle."""
    found = re.search(rf'"{re.escape(name)}"\s*:\s*"((?:[^"\\]|\\.)*)', text, re.S)
    if not found:
        return None
    raw = found[1]
    while raw:
        try:
            return json.loads(f'"{raw}"', strict=False)
        except json.JSONDecodeError:
            raw = raw[:-1]
    return ""
