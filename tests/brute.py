"""The semantics once more as plain Python, for checking the operators on small inputs."""

from __future__ import annotations

import json
import re

# fixed values: the default paths of event names and identities
EVENT_PATHS = ["event", "event_name", "type", "properties.event_name"]
IDENTITY = {
    "userId": ["userId", "user_id", "context.userId", "context.user_id"],
    "anonymousId": ["anonymousId", "anonymous_id", "context.anonymousId"],
    "wallet_address": ["wallet_address", "walletAddress", "properties.wallet_address"],
}


class Members(list):
    """Members of an object in document order, repeated keys included."""


def parse(text):
    try:
        return json.loads(text, object_pairs_hook=Members)
    except ValueError:
        return None


def first(doc, path):
    for segment in path.split("."):
        if not isinstance(doc, Members):
            return None
        doc = next((v for k, v in doc if k == segment), None)
    return doc


def as_text(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return value if isinstance(value, str) else json.dumps(value)


def first_text(doc, paths):
    return next((t for t in (as_text(first(doc, p)) for p in paths) if t), "")


class TooDeep(Exception):
    pass


def flatten(obj, prefix, depth, out):
    if depth > 100:
        raise TooDeep
    for key, value in obj:
        if isinstance(value, Members):
            flatten(value, f"{prefix}.{key}", depth + 1, out)
        else:
            out[f"{prefix}.{key}"] = value


def normalize(text):
    doc = parse(text)
    identity = {k: t for k, paths in IDENTITY.items() if (t := first_text(doc, paths))}
    if "userId" not in identity and "anonymousId" in identity:
        identity["userId"] = identity["anonymousId"]
    flat = {}
    for root in ("properties", "context"):
        if isinstance(first(doc, root), Members):
            flatten(first(doc, root), root, 0, flat)
    return first_text(doc, EVENT_PATHS), identity, flat


def kind(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "integer" if float(value).is_integer() else "number"
    return "string" if isinstance(value, str) else "array"


def errors_of(specs, data):
    out = []
    for prop, s in specs.items():
        if prop not in data:
            out += [(prop, "required")] if s.get("required") else []
            continue
        value, have, want = data[prop], kind(data[prop]), s["type"]
        if not (have == want or (want == "number" and have == "integer")):
            out.append((prop, "type"))
            continue
        rules = s.get("rules", {})
        if have in ("integer", "number"):
            out += [(prop, "min")] if value < rules.get("min", value) else []
            out += [(prop, "max")] if value > rules.get("max", value) else []
        if have == "string":
            out += [(prop, "min_length")] if len(value) < rules.get("min_length", 0) else []
            out += [(prop, "max_length")] if len(value) > rules.get("max_length", len(value)) else []
            out += [(prop, "pattern")] if not re.search(rules.get("pattern", ""), value) else []
            out += [(prop, "enum")] if "values" in s and value not in s["values"] else []
    return sorted(out)


def validate(text, events, identity_keys):
    """(event, status, sorted (property, rule)) with ``events`` as resolved specs by name."""
    try:
        event, identity, flat = normalize(text)
    except TooDeep:
        doc = parse(text)
        return first_text(doc, EVENT_PATHS), "error", [("", "depth")]
    if identity_keys and not any(identity.get(k) for k in identity_keys):
        return event, "invalid", [("", "identity")]
    if event not in events:
        return event, "error", [("", "unknown_event")]
    found = errors_of(events[event], {**flat, **identity})
    return event, "invalid" if found else "valid", found
