"""Packaging of results on the driver: cursors, limits, response modes, pagination notes."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Any

VERSION = 1
TTL_MINUTES, MAX_ITEMS, MAX_BYTES, INLINE_BYTES = 60, 1000, 5_000_000, 8192


class CursorError(ValueError):
    pass


def bounded_limit(raw: Any, most: int = MAX_ITEMS, default: int = 50) -> int:
    """A limit between 1 and ``most``; the default for anything that is no whole number."""
    if isinstance(raw, bool) or not isinstance(raw, int):
        return min(default, most)
    return max(1, min(raw, most))


def encode_cursor(tool: str, artifact_id: str, position: dict, bindings: dict, now: datetime | None = None, ttl: int = TTL_MINUTES) -> str:
    now = now or datetime.now(UTC)
    payload = {"v": VERSION, "tool": tool, "artifact_id": artifact_id, "position": position, "bindings": bindings, "issued_at": now.isoformat(), "expires_at": (now + timedelta(minutes=ttl)).isoformat()}
    return base64.urlsafe_b64encode(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(token: str, tool: str, artifact_id: str, bindings: dict, now: datetime | None = None) -> dict:
    """The position of a cursor; it must be of this tool, artifact and version, not expired, and bound to the same data."""
    try:
        payload = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        expires = datetime.fromisoformat(payload["expires_at"].replace("Z", "+00:00"))
        position = payload["position"]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise CursorError("INVALID") from e
    if payload.get("v") != VERSION or payload.get("tool") != tool or payload.get("artifact_id") != artifact_id:
        raise CursorError("MISMATCH")
    if (now or datetime.now(UTC)) >= expires:
        raise CursorError("EXPIRED")
    if payload.get("bindings") != bindings:
        raise CursorError("STALE")
    return position


def select_bindings(scope: str, root_path: str, paths: list[str], where_hash: str | None, order_by: str | None, related_hash: str | None) -> dict:
    """What a select cursor is bound to."""
    h = hashlib.sha256(json.dumps(paths).encode()).hexdigest()
    return {"scope": scope, "root_path": root_path, "paths_hash": h, "where_hash": where_hash, "order_by": order_by, "related_set_hash": related_hash}


def response_mode(size: int, has_next: bool, limit: int = INLINE_BYTES) -> str:
    """``full`` for small complete results, ``schema_ref`` otherwise."""
    return "full" if size <= limit and not has_next else "schema_ref"


def retrieval_page(items: list, limit: int) -> tuple[list, bool]:
    """The page of a query that fetched one row more, and whether another follows."""
    return items[:limit], len(items) > limit


@dataclass(frozen=True)
class PaginationNote:
    layer: str
    partial: bool
    reason: str | None
    next_kind: str | None

    def as_dict(self) -> dict:
        return {"layer": self.layer, "retrieval_status": "PARTIAL" if self.partial else "COMPLETE", "partial_reason": self.reason, "has_more": self.partial, "next_kind": self.next_kind}


def retrieval_note(truncated: bool, cursor: str | None) -> dict:
    return PaginationNote("artifact_retrieval", truncated, "CURSOR_AVAILABLE" if truncated and cursor else None, "cursor" if cursor else None).as_dict()


def upstream_note(state: str, reason: str | None, next_params: dict | None) -> dict:
    return PaginationNote("upstream", state == "PARTIAL", reason if state == "PARTIAL" else None, "params" if next_params else None).as_dict()


def auto_paginate_limits(override: dict | None, defaults: dict) -> dict:
    """Limits of pages, records and seconds, overridden one by one by positive numbers."""
    override = override or {}
    return {k: override[k] if isinstance(override.get(k), (int, float)) and not isinstance(override[k], bool) and override[k] > 0 else v for k, v in defaults.items()}
