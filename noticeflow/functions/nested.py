"""Nested JSON values as columns of text (F6, P10, P13, P22): canonical forms, projections and redactions of any depth.

Spark has no recursive expression, and byte parity with Python's own JSON needs Python's own: each function parses and
writes a value in Arrow batches. Text that isn't JSON, and null, give null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys that public values may have.
PUBLIC_KEYS = tuple(
    """
    schema_version title buyer_name procurement_type lifecycle_stage estimated_amount currency published_at closes_at status regions
    required_certifications required_capabilities participation_constraints contract_period description body attachments evidence
    is_synthetic official_references normalized_identifiers source_id source_record_id raw_record_id payload_sha256 json_pointer field
    value normalizer kind filename sha256 attachment_sha256 attachment_id version_id page_number quote text parser_kind parser_version
    scheme fields ruleset parent_version_id child_version_id bounded budget before after before_evidence after_evidence codes reason
    upstream attachment ranking_version as_of weights feature_reasons lexical capability category amount recency_deadline
    eligibility_gate eligibility_hard_failures eligibility_warnings semantic_enabled deadline_state deadline provider provider_version
    synthetic recognition_status pages quality reasons char_count non_whitespace_chars printable_ratio alphanumeric_ratio error
    ranking_result_id final_score explanation delta_id field_changes document_changes impact_level reason_codes from_version_id
    to_version_id outcome_opportunity_id outcome_version_id watched_opportunity_id link_ids
    """.split()
)
#: Parts of keys whose values are secret, what stands for them, and the longest text that is kept.
SECRET_PARTS = ("authorization", "cookie", "password", "secret", "token", "api_key", "apikey", "recipient", "destination", "email")
REDACTED, LONGEST, CUT = "[REDACTED]", 1000, "...[TRUNCATED]"
#: Separators of compact and of spaced JSON.
COMPACT, SPACED = (",", ":"), (", ", ": ")


class _NotJson:
    """Stands for text without a JSON value (null is one)."""


def _parsed(text: str | None) -> Any:
    if text is None:
        return _NotJson
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _NotJson


def _rebuilt(value: Any, of_object: Callable[[dict, dict], dict], of_leaf: Callable[[Any, str | None], Any], field: str | None = None) -> Any:
    """The value made anew from its leaves up: of_leaf(leaf, key above it), of_object(object as it was, object made of its members)."""
    if isinstance(value, list):
        return [_rebuilt(v, of_object, of_leaf, field) for v in value]
    if isinstance(value, dict):
        return of_object(value, {k: _rebuilt(v, of_object, of_leaf, k) for k, v in value.items()})
    return of_leaf(value, field)


def _texts(c: Column, make: Callable[..., Any], *more: Column, ascii_: bool = False, separators: tuple[str, str] = COMPACT, numbers: bool = True) -> Column:
    """JSON text with sorted keys of what `make` returns for each value (and the texts of `more` beside it)."""

    def one(text: str | None, *rest) -> str | None:
        value = _parsed(text)
        if value is _NotJson:
            return None
        try:
            return json.dumps(make(value, *rest), sort_keys=True, ensure_ascii=ascii_, separators=separators, allow_nan=numbers)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(texts, *rest)], dtype=object)

    return run(c, *more)


def canonical(c: Column, *, ascii_: bool = False, separators: tuple[str, str] = COMPACT, numbers: bool = True) -> Column:
    """the value with sorted keys. ascii_: escapes beyond ASCII; numbers: NaN and infinities stay (else such a value is null)."""
    return _texts(c, lambda v: v, ascii_=ascii_, separators=separators, numbers=numbers)


def digest(c: Column, **form) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical(c, **form), 256)


def job_key(kind: Column, source: Column, payload: Column) -> Column:
    """SHA-256 of kind, source and canonical ASCII payload, joined by NUL characters."""
    return F.sha2(F.concat(kind, F.lit("\x00"), source, F.lit("\x00"), canonical(payload, ascii_=True)), 256)


def without(c: Column, part: str) -> Column:
    """The value without any key that contains `part`, at any depth, in canonical form."""
    keep = lambda _, made: {k: v for k, v in made.items() if part not in k}
    return _texts(c, lambda v: _rebuilt(v, keep, lambda x, _: x))


def _document(was: dict, known: list[dict]) -> dict | None:
    """The one stored document that an object names, by id, or else by checksum and address."""
    if isinstance(name := was.get("attachment_id"), str):
        return next((d for d in known if d["id"] == name), None)
    asked = {"sha256": was["attachment_sha256"] if "attachment_sha256" in was else was.get("sha256"), "source_url": was["source_url"] if "source_url" in was else was.get("url")}
    given = {k: v for k, v in asked.items() if isinstance(v, str)}
    fit = [d for d in known if all(d.get(k) == v for k, v in given.items())] if given else []
    return fit[0] if len(fit) == 1 else None


def _handle(name: str) -> str:
    return f"/api/v1/documents/{name}/original"


def _is_uuid(name: str) -> bool:
    try:
        return bool(uuid.UUID(name))
    except ValueError:
        return False


def public(c: Column, documents: Column | None = None, keys: tuple[str, ...] = PUBLIC_KEYS) -> Column:
    """P10: the value with allowed keys only, at any depth, in canonical form.

    documents: JSON list of the version's documents (id, sha256, source_url, stored). An object that names exactly one of them gets its id,
    checksum and internal handle (null if it isn't stored); an object that has a handle of its own id keeps it. No other address
    is shown, and a text under `attachments` stands for a document of that address.
    """
    allowed = frozenset(keys)

    def project(value: Any, listed: str | None = None) -> Any:
        known = json.loads(listed) if listed else []

        def shown(was: dict, made: dict) -> dict:
            out = {k: v for k, v in made.items() if k in allowed}
            name, url = was.get("attachment_id"), was.get("original_url")
            if (d := _document(was, known)) is not None:
                out |= {"attachment_id": d["id"], "sha256": d.get("sha256"), "original_url": _handle(d["id"]) if d.get("stored") and d.get("sha256") else None}
            elif isinstance(name, str) and (url is None or (_is_uuid(name) and url == _handle(str(uuid.UUID(name))))):
                out["original_url"] = url
            return out

        return _rebuilt(value, shown, lambda x, field: shown({"source_url": x}, {}) if field == "attachments" and isinstance(x, str) else x)

    return _texts(c, project, *([] if documents is None else [documents]))


def redacted(c: Column) -> Column:
    """Values of keys that name a secret (in any case) hidden, and long texts cut, in canonical form."""
    hide = lambda _, made: {k: REDACTED if any(p in k.lower() for p in SECRET_PARTS) else v for k, v in made.items()}
    short = lambda x, _: x[:LONGEST] + CUT if isinstance(x, str) and len(x) > LONGEST else x
    return _texts(c, lambda v: _rebuilt(v, hide, short))
