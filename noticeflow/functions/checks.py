"""What outside systems send, checked in column expressions (F3, F21, F31, F32, F36): media types, addresses, signatures, answers."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types that a header may state, starts of HTML, and what a signature may look like and how old it may be.
MEDIA_TYPES = ("application/pdf", "text/html", "application/xhtml+xml", "application/x-hwp", "application/haansofthwp")
HTML_STARTS = ("<!doctype html", "<html", "<h1", "<p")
SIGNATURE, STAMP, MOST_SIGNATURE, MOST_BODY, SKEW_S = r"^[a-fA-F0-9]{64}$", r"^[0-9]{1,12}$", 4096, 262_144, 300
FINISHES = ("stop", "length", "content_filter", "tool_calls", "function_call")


def media_type(content: Column, header: Column, allowed: tuple[str, ...] = MEDIA_TYPES) -> Column:
    """what a binary's first bytes say, else an allowed type of its header, else null. Null content has no bytes."""
    head = F.coalesce(F.substring(content, 1, 1024), F.lit(b""))
    # one character per byte: any bytes can be looked at as text
    text = F.decode(head, "ISO-8859-1")
    start = F.lower(F.regexp_replace(text, r"^[ \t\n\r\x0b\f]+", ""))
    html = F.lit(False)
    for s in HTML_STARTS:
        html = html | start.startswith(s)
    stated = F.lower(F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))
    return F.when(text.startswith("%PDF-"), "application/pdf").when(html, "text/html").when(text.startswith("HWP Document File"), "application/x-hwp").when(stated.isin(*allowed), stated)


def public_literal(host: Column) -> Column:
    """whether an address literal is public; null for names."""

    def one(text: str | None) -> bool | None:
        try:
            ip = ipaddress.ip_address((text or "").strip("[]"))
        except ValueError:
            return None
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)

    @F.pandas_udf("boolean")
    def run(hosts: pd.Series) -> pd.Series:
        return hosts.map(one).astype(object)

    return run(host)


def unsafe_url(url: Column, allowed_host: Column) -> Column:
    """why an attachment's address isn't fetched, or null: credentials or no HTTPS, another host, an address that isn't public. Names aren't resolved here."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    host = part("HOST")
    plain = F.coalesce((part("PROTOCOL") == "https") & (F.coalesce(part("USERINFO"), F.lit("")) == ""), F.lit(False))
    other = ~F.coalesce(F.lower(host) == F.lower(allowed_host), F.lit(False))
    return F.when(~plain, "https_without_credentials_required").when(other, "host_not_allowed").when(~F.coalesce(public_literal(host), F.lit(True)), "address_not_public")


def hmac_sha256(message: Column, secret: str) -> Column:
    """Hexadecimal HMAC-SHA-256 of a binary: the two padded keys are constants, the hashes Spark's own."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def signed(body: Column, header: Column, secret: str, now: Column) -> Column:
    """whether a header (t=seconds,v1=hex,...) signs the body: one time, within five minutes of now (seconds), and any of its signatures right."""
    parts = F.transform(F.split(header, ","), lambda p: F.trim(p))
    of = lambda name: F.transform(F.filter(parts, lambda p: F.substring_index(p, "=", 1) == name), lambda p: F.substr(p, F.lit(len(name) + 2)))
    times, found = of("t"), F.transform(F.filter(of("v1"), lambda s: s.rlike(SIGNATURE)), lambda s: F.lower(s))
    stamp = F.get(times, F.lit(0))
    raw = body.cast("binary")
    right = F.array_contains(found, hmac_sha256(F.concat(stamp.cast("binary"), F.lit(b"."), raw), secret))
    shaped = (F.length(raw) <= MOST_BODY) & (F.length(header) <= MOST_SIGNATURE) & F.forall(parts, lambda p: F.contains(p, F.lit("="))) & (F.size(times) == 1) & stamp.rlike(STAMP)
    return F.coalesce(shaped & (F.abs(now - stamp.try_cast("long")) <= SKEW_S) & right, F.lit(False)) if secret else F.lit(False)


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key comes twice")
    return out


def _refused(_: str) -> None:
    raise ValueError("not a finite number")


def strict_json(c: Column) -> Column:
    """whether text is a JSON object without repeated keys and numbers that aren't finite, at any depth."""

    def one(text: str | None) -> bool:
        try:
            return isinstance(json.loads(text or "", object_pairs_hook=_unique, parse_constant=_refused), dict)
        except (ValueError, RecursionError):
            return False

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(c)


def answer(response: Column) -> dict[str, Column]:
    """F32: of a model's response (JSON): status, finish (other for unknown ones), format, content (without its fence), prompt_tokens, completion_tokens and usage.

    Usage is read whether or not the answer is. A fence counts only if it holds all of the content.
    """
    value = F.try_parse_json(response)
    get = lambda path, kind: F.try_variant_get(value, path, kind)
    has = lambda path: F.try_variant_get(value, path, "variant").isNotNull()
    schema = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    content, finish = get("$.choices[0].message.content", "string"), get("$.choices[0].finish_reason", "string")
    fence = r"(?is)^\s*```(?:json)?[ \t]*\r?\n(.*?)\r?\n```\s*$"
    fenced = content.rlike(fence)
    bare = F.when(fenced, F.regexp_extract(content, fence, 1)).otherwise(content)
    is_text = schema("$.choices[0].message.content") == "STRING"
    object_ = F.schema_of_variant(value).startswith("OBJECT")
    inner = F.try_parse_json(bare)
    whole = lambda path: F.when(schema(path) == "BIGINT", get(path, "long"))
    count = lambda path: F.when(whole(path) >= 0, whole(path))
    prompt, completion = count("$.usage.prompt_tokens"), count("$.usage.completion_tokens")
    refusal = F.coalesce(get("$.choices[0].message.refusal", "string"), F.lit(""))
    status = (
        F.when(value.isNull(), "invalid_json").when(~object_ | ~has("$.choices[0].message"), "invalid_envelope").when(~refusal.isin("", "false"), "refused").when(~finish.eqNullSafe(F.lit("stop")), "incomplete_response")
        .when(~F.coalesce(is_text, F.lit(False)), "invalid_envelope").when(inner.isNull(), "invalid_json").when(~F.schema_of_variant(inner).startswith("OBJECT"), "non_object_json").otherwise("parsed")
    )
    usage = F.when(prompt.isNotNull() & completion.isNotNull(), "reported").when(prompt.isNotNull() | completion.isNotNull(), "partial").otherwise("unknown")
    return {
        "status": status, "finish": F.when(finish.isin(*FINISHES), finish).when(finish.isNotNull(), "other"), "format": F.when(is_text, F.when(fenced, "json_fence").otherwise("plain")), "content": F.when(status == "parsed", bare),
        "prompt_tokens": prompt, "completion_tokens": completion, "usage": usage,
    }


def compact_nfc(c: Column) -> Column:
    """composed text (NFC) without any white space. ASCII text needs no Python."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.regexp_replace(composed(c), r"(?U)\s+", "")
