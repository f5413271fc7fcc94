"""Signatures (version 4) of requests to object stores and their catalogs."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import time
import urllib.parse


def _encode(text: str, safe: str = "") -> str:
    return urllib.parse.quote(text, safe="-_.~" + safe)


def canonical_request(method: str, url: str, headers: dict[str, str], payload_hash: str, service: str) -> tuple[str, str]:
    """``(canonical request, signed header names)``; paths are encoded twice but for s3."""
    u = urllib.parse.urlsplit(url)
    path = u.path or "/"
    if service != "s3":
        path = _encode(path, "/")
    else:
        path = _encode(urllib.parse.unquote(path), "/")
    pairs = sorted((_encode(k), _encode(v)) for k, v in urllib.parse.parse_qsl(u.query, keep_blank_values=True))
    low = {k.lower(): " ".join(str(v).split()) for k, v in headers.items()}
    names = ";".join(sorted(low))
    lines = [method.upper(), path, "&".join(f"{k}={v}" for k, v in pairs), *[f"{k}:{low[k]}" for k in sorted(low)], "", names, payload_hash]
    return "\n".join(lines), names


def signing_key(secret: str, date: str, region: str, service: str) -> bytes:
    key = ("AWS4" + secret).encode()
    for part in (date, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def signer(region: str, service: str, credentials: dict, clock=time.time):
    """A function (method, url, headers, body) -> headers to add. ``credentials``: access_key,
    secret_key, and session_token if there is one."""

    def sign(method: str, url: str, headers: dict, body: bytes) -> dict:
        now = dt.datetime.fromtimestamp(clock(), dt.timezone.utc)
        stamp, date = now.strftime("%Y%m%dT%H%M%SZ"), now.strftime("%Y%m%d")
        digest = hashlib.sha256(body).hexdigest()
        out = {"x-amz-date": stamp}
        if service in ("s3", "s3tables"):
            out["x-amz-content-sha256"] = digest
        if credentials.get("session_token"):
            out["x-amz-security-token"] = credentials["session_token"]
        signed = {"host": urllib.parse.urlsplit(url).netloc} | out
        request, names = canonical_request(method, url, signed, digest, service)
        scope = f"{date}/{region}/{service}/aws4_request"
        text = "\n".join(["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(request.encode()).hexdigest()])
        mac = hmac.new(signing_key(credentials["secret_key"], date, region, service), text.encode(), hashlib.sha256).hexdigest()
        return out | {"Authorization": f"AWS4-HMAC-SHA256 Credential={credentials['access_key']}/{scope}, SignedHeaders={names}, Signature={mac}"}

    return sign
