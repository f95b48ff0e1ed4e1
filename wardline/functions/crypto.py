"""Digests and keyed digests as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 hex digest of a string or binary column."""
    if not key:
        raise ValueError("a key is required; refusing to digest with a default")
    inner_pad, outer_pad = _pads(key)
    inner = F.sha2(F.concat(F.lit(bytearray(inner_pad)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer_pad)), F.unhex(inner)), 256)


def pseudonymize(identifier: Column, key: bytes | None) -> Column:
    """Stable, non-reversible token: the first 24 hex digits of the keyed digest."""
    if not key:
        raise ValueError("pseudonymisation key is not set")
    return F.substring(hmac_sha256(identifier, key), 1, 24)


def b64url_decode(c: Column) -> Column:
    """Base64url without padding to binary; null when not decodable (tested first, so nothing is thrown per row)."""
    pad = F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4)).cast("int"))
    usable = c.rlike("^[A-Za-z0-9_-]+$") & (F.length(c) % 4 != 1)
    return F.when(usable, F.unbase64(F.concat(F.translate(c, "-_", "+/"), pad)))


def b64url_encode(c: Column) -> Column:
    return F.translate(F.base64(c.cast("binary")), "+/=\r\n", "-_")


def open_token(df: DataFrame, token: str, key: bytes, payload_schema: str, prefix: str) -> DataFrame:
    """Add <prefix>_well_formed, <prefix>_authentic and <prefix>_payload for a ``payload.signature`` token.

    The signature covers the transmitted text of the first segment. The payload is null unless authentic, so
    unverified content can never be read. Built in steps so that each digest is computed once per row.
    """
    c = lambda n: f"{prefix}_{n}"
    df = df.withColumn(c("parts"), F.split(token, r"\."))
    df = df.withColumns({
        c("seg"): F.try_element_at(c("parts"), F.lit(1)), c("sig"): b64url_decode(F.try_element_at(c("parts"), F.lit(2))),
    })
    df = df.withColumns({c("body"): b64url_decode(F.col(c("seg"))).cast("string"), c("mac"): hmac_sha256(F.col(c("seg")), key)})
    shaped = (F.size(c("parts")) == 2) & F.col(c("sig")).isNotNull() & F.get_json_object(c("body"), "$").isNotNull()
    df = df.withColumn(c("well_formed"), F.coalesce(shaped, F.lit(False)))
    good = F.col(c("well_formed")) & F.coalesce(F.lower(F.hex(c("sig"))) == F.col(c("mac")), F.lit(False))
    df = df.withColumn(c("authentic"), good)
    df = df.withColumn(c("payload"), F.from_json(F.when(F.col(c("authentic")), F.col(c("body"))), payload_schema))
    return df.drop(*[c(n) for n in ("parts", "seg", "sig", "body", "mac")])


def sign_token(payload_json: Column, key: bytes) -> Column:
    """Build a token from canonical JSON; used to make test tables, not a key service."""
    seg = b64url_encode(payload_json)
    return F.concat_ws(".", seg, b64url_encode(F.unhex(hmac_sha256(seg, key))))
