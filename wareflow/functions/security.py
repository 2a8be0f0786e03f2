"""Masking of personal data in logs, keyed user hashes and canonical JSON hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[REDACTED]"
# Patterns of phone numbers, e-mail addresses and API keys, in the order they apply.
PHONE = r"(?:84|0[3|5|7|8|9])+([0-9]{8})\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
API_KEY = r"\bsk-[A-Za-z0-9-]{16,}\b"


def mask(c: Column) -> Column:
    for pattern in (PHONE, EMAIL, API_KEY):
        c = F.regexp_replace(c, pattern, MASK)
    return c


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 of UTF-8 text, in hex, from two nested hashes; the key stays on the driver."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def user_hash(user: Column, salt: str, version: str = "v1") -> Column:
    return hmac_sha256(f"{salt}:{version}", user.cast("string"))


def canonical_json(**fields: Column) -> Column:
    """JSON object with sorted keys, nulls kept and no spaces."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def price_state_hash(price: Column, list_price: Column, sale: Column, build: Column, regional: Column, status: Column, quantity: Column) -> Column:
    """Hash of the seven parts of a price state."""
    return F.sha2(canonical_json(price_vnd=price, list_price_vnd=list_price, sale_price_vnd=sale, build_pc_price_vnd=build, regional_price_vnd=regional, stock_status=status, stock_quantity=quantity), 256)
