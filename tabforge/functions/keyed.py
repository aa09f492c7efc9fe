"""Keyed hashes as Catalyst expressions: HMAC-SHA256 by composition of sha2, and seeds on the driver.

Plans hold the key material as literals: never print plans of frames that use a private key.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains of the two row streams (give others to read splits made elsewhere), and floor(2**64 * 4 / 5) as hex.
PARTITION_DOMAIN = b"tabforge/train-holdout/v1\0"
PRIORITY_DOMAIN = b"tabforge/training-priority/v1\0"
TRAIN_BELOW = "cccccccccccccccc"
LEAST_KEY_BYTES = 32


def pads(key: bytes, domain: bytes = b"") -> tuple[str, str]:
    """Hex of the inner pad followed by the domain, and of the outer pad."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex() + domain.hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_hex(message: Column, key: bytes, domain: bytes = b"") -> Column:
    """HMAC-SHA256 of domain followed by a binary message, as 64 hex digits."""
    inner, outer = pads(key, domain)
    binary = lambda h: F.unhex(F.lit(h))
    return F.sha2(F.concat(binary(outer), F.unhex(F.sha2(F.concat(binary(inner), message), 256))), 256)


def big_endian(value: Column) -> Column:
    """The 8 bytes of a long, most significant first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def row_hash(row_id: Column, key: bytes, domain: bytes) -> Column:
    """The keyed hash of a non-negative row id; hex order is unsigned order."""
    if len(key) < LEAST_KEY_BYTES:
        raise ValueError(f"keys have at least {LEAST_KEY_BYTES} bytes")
    return hmac_hex(big_endian(row_id), key, domain)


def in_train(row_id: Column, key: bytes, domain: bytes = PARTITION_DOMAIN) -> Column:
    """Whether a row is in the four fifths for training."""
    return F.substring(row_hash(row_id, key, domain), 1, 16) < TRAIN_BELOW


def priority(row_id: Column, key: bytes, domain: bytes = PRIORITY_DOMAIN) -> Column:
    """A second, independent stream: the first 16 hex digits order rows for sampling."""
    return F.substring(row_hash(row_id, key, domain), 1, 16)


def derive_u64(key: bytes, label: str) -> int:
    return int.from_bytes(hmac.new(key, label.encode(), hashlib.sha256).digest()[:8], "big")


def hkdf(key: bytes, info: bytes, length: int, salt: bytes = b"") -> bytes:
    """HKDF-SHA256 (RFC 5869)."""
    secret = hmac.new(salt or bytes(32), key, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < length:
        block = hmac.new(secret, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:length]


def uuid4_of(index: Column, prefix: str = "tabforge:") -> Column:
    """A version 4 UUID made of the SHA-256 of a prefix and an index."""
    h = F.sha2(F.concat(F.lit(prefix), index.cast("string")).cast("binary"), 256)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
