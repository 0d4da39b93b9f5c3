"""HMAC-SHA256 as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64  # SHA-256 block size in bytes


def hmac_sha256_hex(secret: bytes | str, body: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column: sha2(opad || sha2(ipad || body)).

    The key pads are computed once on the driver from the secret (a constant)
    and enter the plan as binary literals; the per-row work is two native
    SHA-256 calls.
    """
    key = secret.encode("utf-8") if isinstance(secret, str) else bytes(secret)
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    ipad = bytes(b ^ 0x36 for b in key)
    opad = bytes(b ^ 0x5C for b in key)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), body), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)
