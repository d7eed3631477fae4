"""Wallet-address predicate: does a base58 address decode to a point on the Ed25519 curve?

Spark has no big-integer field arithmetic, so this one check is an Arrow UDF. Apply it to
distinct addresses and join the answer back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"   # fixed value
PRIME = 2**255 - 19


def on_curve(address: str) -> bool:
    """Unparseable or wrongly sized addresses count as wallets and stay."""
    if address is None or any(ch not in ALPHABET for ch in address):
        return True
    number = 0
    for ch in address:
        number = number * 58 + ALPHABET.index(ch)
    zeros = len(address) - len(address.lstrip("1"))
    size = zeros + (number.bit_length() + 7) // 8
    if size != 32:
        return True
    y = int.from_bytes(number.to_bytes(32, "big"), "little") % 2**255
    if y >= PRIME:
        return False
    d = -121665 * pow(121666, -1, PRIME) % PRIME
    top, bottom = (y * y - 1) % PRIME, (d * y * y + 1) % PRIME
    if bottom == 0:
        return False
    x2 = top * pow(bottom, -1, PRIME) % PRIME
    return x2 == 0 or pow(x2, (PRIME - 1) // 2, PRIME) == 1


def is_on_curve(col):
    """Arrow-batched column form of `on_curve`."""
    @F.pandas_udf(BooleanType())
    def check(s: pd.Series) -> pd.Series:
        return s.map(on_curve)

    return check(col)
