"""Random draws that are plain functions of (seed, row).

`F.rand(seed)` depends on how rows are spread over partitions; these do not, so a
retried task, a second scan or another cluster size draws the same numbers.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60
_WORD = 1 << 32


def hash_draw(seed: int, key) -> Column:
    """Uniform bigint in [0, 2^60) from Spark's 64-bit hash."""
    return F.xxhash64(F.lit(seed), *key).bitwiseAND(F.lit((1 << DRAW_BITS) - 1))


def md5_draw(salt: str, key: Column) -> Column:
    """Uniform bigint in [0, 2^60) from md5; slower, but any SQL engine can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def hash_normals(seed: int, key) -> list[Column]:
    """Three standard normals per row (Box-Muller over the halves of two hashes)."""
    words = []
    for lane in range(2):
        # Chain a second hash over the first: one pass hardly mixes neighbouring seeds.
        mixed = F.xxhash64(F.xxhash64(F.lit(seed), F.lit(lane), *key))
        words.append(F.shiftrightunsigned(mixed, 32))
        words.append(mixed.bitwiseAND(F.lit(_WORD - 1)))
    return _box_muller([_unit(w) for w in words])


def md5_normals(salt: str, key: Column) -> list[Column]:
    """As `hash_normals`, from the four 32-bit words of one md5."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key))
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    return _box_muller([_unit(w) for w in words])


def _unit(word: Column) -> Column:
    """32-bit word to the open interval (0, 1)."""
    return (word + F.lit(0.5)) / F.lit(float(_WORD))


def _box_muller(u: list[Column]) -> list[Column]:
    def radius(a):
        return F.sqrt(F.lit(-2.0) * F.ln(a))

    def angle(b):
        return F.lit(2.0 * math.pi) * b

    return [
        radius(u[0]) * F.cos(angle(u[1])),
        radius(u[0]) * F.sin(angle(u[1])),
        radius(u[2]) * F.cos(angle(u[3])),
    ]
