"""Deterministic hash fractions, splits and orders, as JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantle.constants import RECTANGLE_FRACTION, SEED, SPLIT_FRACTION


def hash_prefix(value: Column, namespace: str, seed: int = SEED) -> Column:
    """The first 16 hex digits of sha256("seed:namespace:value"); sorts like the 64-bit number."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:{namespace}:"), value.cast("string")), 256), 1, 16)


def stable_fraction(value: Column, namespace: str, seed: int = SEED) -> Column:
    """The prefix as a number in [0, 1)."""
    whole = F.conv(hash_prefix(value, namespace, seed), 16, 10).cast("decimal(20,0)")
    return whole.cast("double") / F.lit(2.0**64)


def split_of(value: Column, seed: int = SEED, train_fraction: float = SPLIT_FRACTION) -> Column:
    """``train`` or ``validation`` by id alone."""
    if not 0.0 < train_fraction < 1.0:
        raise ValueError("train_fraction must lie strictly between 0 and 1")
    return F.when(stable_fraction(value, "split", seed) < train_fraction, "train").otherwise("validation")


def keeps_sample(value: Column, difficulty: Column, seed: int = SEED, fraction: float = RECTANGLE_FRACTION) -> Column:
    """All but simple rectangles stay; of these a hash-chosen share."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")
    return (difficulty != "simple_rectangle") | (stable_fraction(value, "rectangle", seed) < fraction)


def shuffle_key(value: Column, epoch: int, seed: int = SEED) -> Column:
    """A sort key that deals rows in another order each epoch."""
    return hash_prefix(value, f"shuffle{epoch}", seed)
