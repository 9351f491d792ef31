"""Hash-based columns: canonical event JSON, payload digests, name-based ids, uniforms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the namespace under which population ids are rewritten.
REKEY_NAMESPACE = "6f3c2f0e-9d3b-4c6a-8f1e-2b7a9c4d5e61"


def canonical_event(kind: str | Column, payload: dict[str, Column]) -> Column:
    """The event as JSON with sorted keys, no spaces and UTF-8 text."""
    fields = [payload[name].alias(name) for name in sorted(payload)]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.to_json(F.struct(kind.alias("event_type"), F.struct(*fields).alias("payload")))


def payload_hash(kind: str, payload: dict[str, Column]) -> Column:
    return F.sha2(canonical_event(kind, payload), 256)


def has_control_characters(value: Column) -> Column:
    """Text with one of the three characters that writers of canonical JSON escape differently."""
    return value.rlike(r"[\x01\x1F\x7F]")


def uuid5(name: Column, namespace: str = REKEY_NAMESPACE) -> Column:
    """Name-based UUID, version 5: SHA-1 over the namespace bytes and the UTF-8 name."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    variant = F.substring(
        F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + F.lit(1), F.lit(1)
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def rekey(population: str, value: Column) -> Column:
    """An id rewritten under a population name; an empty one stays empty."""
    return F.when(value == "", value).otherwise(uuid5(F.concat(F.lit(f"{population}/"), value)))


def seeded_digest(seed: int | str, *parts: Column) -> Column:
    """A digest of the seed and the parts: the sort key of order-independent sampling."""
    return F.sha2(F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def uniform(seed: int | str, *parts: Column) -> Column:
    """A uniform in [0, 1) that depends on the seed and the parts only."""
    bits = F.conv(F.substring(seeded_digest(seed, *parts), 1, 13), 16, 10).cast("long")
    return bits / F.lit(float(2**52))
