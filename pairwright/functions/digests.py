"""Content digests as column expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and no spaces; nulls are written, not dropped."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def payload_digest(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def order_digest(
    namespace: str, dataset: Column, token: Column, seed: Column, label: Column, row_id: Column
) -> Column:
    """Digest of the canonical replication-order payload.

    Equal to :func:`payload_digest` of the same fields. The text is put together
    with ``concat`` because this runs once per retained row and condition, and all
    strings in it are plain names checked by :class:`pairwright.Study`.
    """
    return F.sha2(
        F.concat(
            F.lit('{"class_label":'), label.cast("string"),
            F.lit(',"dataset":"'), dataset,
            F.lit('","namespace":"'), F.lit(namespace),
            F.lit('","original_source_row_index":'), row_id.cast("string"),
            F.lit(',"retained_fraction_token":"'), token,
            F.lit('","split_seed":'), seed.cast("string"),
            F.lit("}"),
        ),
        256,
    )


def draw_digest(namespace: str, *parts: Column) -> Column:
    """Digest that orders rows for a split or a nested subset."""
    return F.sha2(F.concat_ws("|", F.lit(namespace), *[p.cast("string") for p in parts]), 256)


def leading_uint64(digest: Column) -> Column:
    """First eight digest bytes as an unsigned big-endian number."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def bootstrap_seed(
    namespace: str, dataset: Column, token: Column, model: Column, contrast: Column, resamples: int
) -> Column:
    return leading_uint64(
        payload_digest(
            namespace=F.lit(namespace),
            dataset=dataset,
            retained_fraction_token=token,
            model=model,
            contrast=contrast,
            resamples=F.lit(resamples),
        )
    )


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))
