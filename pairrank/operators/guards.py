"""Schema, row and name guards; redaction."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Protected names, fragments and tokens.
BLOCKED_NAMES = (
    "gender", "sex", "age", "age_band", "date_of_birth", "dob", "birth_date", "birthdate", "graduation_year",
    "year_of_birth", "name", "full_name", "first_name", "last_name", "surname", "forename", "nationality",
    "ethnicity", "race", "country_of_birth", "national_origin", "marital_status", "marital", "children",
    "dependants", "religion", "faith", "disability", "sexual_orientation", "postcode", "postal_code", "zip_code",
    "address", "email", "phone", "photo", "photograph", "image",
)
BLOCKED_FRAGMENTS = ("gender", "ethnic", "nationalit", "religio", "marital", "postcode", "disabilit")
BLOCKED_TOKENS = ("age", "race", "sex", "dob", "name", "photo")

# Keys whose values are never shown.
SENSITIVE_KEYS = (
    "cv_text", "cv", "resume_text", "raw_text", "text", "name", "full_name", "first_name", "last_name", "email",
    "phone", "address", "postcode", "date_of_birth", "dob", "gender", "age", "nationality", "ethnicity",
    "marital_status", "photo", "religion",
)
REDACTED = "[redacted]"

# Features that are watched: what they might reveal, and how that is held in check.
PROXY_REGISTER = {
    "recency_months": (
        "Long pauses between jobs are more common after parental leave, so this may stand in for gender.",
        "Limited to 240 months; compare its group means in every audit, and coarsen or remove it if they drift apart.",
    ),
    "role_count": (
        "People who have worked longer have held more roles, so this may stand in for age.",
        "Limited to 6, so that long careers, where the link is closest, look alike.",
    ),
    "exp_gap": (
        "Years of experience rise with age.",
        "Kept, because postings ask for experience as such; its effect per group is reported.",
    ),
    "shift_match": (
        "Those who look after others can take fewer shifts, and that differs by gender.",
        "Kept under watch in every audit, as the most likely source of a gap.",
    ),
}


def blocked(name: Column) -> Column:
    """Whether a field name refers to a protected attribute: exact, fragment or token."""
    key = F.lower(F.trim(name))
    hit = key.isin(*BLOCKED_NAMES)
    for fragment in BLOCKED_FRAGMENTS:
        hit = hit | F.contains(key, F.lit(fragment))
    return hit | F.arrays_overlap(F.split(key, "[_-]"), F.array(*[F.lit(t) for t in BLOCKED_TOKENS]))


def blocked_columns(names: DataFrame, column: str = "name") -> DataFrame:
    return names.where(blocked(F.col(column)))


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Every field name of a schema, whatever arrays, maps and structs it is nested in."""
    paths: list[str] = []
    for field in schema.fields:
        paths.append(prefix + field.name)
        for inner in _structs(field.dataType):
            paths += field_paths(inner, f"{prefix}{field.name}.")
    return paths


def _structs(kind: T.DataType) -> list[T.StructType]:
    """The nearest structs inside a type."""
    if isinstance(kind, T.StructType):
        return [kind]
    if isinstance(kind, T.ArrayType):
        return _structs(kind.elementType)
    if isinstance(kind, T.MapType):
        return _structs(kind.keyType) + _structs(kind.valueType)
    return []


def assert_clean(source: DataFrame | Sequence[str]) -> None:
    """Raise naming every protected field. Looks at names only, never at data."""
    names = field_paths(source.schema) if isinstance(source, DataFrame) else list(source)
    offending = sorted(n for n in names if _blocked_name(n.rsplit(".", 1)[-1]))
    if offending:
        raise ValueError(f"protected attribute(s) {offending} must never influence a score")


def _blocked_name(name: str) -> bool:
    import re

    key = name.strip().lower()
    if key in BLOCKED_NAMES or any(f in key for f in BLOCKED_FRAGMENTS):
        return True
    return not set(re.split("[_-]", key)).isdisjoint(BLOCKED_TOKENS)


def schema_guard(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Reject unknown, missing or retyped columns; returns the frame in declared order."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    unknown, missing = sorted(set(have) - set(want)), sorted(set(want) - set(have))
    retyped = sorted(n for n in set(have) & set(want) if have[n] != want[n])
    if unknown or missing or retyped:
        raise ValueError(f"schema mismatch: unknown={unknown} missing={missing} retyped={retyped}")
    return df.select(*[f.name for f in expected.fields])


def record_key_violations(records: DataFrame, json: str, allowed: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per unknown or missing top-level key of a JSON record column."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    permitted = F.array(*[F.lit(a) for a in allowed])
    unknown = F.transform(F.array_except(keys, permitted), lambda k: F.struct(k.alias("key"), F.lit("unknown").alias("problem")))
    missing = F.transform(F.array_except(permitted, keys), lambda k: F.struct(k.alias("key"), F.lit("missing").alias("problem")))
    return records.select(*keep, F.inline(F.concat(unknown, missing)))


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the broken rules, in the order given. A rule is the condition of a bad row."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def quarantine(df: DataFrame, rules: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per (row, broken rule)."""
    return df.select(*keep, F.explode(violations(rules)).alias("violation"))


def batch_constraints(rows: DataFrame, by: str, item: str, limit: int = 500) -> DataFrame:
    """Per posting: size, distinct ids and the three batch flags."""
    # Two-step distinct count: (posting, id) first, so a crowded posting is spread by id.
    per_item = rows.groupBy(by, item).agg(F.count(F.lit(1)).alias("n"))
    sized = per_item.groupBy(by).agg(
        F.sum("n").alias("n_rows"), F.count_if(F.col(item).isNotNull()).alias("n_items")
    )
    return sized.select(
        by,
        "n_rows",
        "n_items",
        (F.col("n_rows") < 1).alias("is_empty"),
        (F.col("n_rows") > limit).alias("over_limit"),
        (F.col("n_rows") != F.col("n_items")).alias("has_duplicates"),
        F.greatest(F.lit(0), F.lit(limit) - F.col("n_rows")).alias("remaining_capacity"),
    )


def redact(df: DataFrame, sensitive: Sequence[str] = SENSITIVE_KEYS) -> DataFrame:
    """Replace sensitive values at any depth of structs, arrays and maps; names match in any case.

    A sensitive field becomes the text ``[redacted]``. So does the value of a sensitive
    map key where the map holds text; in a map of another type it becomes null.
    """
    names = frozenset(name.lower() for name in sensitive)
    return df.select(*[_field(F.col(f"`{f.name}`"), f, names).alias(f.name) for f in df.schema.fields])


def _field(value: Column, field: T.StructField, names: frozenset[str]) -> Column:
    return F.lit(REDACTED) if field.name.lower() in names else _redacted(value, field.dataType, names)


def _redacted(value: Column, kind: T.DataType, names: frozenset[str]) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_field(value.getField(f.name), f, names).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.AtomicType):
        return F.transform(value, lambda item: _redacted(item, kind.elementType, names))
    if isinstance(kind, T.MapType):
        masked = F.lit(REDACTED) if isinstance(kind.valueType, T.StringType) else F.lit(None)
        hit = lambda key: F.lower(key.cast("string")).isin(*sorted(names))
        return F.transform_values(value, lambda k, v: F.when(hit(k), masked).otherwise(_redacted(v, kind.valueType, names)))
    return value


def redact_json(json: Column, sensitive: Sequence[str] = SENSITIVE_KEYS) -> Column:
    """The same for JSON kept as text, at any depth of objects and lists; other values stay as they are.

    Text that is not JSON comes out null, so nothing unread is let through. The depth of a
    row's JSON is unknown to a plan, hence a small walk over Arrow batches.
    """
    names, mask = frozenset(name.lower() for name in sensitive), REDACTED

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import json as codec

        def walk(value):
            if isinstance(value, dict):
                return {k: mask if k.strip().lower() in names else walk(v) for k, v in value.items()}
            return [walk(v) for v in value] if isinstance(value, list) else value

        def clean(text):
            try:
                return codec.dumps(walk(codec.loads(text)), ensure_ascii=False, separators=(",", ":"), allow_nan=False)
            except (ValueError, RecursionError):
                return None

        for batch in batches:
            yield pa.array([None if t is None else clean(t) for t in batch.to_pylist()], pa.string())

    return run(json)
