"""Scalar functions as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
BOUNDS = ("max_delta", "min_delta", "max_ratio", "min_ratio")
#: Words that mark an event as an error, and how severe states and statuses are.
ERROR_WORDS = ("error", "failure", "timeout", "exception", "circuit", "tripped", "dropped")
STATE_RANK = {"healthy": 0, "recovering": 1, "degraded": 2, "tripped": 3}
STATUS_RANK = {"pass": 0, "unknown": 1, "warn": 2, "fail": 3}


def artifact_name(name: Column) -> Column:
    """Letters, digits, - and _ stay; the rest becomes _; outer _ go; nothing left: run."""
    cleaned = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, "^_+|_+$", ""), F.lit("")), F.lit("run"))


def metric_name(name: Column) -> Column:
    """Trimmed, lower case, everything but letters and digits becomes _; nothing left: unknown."""
    cleaned = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def ranked(rank: Mapping[str, int], column: Column, default: int | None = None) -> Column:
    out = F.lit(default).cast("int")
    for name, value in rank.items():
        out = F.when(column == name, value).otherwise(out)
    return out


def unranked(rank: Mapping[str, int], column: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in rank.items():
        out = F.when(column == value, name).otherwise(out)
    return out


def worst(rank: Mapping[str, int], column: Column) -> Column:
    """Aggregate: the worst of the named levels."""
    return unranked(rank, F.max(ranked(rank, column)))


def normal_state(state: Column) -> Column:
    s = F.lower(F.trim(state))
    return F.when(s == "idle", "healthy").otherwise(s)


def known_status(status: Column) -> Column:
    """pass, warn and fail are known; all else, null included, is unknown."""
    s = F.lower(F.trim(status))
    return F.when(s.isin("pass", "warn", "fail"), s).otherwise("unknown")


def is_error_event(event_type: Column, message: Column) -> Column:
    return F.lower(F.concat_ws(" ", event_type, message)).rlike("|".join(ERROR_WORDS))


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def euler_degrees(r: Column) -> list[Column]:
    """Roll, pitch, yaw of a row-major 3x3 rotation array, with the branch for a vertical pitch."""
    sy = F.sqrt(r[0] * r[0] + r[3] * r[3])
    plain = sy >= 1e-6
    x = F.when(plain, F.atan2(r[7], r[8])).otherwise(F.atan2(-r[5], r[4]))
    z = F.when(plain, F.atan2(r[3], r[0])).otherwise(0.0)
    return [F.degrees(x), F.degrees(F.atan2(-r[6], sy)), F.degrees(z)]


def robust_loss(kind: str, z: Column, scale: float = 1.0) -> tuple[Column, Column, Column]:
    """rho and its two derivatives, as stored with it, of a squared residual; Tukey's rho levels off at a sixth."""
    s2, root = scale * scale, F.sqrt(z)
    near = root <= scale
    if kind == "huber":
        far = (2 * scale * root - s2, scale / F.greatest(root, F.lit(EPS)), -0.5 * scale / F.greatest(z, F.lit(EPS)))
        close = (z, F.lit(1.0), F.lit(0.0))
    elif kind == "tukey":
        t = 1 - z / s2
        far, close = (F.lit(s2 / 6), F.lit(0.0), F.lit(0.0)), (s2 / 6 * (1 - t * t * t), t * t, -2 * t / s2)
    elif kind == "cauchy":
        d = 1 + z / s2
        return s2 * F.log(d), 1 / d, -1 / (s2 * d * d)
    elif kind == "linear":
        return z, F.lit(1.0), F.lit(0.0)
    else:
        raise ValueError(f"no loss of that name: {kind}")
    return tuple(F.when(near, c).otherwise(f) for c, f in zip(close, far, strict=True))


def derived_seed(seed: Column, component: Column) -> Column:
    """First eight bytes of sha256("seed:component") as a number, modulo 2**31 - 1."""
    text = F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), component), 256), 1, 16)
    return (F.conv(text, 16, 10).cast("decimal(20,0)") % 2147483647).cast("long")


def parsed_time(text: Column) -> Column:
    """Seconds since the epoch, or an ISO time with space or T; null where neither."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("double")), F.try_to_timestamp(F.regexp_replace(F.trim(text), "^(\\S+) (\\S+)$", "$1T$2")))


def ratio(delta: Column, baseline: Column) -> Column:
    """delta / |baseline|; null where the baseline is 0, null or not finite."""
    return F.when((baseline != 0) & ~F.isnan(baseline) & (F.abs(baseline) != float("inf")), delta / F.abs(baseline))


def threshold(direction: Column, tolerance: Column) -> tuple[Column, Column]:
    """max_delta and min_delta of a direction and tolerance."""
    return F.when(direction == "lower", tolerance), F.when(direction == "higher", -tolerance)


def metric_status(baseline: Column, delta: Column, rel: Column, max_delta: Column, min_delta: Column, max_ratio: Column, min_ratio: Column) -> Column:
    none = max_delta.isNull() & min_delta.isNull() & max_ratio.isNull() & min_ratio.isNull()
    over = F.coalesce(delta > max_delta, F.lit(False)) | F.coalesce(delta < min_delta, F.lit(False)) | F.coalesce(rel > max_ratio, F.lit(False)) | F.coalesce(rel < min_ratio, F.lit(False))
    return F.when(none, "pass").when(baseline.isNull() | F.isnan(baseline), "missing_baseline").when((max_ratio.isNotNull() | min_ratio.isNotNull()) & rel.isNull(), "regressed").when(over, "regressed").otherwise("pass")


def parse_threshold(spec: float | Mapping | None) -> dict[str, float] | None:
    """The bounds max_delta, min_delta, max_ratio, min_ratio of a threshold's spec; None where it bounds nothing.

    A number bounds the delta from above.  A mapping names bounds, or a direction with a tolerance, which wins."""
    if spec is None:
        return None
    if isinstance(spec, (int, float)):
        return {"max_delta": float(spec)}
    if not isinstance(spec, Mapping):
        raise TypeError("a threshold is a number or a mapping")
    found = {k: float(spec[k]) for k in BOUNDS if spec.get(k) is not None}
    if spec.get("direction") and spec.get("tolerance") is not None:
        if spec["direction"] not in ("lower", "higher"):
            raise ValueError(f"no direction of that name: {spec['direction']}")
        found |= {"max_delta": float(spec["tolerance"])} if spec["direction"] == "lower" else {"min_delta": -float(spec["tolerance"])}
    return found or None


def threshold_rows(specs: Mapping[str, float | Mapping | None]) -> list[tuple]:
    """(metric, max_delta, min_delta, max_ratio, min_ratio) of each spec that bounds something."""
    parsed = {m: parse_threshold(s) for m, s in specs.items()}
    return [(m, *(p.get(b) for b in BOUNDS)) for m, p in parsed.items() if p]


def severity(status: Column, delta: Column, rel: Column, max_delta: Column, min_delta: Column, max_ratio: Column, min_ratio: Column) -> Column:
    """Root of summed squares of how far the present bounds on delta and ratio are exceeded, in units of the bound.

    A bound value that is null or not finite counts 1, and so does a missing baseline."""

    def penalty(value: Column, bound: Column, sign: int) -> Column:
        finite = F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))
        beyond = F.greatest(sign * (value - bound) / F.greatest(F.abs(bound), F.lit(EPS)), F.lit(0.0))
        return F.when(bound.isNull(), 0.0).when(~finite, 1.0).otherwise(beyond)

    parts = [penalty(delta, max_delta, 1), penalty(delta, min_delta, -1), penalty(rel, max_ratio, 1), penalty(rel, min_ratio, -1)]
    return F.when(status == "missing_baseline", 1.0).otherwise(F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0])))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def differing_bytes(a: Column, b: Column) -> Column:
    """Places at which two binaries of one length differ."""
    return F.size(F.filter(F.sequence(F.lit(1), F.octet_length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def number_map(values: Column, kind: str = "double") -> Column:
    """A map of texts or numbers as a map of ``kind``; whole numbers drop their fraction; what is no number is an error."""
    return F.transform_values(values, lambda _, v: v.cast("double").cast(kind))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def camera_name(key: Column) -> Column:
    """image_N of a projection key (P_rect_0N, P_rect_N, P_N, PN); null for other keys."""
    rect, short = F.regexp_extract(key, r"^P_rect_0?(\d+)$", 1), F.regexp_extract(key, r"^P_?(\d+)$", 1)
    number = F.coalesce(F.nullif(rect, F.lit("")), F.nullif(short, F.lit("")))
    return F.concat(F.lit("image_"), number.cast("int").cast("string"))


def camera_id(name: Column) -> Column:
    """0 to 3 of image_N and image_0N; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^image_0?([0-3])$", 1), F.lit("")).cast("int")


def drive_id(text: Column) -> Column:
    """Digits are filled with zeros to four places; longer ones and other names stay."""
    return F.when(text.rlike(r"^\d+$") & (F.length(text) < 4), F.lpad(text, 4, "0")).otherwise(text)


def fov_intrinsics(width: Column, height: Column, fov_deg: Column) -> Column:
    """Row-major camera matrix of an image size and a horizontal field of view."""
    f = width / (2 * F.tan(F.radians(fov_deg) / 2))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(f, zero, width / 2, zero, f, height / 2, zero, zero, one)


def projection_intrinsics(p: Column) -> Column:
    """Row-major camera matrix of a row-major 3x4 projection, its last element made 1 unless it is 0."""
    last = F.when(p[10] == 0, F.lit(1.0)).otherwise(p[10])
    return F.array(*[p[4 * r + c] / last for r in range(3) for c in range(3)])


def determinant(k: Column | list[Column]) -> Column:
    return k[0] * (k[4] * k[8] - k[5] * k[7]) - k[1] * (k[3] * k[8] - k[5] * k[6]) + k[2] * (k[3] * k[7] - k[4] * k[6])


def projection_offset(k: Column, p: Column) -> Column:
    """Translation of a projection whose camera matrix is k and whose rotation is the identity; null where k is singular."""

    def solved(both: Column) -> Column:
        m, a = [both["k"][i] for i in range(9)], [both["p"][i] for i in (3, 7, 11)]
        det = F.nullif(determinant(m), F.lit(0.0))
        # Cramer's rule: each unknown is the determinant with its column replaced.
        swapped = [[a[r] if c == i else m[3 * r + c] for r in range(3) for c in range(3)] for i in range(3)]
        return F.when(det.isNotNull(), F.array(*[-determinant(w) / det for w in swapped]))

    return F.transform(F.array(F.struct(k.alias("k"), p.alias("p"))), solved)[0]


def adaptive_threshold(median: Column, base: float, least: float, most: float) -> Column:
    """base, scaled by the median displacement over 25 pixels (half to double), within limits; no displacement: base."""
    scale = F.least(F.greatest(median / 25.0, F.lit(0.5)), F.lit(2.0))
    scale = F.when(median.isNull(), F.lit(1.0)).otherwise(scale)  # least and greatest pass over nulls
    return F.least(F.greatest(base * scale, F.lit(least)), F.lit(most))


def loop_scale(estimated: Column, measured: Column, least: float) -> Column:
    """Ratio of two translation lengths; 1 if either is below ``least``."""
    return F.when((estimated < least) | (measured < least), F.lit(1.0)).otherwise(estimated / measured)


def largest_of(values: Column, keys: tuple[str, ...]) -> Column:
    """The largest of those keys that a map holds; null if it holds none."""
    return F.array_max(F.array(*[values[k] for k in keys]))


def total_of(values: Column, keys: tuple[str, ...]) -> Column:
    return sum((F.coalesce(values[k], F.lit(0)) for k in keys), F.lit(0))


def _rest(values: Column, seen: Column) -> Column:
    return F.map_filter(values, lambda k, _: ~F.array_contains(seen, k))


def first_wins(*maps: Column) -> Column:
    """One map of all; a key's value is that of the first map that holds it.  Null maps are empty."""
    out = F.coalesce(maps[0], F.create_map().cast("map<string,string>"))
    for more in maps[1:]:
        out = F.map_concat(out, F.coalesce(_rest(more, F.map_keys(out)), F.create_map().cast("map<string,string>")))
    return out


def correlation_id(stage: Column, seed: Column, config_hash: Column, run_id: Column, salt: Column) -> Column:
    """sha256 of the canonical JSON of the five, keys in order."""
    parts = F.struct(config_hash.alias("config_hash"), run_id.alias("run_id"), salt.alias("salt"), seed.alias("seed"), stage.alias("stage"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


#: The fields of a key point, in the order they are stored in.
KEYPOINT = ("x", "y", "size", "angle", "response", "octave", "class_id")


def keypoint_numbers(point: Column) -> Column:
    return F.array(*[point[n].cast("float") for n in KEYPOINT])


def keypoint_fields(numbers: Column) -> Column:
    """The struct of seven stored numbers; octave and class are whole."""
    return F.struct(*[numbers[i].cast("int" if n in ("octave", "class_id") else "float").alias(n) for i, n in enumerate(KEYPOINT)])
