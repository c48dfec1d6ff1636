"""Text expressions: lenient JSON, defaults, rounding, prompts, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by file ending (fixed values).
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png"}
#: The task given with every frame (fixed text).
FRAME_TASK = (
    "Describe this frame from a short-form video. Include:\n"
    "1. Visual elements (people, objects, text overlays, backgrounds)\n"
    "2. Any on-screen text (OCR)\n"
    "3. Estimated mood/energy level\n"
    "4. Production style (talking head, b-roll, screen recording, etc.)\n"
    "Be concise. 2-3 sentences max."
)
#: Weights of the four scores in the overall one (fixed values).
SCORE_WEIGHTS = {"hook_strength": 0.3, "information_density": 0.25, "emotional_impact": 0.25, "shareability": 0.2}


def lenient_json(text: Column) -> Column:
    """The text as JSON, else its widest {...} span as JSON, else NULL (VARIANT)."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"\{[\s\S]*\}", 0)))


def array_or_empty(text: Column, ddl: str = "array<string>") -> Column:
    """A JSON array; NULL and '' count as an empty one."""
    return F.from_json(F.coalesce(F.nullif(text, F.lit("")), F.lit("[]")), ddl)


def mime_type(path: Column) -> Column:
    """By the ending of the path in any case; image/jpeg for all others."""
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ending), F.lit("image/jpeg"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: a plain column would be repeated wherever it is used."""
    return F.transform(F.array(value), then)[0]


def _scaled(value: Column, digits: int) -> Column:
    """|value| * 10^digits rounded to a whole number as the binary value says, ties to even.

    The product p and its rounding error e are exact together (Dekker's product of two split factors), so the
    sign of p - n - 1/2 + e tells on which side of the tie the binary value lies.
    """
    b = 10.0**digits
    bh = 134217729.0 * b - (134217729.0 * b - b)
    bl = b - bh
    up = lambda n: lambda side: n + F.when((side > 0) | ((side == 0) & (F.pmod(n, F.lit(2.0)) == 1)), 1.0).otherwise(0.0)
    error = lambda x, p, high: ((high * bh - p) + high * bl + (x - high) * bh) + (x - high) * bl
    split = lambda x: _let(x * F.lit(134217729.0), lambda c: c - (c - x))
    of_product = lambda x: lambda p: _let(F.floor(p).cast("double"), lambda n: _let((p - n - 0.5) + _let(split(x), lambda high: error(x, p, high)), up(n)))
    return _let(F.abs(value), lambda x: _let(x * F.lit(b), of_product(x)))


def _whole(value: Column, digits: int) -> Column:
    """Whether the value has no further digits to round: so large, or no finite number."""
    return F.isnan(value) | (F.abs(value) * F.lit(10.0**digits) >= 2.0**52)


def round_binary(value: Column, digits: int) -> Column:
    """The double nearest to the binary value rounded to ``digits`` decimals, ties to even (2.675 -> 2.67, as it lies below the tie).

    Values so large that they have no more digits, NaN and infinite values stay as they are; -0.0 counts as 0.
    """
    r = _let(_scaled(value, digits) / F.lit(10.0**digits), lambda r: F.when(value < 0, -r).otherwise(r))
    return F.when(_whole(value, digits), value).otherwise(r)


def fixed(value: Column, digits: int) -> Column:
    """printf('%.nf') of the binary value: ties to even, trailing zeros kept, '-0.0' for small negative values, 'nan', 'inf'."""
    text = _scaled(value, digits).cast("bigint").cast("string")
    if digits:
        padded = _let(text, lambda t: F.lpad(t, F.greatest(F.length(t), F.lit(digits + 1)), "0"))
        text = _let(padded, lambda t: F.concat(F.substring(t, F.lit(1), F.length(t) - digits), F.lit("."), F.right(t, F.lit(digits))))
    large = F.when(F.isnan(value), F.lit("nan")).when(value == float("inf"), F.lit("inf")).when(value == float("-inf"), F.lit("-inf")).otherwise(F.format_string(f"%.{digits}f", value))
    return F.when(_whole(value, digits), large).otherwise(F.concat(F.when(value < 0, "-").otherwise(""), text))


def frame_prompt(index: Column, total: Column, at: Column, duration: Column) -> Column:
    """The frame task, preceded by what is known of the frame's place."""
    place = F.concat_ws(
        " ",
        F.when(index.isNotNull() & total.isNotNull(), F.format_string("This is frame %d of %d.", index + 1, total)),
        F.when(at.isNotNull(), F.concat(F.lit("Captured at "), fixed(at, 1), F.lit("s"))),
        F.when(at.isNotNull() & (F.coalesce(duration, F.lit(0.0)) != 0), F.concat(F.lit("of a "), fixed(duration, 0), F.lit("s video."))),
    )
    return F.when(place != "", F.concat(place, F.lit("\n\n" + FRAME_TASK))).otherwise(F.lit(FRAME_TASK))


def duration_of(text: Column) -> Column:
    """A probe's answer in seconds, 60.0 where it is no number."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(60.0))


def overall_score(hook: Column, density: Column, emotion: Column, share: Column) -> Column:
    w = SCORE_WEIGHTS
    return hook * w["hook_strength"] + density * w["information_density"] + emotion * w["emotional_impact"] + share * w["shareability"]
