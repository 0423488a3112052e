"""Route labels: reading them from free text and deciding them by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .core import strip

TEXT, VISION, REJECT, UNKNOWN = "TEXT", "VISION", "REJECT", "UNKNOWN"

# --- fixed values: other spellings of the two labels ---
TEXT_WORDS = ("text", "텍스트")
VISION_WORDS = ("vision", "비전", "비젼")

# Words that ask for something drawn, tabled or attached (English, French,
# German, Spanish); a parameter of ``route_by_cues``.
VISUAL_CUES = (
    "table", "figure", "chart", "image", "photo", "attachment", "timetable", "diagram",
    "tableau", "graphique", "tabelle", "bild", "tabla", "gráfico",
)


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def parse_route(raw: Column, mode: str) -> Column:
    """Label from free text, by one of four readings.

    ``vision_first``  VISION if it occurs, else TEXT
    ``first_token``   VISION if the first word holds it, else TEXT (also when empty)
    ``text_first``    TEXT before VISION, other spellings accepted, else UNKNOWN
    ``binary``        TEXT if it occurs, else VISION
    """
    text = F.coalesce(raw, F.lit(""))
    upper = F.upper(text)
    if mode == "vision_first":
        return F.when(upper.contains(VISION), VISION).otherwise(TEXT)
    if mode == "first_token":
        word = F.element_at(F.split(strip(upper), r"\s+"), 1)
        return F.when(word.contains(VISION), VISION).otherwise(TEXT)
    if mode == "text_first":
        lower = F.lower(text)
        return (F.when(_contains_any(lower, TEXT_WORDS), TEXT)
                .when(_contains_any(lower, VISION_WORDS), VISION).otherwise(UNKNOWN))
    if mode == "binary":
        return F.when(upper.contains(TEXT), TEXT).otherwise(VISION)
    raise ValueError(f"unknown reading {mode!r}")


def route_with_reason(content: Column) -> Column:
    """``struct<route, reason>`` of a JSON answer; REJECT where it names no route or is no JSON."""
    parsed = F.from_json(content, "struct<route:string,reason:string>")
    return F.struct(F.upper(F.coalesce(parsed["route"], F.lit(REJECT))).alias("route"),
                    F.coalesce(parsed["reason"], F.lit("")).alias("reason"))


def first_route(*fields: Column, default: str = "") -> Column:
    """First field that names a route; fields naming neither are passed over."""
    def read(field: Column) -> Column:
        upper = F.upper(strip(field))
        return F.when(upper.contains(VISION), VISION).when(upper.contains(TEXT), TEXT)

    return F.coalesce(*[read(f) for f in fields], F.lit(default))


def route_by_cues(question: Column, cues: Sequence[str] = VISUAL_CUES) -> Column:
    """VISION when the question holds a cue as a whole word, else TEXT."""
    pattern = r"(?i)(^|[^\p{L}])(" + "|".join(cues) + r")($|[^\p{L}])"
    return F.when(F.coalesce(question, F.lit("")).rlike(pattern), VISION).otherwise(TEXT)


def other_route(route: Column) -> Column:
    return F.when(route == VISION, TEXT).otherwise(VISION)
