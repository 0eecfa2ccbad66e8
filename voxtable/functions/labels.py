"""Sound labels: noise filter and normalisation to a merge key and a display name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import squash_space, strip

# Display names of known classes, then keyword rules in order.
DISPLAY = {
    "dog": "dog barking",
    "car_horn": "car honking",
    "clock_alarm": "alarm or phone ringing",
    "clock_tick": "clock ticking",
    "siren": "siren",
    "engine": "car engine",
    "helicopter": "helicopter",
    "airplane": "airplane",
    "train": "train",
    "rain": "rain",
    "thunderstorm": "thunderstorm",
    "wind": "wind",
    "crackling_fire": "fire crackling",
    "glass_breaking": "glass breaking",
    "door_wood_knock": "door knocking",
    "footsteps": "footsteps",
    "vacuum_cleaner": "vacuum cleaner",
    "washing_machine": "washing machine",
    "keyboard_typing": "keyboard typing",
    "mouse_click": "mouse click",
    "fireworks": "fireworks",
    "church_bells": "church bells",
    "crow": "crow",
    "chirping_birds": "birds chirping",
    "crickets": "crickets",
}
KEYWORDS = [
    (r"bark|\bdog\b", "dog_bark", "dog barking"),
    (r"horn|honk", "car_horn", "car honking"),
    (r"telephone|phone|ringtone", "phone_ring", "phone ringing"),
    (r"alarm|bell ringing", "alarm_ring", "alarm ringing"),
    (r"siren", "siren", "siren"),
    (r"engine|motor", "engine", "vehicle engine"),
    (r"rain", "rain", "rain"),
    (r"thunder", "thunder", "thunder"),
    (r"wind", "wind", "wind"),
    (r"footstep|walking", "footsteps", "footsteps"),
    (r"knock|door", "door_knock", "door knocking"),
    (r"bird|chirp", "birds", "birds chirping"),
    (r"baby|cry", "crying", "crying"),
    (r"laugh", "laughing", "laughing"),
    (r"applause|clap", "clapping", "clapping"),
]
NOISE = r"sine wave|white noise|pink noise|silence"


def is_noise(label) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.lower(c).rlike(NOISE)


def _slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def label_parts(label) -> Column:
    """Key and display name of a label, as a struct: known labels, then the first keyword rule that fits, else the label itself."""
    raw = strip(F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit("")))
    return let(F.struct(raw.alias("raw"), _slug(raw).alias("slug"), F.lower(raw).alias("low")), _parts)


def _parts(x: Column) -> Column:
    parts = lambda key, display: F.struct(key.alias("key"), display.alias("display"))
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(DISPLAY.items())])
    rules = F.when(x["raw"] == "", parts(F.lit(""), F.lit(""))).when(x["slug"].isin(*DISPLAY), parts(x["slug"], known[x["slug"]]))
    for pattern, key, display in KEYWORDS:
        rules = rules.when(x["low"].rlike(pattern), parts(F.lit(key), F.lit(display)))
    short = F.substring(x["slug"], 1, 80)
    own = F.when(short != "", short).otherwise(F.substring(x["low"], 1, 80))
    return rules.otherwise(parts(own, squash_space(F.replace(x["raw"], F.lit("_"), F.lit(" ")))))


def label_key(label) -> Column:
    return label_parts(label)["key"]


def label_display(label) -> Column:
    return label_parts(label)["display"]
