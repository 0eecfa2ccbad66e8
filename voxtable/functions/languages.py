"""Language codes and names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Codes and names of the speech model's languages.
LANGUAGES = {
    "en": "english", "zh": "chinese", "de": "german", "es": "spanish", "ru": "russian", "ko": "korean", "fr": "french",
    "ja": "japanese", "pt": "portuguese", "tr": "turkish", "pl": "polish", "ca": "catalan", "nl": "dutch", "ar": "arabic",
    "sv": "swedish", "it": "italian", "id": "indonesian", "hi": "hindi", "fi": "finnish", "vi": "vietnamese", "he": "hebrew",
    "uk": "ukrainian", "el": "greek", "ms": "malay", "cs": "czech", "ro": "romanian", "da": "danish", "hu": "hungarian",
    "ta": "tamil", "no": "norwegian", "th": "thai", "ur": "urdu", "hr": "croatian", "bg": "bulgarian", "lt": "lithuanian",
    "la": "latin", "mi": "maori", "ml": "malayalam", "cy": "welsh", "sk": "slovak", "te": "telugu", "fa": "persian",
    "lv": "latvian", "bn": "bengali", "sr": "serbian", "az": "azerbaijani", "sl": "slovenian", "kn": "kannada",
    "et": "estonian", "mk": "macedonian", "br": "breton", "eu": "basque", "is": "icelandic", "hy": "armenian",
    "ne": "nepali", "mn": "mongolian", "bs": "bosnian", "kk": "kazakh", "sq": "albanian", "sw": "swahili", "gl": "galician",
    "mr": "marathi", "pa": "punjabi", "si": "sinhala", "km": "khmer", "sn": "shona", "yo": "yoruba", "so": "somali",
    "af": "afrikaans", "oc": "occitan", "ka": "georgian", "be": "belarusian", "tg": "tajik", "sd": "sindhi",
    "gu": "gujarati", "am": "amharic", "yi": "yiddish", "lo": "lao", "uz": "uzbek", "fo": "faroese", "tk": "turkmen",
    "ps": "pashto", "mt": "maltese", "sa": "sanskrit", "lb": "luxembourgish", "my": "myanmar", "bo": "tibetan",
    "tl": "tagalog", "mg": "malagasy", "as": "assamese", "tt": "tatar", "haw": "hawaiian", "ln": "lingala", "ha": "hausa",
    "ba": "bashkir", "jw": "javanese", "su": "sundanese", "yue": "cantonese", "ht": "haitian creole", "nn": "nynorsk",
}
PRIMARY = ("en", "kn", "hi", "ta", "te", "ml")
DEFAULT_MODELS = {"kn": "vasista22/whisper-kannada-base"}


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def language_code(value) -> Column:
    """Code for a code or name; nothing given means English; unknown values stay."""
    v = _c(value)
    key = F.lower(strip(v))
    by_name = _lookup({name: code for code, name in LANGUAGES.items()})
    return F.when(v.isNull() | (v == ""), F.lit("en")).otherwise(F.coalesce(by_name[key], key))


def language_label(value) -> Column:
    v = _c(value)
    titles = _lookup({code: name.title() for code, name in LANGUAGES.items()})
    return F.coalesce(
        titles[language_code(v)], F.upper(F.when(v.isNull() | (v == ""), F.lit("English")).otherwise(v))
    )


def language_from_token(token) -> Column:
    """``<|kannada|>`` to ``kn``; anything not of that form is English."""
    t = _c(token)
    name = F.lower(F.regexp_extract(t, r"^<\|(.*)\|>$", 1))
    by_name = _lookup({name: code for code, name in LANGUAGES.items()})
    return F.when(t.rlike(r"^<\|.*\|>$"), F.coalesce(by_name[name], name)).otherwise(F.lit("en"))


def route_model(language, default: str, overrides: dict[str, str] | None = None) -> Column:
    """Model id for a language: the given override, else the built-in one, else the default."""
    v = _c(language)
    routes = {**DEFAULT_MODELS, **{k: m for k, m in (overrides or {}).items() if m}}
    return F.when(v.isNull() | (v == ""), F.lit(default)).otherwise(
        F.coalesce(_lookup(routes)[language_code(v)], F.lit(default))
    )
