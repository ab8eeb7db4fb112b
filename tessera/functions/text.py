"""Text functions as Column expressions: normalising, tokenising, splitting and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN = r"[a-z0-9][a-z0-9+._#-]*"
HAN = r"[\x{4e00}-\x{9fff}]"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x, digits: int) -> Column:
    """Round half towards plus infinity."""
    scale = 10**digits
    return F.floor(_col(x) * scale + 0.5) / scale


def latin_tokens(text) -> Column:
    """Lower-case words of letters and digits, with + . _ # - inside."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(LATIN), F.lit(0))


def bigrams(text) -> Column:
    """All pairs of neighbouring characters, of a text without blanks."""
    t = F.regexp_replace(F.lower(_col(text)), r"\s+", "")
    chars = F.split(t, "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.lit(1), F.size(chars) - 1)), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))
    return F.when(F.length(t) < 2, F.array(t)).otherwise(pairs)


def tokens(text, mode: str = "latin") -> Column:
    """Words (``latin``), pairs of characters (``bigram``), or both (``hybrid``)."""
    if mode == "latin":
        return latin_tokens(text)
    if mode == "bigram":
        return bigrams(text)
    if mode == "hybrid":
        return F.concat(latin_tokens(text), bigrams(text))
    raise ValueError(f"no such tokenizer: {mode}")


def normalised(text) -> Column:
    """Lower case, brackets and full-width signs folded, blanks collapsed."""
    folded = F.translate(F.lower(_col(text)), "（）【】　，。：；！？", "()[] ,.:;!?")
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def match_key(text) -> Column:
    """Without any white space, for containment tests."""
    return F.regexp_replace(_col(text), r"\s+", "")


def slug(text) -> Column:
    """Lower-case letters and digits joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normalised_url(url) -> Column:
    """Scheme, host and path in lower case, without www., query, fragment and closing slash."""
    u = F.regexp_replace(F.lower(F.trim(_col(url))), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"^https?://", ""), r"^www\.", ""), r"/+$", "")


def han_ratio(text) -> Column:
    """Share of Han characters among those that are not blank."""
    solid = F.regexp_replace(_col(text), r"\s+", "")
    return F.when(F.length(solid) > 0, F.regexp_count(solid, F.lit(HAN)) / F.length(solid)).otherwise(0.0)


def containment(part, whole) -> Column:
    """Share of the distinct character pairs of ``part`` that ``whole`` has."""
    own = F.array_distinct(bigrams(part))
    return F.size(F.array_intersect(own, bigrams(whole))) / F.size(own)


def fnv1a(text) -> Column:
    """32-bit FNV-1a of an ASCII text, as a long."""
    return F.aggregate(
        F.transform(F.split(_col(text), ""), lambda c: F.ascii(c).cast("long")),
        F.lit(2166136261).cast("long"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)) % F.lit(4294967296),
    )


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def recency(then, now, floor: float = 0.2, half: float = 0.5, days: float = 30.0) -> Column:
    """1 at ``now``, falling by ``half`` every ``days`` days, ``floor`` at least."""
    age = (F.unix_timestamp(_col(now)) - F.unix_timestamp(_col(then))) / 86400.0
    return F.greatest(F.lit(floor), F.lit(1.0) - F.lit(half) * F.greatest(F.lit(0.0), age) / F.lit(days))


def stated_charset(html) -> Column:
    """The charset that a page's meta element states, in lower case, or the empty text."""
    return F.lower(F.regexp_extract(_col(html), r"""(?i)<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_-]+)""", 1))


def refresh_target(html) -> Column:
    """The address that a page's meta element refreshes to, or the empty text."""
    return F.regexp_extract(_col(html), r"""(?i)<meta[^>]+http-equiv\s*=\s*["']?refresh["']?[^>]*url\s*=\s*([^"'>\s]+)""", 1)
