"""Text expressions over lexicons: substring matching, scores, classifiers. All JVM-side, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftspark.functions import lexicons as L


def whole_text(title: str = "title", body: str = "body") -> Column:
    """Lower-cased title and body with a space between; nulls as empty."""
    return F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit(""))))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def held(text: Column, values) -> Column:
    """Those of ``values`` that the text contains, in order; null for a null text."""
    return F.filter(strings(values), lambda v: F.contains(text, v))


def total(cols) -> Column:
    """The sum of columns, as a balanced tree that generated code can follow."""
    cols = list(cols)
    while len(cols) > 1:
        cols = [cols[i] + cols[i + 1] if i + 1 < len(cols) else cols[i] for i in range(0, len(cols), 2)]
    return cols[0] if cols else F.lit(0)


def held_count(text: Column, values) -> Column:
    """How many of ``values`` the text contains. Plain arithmetic, so it stays in generated code."""
    return total(F.contains(text, F.lit(v)).cast("int") for v in values)


def every_word(lexicon: dict[str, list[str]]) -> list[str]:
    return [k for ks in lexicon.values() for k in ks]


def lexicon_score(text: Column, lexicon: dict[str, list[str]], weights: dict[str, float], full: float) -> Column:
    """Every keyword that the text contains counts its category's weight twice, for itself and for the category; scaled to 1 at ``full``."""
    parts = [held_count(text, ks) * F.lit(2 * weights.get(c, L.OTHER_WEIGHT)) for c, ks in lexicon.items()]
    return F.least(total(parts) / full, F.lit(1.0))


def word_count(text: Column) -> Column:
    """White-space separated tokens."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def emotion(text: Column) -> Column:
    """Weighted words of emotion per hundred words (per text for shorter ones), at most 1; each word counts once."""
    strength = total(held_count(text, values) * F.lit(weight) for weight, values in L.EMOTION.items())
    return F.least(strength / F.greatest(word_count(text) / 100, F.lit(1.0)), F.lit(1.0))


def first_score(text: Column, scores: dict[str, int], default: int) -> Column:
    """The score of the first key, in order, that the lower-cased text contains; the default for null, blank or none."""
    low = F.lower(text)
    out = None
    for key, score in scores.items():
        out = F.when(low.contains(key), score) if out is None else out.when(low.contains(key), score)
    return out.otherwise(default)


def coarse_frequency(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for keys, score in L.FREQUENCY_COARSE:
        any_key = low.rlike("|".join(keys))
        out = F.when(any_key, score) if out is None else out.when(any_key, score)
    return out.otherwise(L.FREQUENCY_COARSE_DEFAULT)


def labels(text: Column, classes: dict[str, list[str]]) -> Column:
    """Names of the classes of which the text contains a keyword, in order."""
    return F.array_compact(F.array(*[F.when(F.exists(strings(ks), lambda k: F.contains(text, k)), F.lit(c)) for c, ks in classes.items()]))


def joined(separator: str, *cols) -> Column:
    """The non-empty ones of ``cols`` with a separator; nulls skipped."""
    return F.concat_ws(separator, *[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def ellipsis(col: Column, n: int) -> Column:
    """At most n characters; a longer text ends in three dots."""
    return F.when(F.length(col) <= n, col).otherwise(F.concat(F.left(col, F.lit(n - 3)), F.lit("...")))
