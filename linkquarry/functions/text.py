"""Names and addresses as Column functions: normalizing, tokens, keys and similarities.

Everything is built in and so stays in generated code; only Unicode compatibility forms need Python, as an Arrow function
to which only texts beyond ASCII are sent (compose=False leaves it out, for text that is composed already). Null text is
the empty one throughout.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column | str) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def filled(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(""))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition. Text of ASCII is returned as it is."""
    import unicodedata

    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def composed(c: Column | str) -> Column:
    """Text in its compatibility composition; ASCII stays in the JVM, as a null goes to Python in its place."""
    raw = filled(c)
    return F.coalesce(nfkc(F.when(raw.rlike(r"[^\x00-\x7F]"), raw)), raw)


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without what isn't ASCII."""
    import unicodedata

    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over both lengths, by bits of one integer a character; 1 for two empty texts."""

    def ratio(x: str | None, y: str | None) -> float:
        x, y = x or "", y or ""
        if not x and not y:
            return 1.0
        where: dict[str, int] = {}
        for i, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << i
        full = row = (1 << len(x)) - 1
        for c in y:
            u = row & where.get(c, 0)
            row = (row + u | row - u) & full
        return 2.0 * (len(x) - row.bit_count()) / (len(x) + len(y))

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{P}\p{S}_]", " "), r"(?U)\s+", " "))


def _has_letter(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def normalize_name(c: Column | str, strip_legal: bool = False, compose: bool = True) -> Column:
    """Lower case, `&` as a word, other punctuation and symbols as spaces; empty without a letter or digit."""
    raw = composed(c) if compose else filled(c)
    out = _spaced(F.replace(F.lower(raw), F.lit("&"), F.lit(" and ")))
    out = F.when(_has_letter(raw), out).otherwise("")
    return strip_legal_suffixes(out) if strip_legal else out


def strip_legal_suffixes(name: Column) -> Column:
    """A normalized name without legal forms at its end; as it is if nothing else would be left."""
    single = "|".join(fixed.LEGAL_SUFFIXES)
    other = rf"(?:^| )(?!(?:{single})(?: |$))"  # a word that is no legal form
    bare = F.regexp_replace(name, rf"(?: (?:soc anonyme|{single}))+$", "")
    singles = F.regexp_replace(name, rf"(?: (?:{single}))+$", "")
    return F.when(bare.rlike(other), bare).when(singles.rlike(other), singles).otherwise(name)


def legal_suffixes(name: Column) -> Column:
    """The sorted legal phrases and single legal forms of a normalized name."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    phrases = F.filter(words(*fixed.LEGAL_PHRASES), lambda p: padded.contains(F.concat(F.lit(" "), p, F.lit(" "))))
    return F.array_sort(F.array_union(phrases, F.array_intersect(F.split(name, " "), words(*fixed.LEGAL_SUFFIXES))))


def name_tokens(name: Column, least: int = 2) -> Column:
    """Words of a normalized name of so many characters at least, in order, repeated as they are."""
    return F.filter(F.split(name, " "), lambda t: F.length(t) >= least)


def distinctive_tokens(name: Column) -> Column:
    """Distinct words of a normalized name that aren't generic."""
    return F.array_except(F.filter(F.split(name, " "), lambda t: F.length(t) >= 2), words(*fixed.GENERIC_NAME_TERMS))


def normalize_address(c: Column | str, compose: bool = True) -> Column:
    """Lower case with abbreviations of streets written out, punctuation and symbols as spaces."""
    raw = strip(composed(c) if compose else filled(c))
    table = F.create_map(*[F.lit(x) for pair in fixed.STREET_ABBREVIATIONS.items() for x in pair])
    parts = F.filter(F.split(F.replace(F.lower(raw), F.lit("&"), F.lit(" and ")), r"(?U)\s+"), lambda t: t != "")
    full = F.transform(parts, lambda t: F.coalesce(F.try_element_at(table, F.btrim(t, F.lit(".,;:-"))), t))
    return F.when(_has_letter(raw), _spaced(F.array_join(full, " "))).otherwise("")


def address_tokens(address: Column, least: int = 2) -> Column:
    """Distinct words of a normalized address without stopwords."""
    return F.array_except(F.filter(F.split(address, " "), lambda t: F.length(t) >= least), words(*fixed.ADDRESS_STOPWORDS))


def house_number(c: Column | str, compose: bool = True) -> Column:
    """The number of a house, plot or door: a labelled one, else one that starts a part between commas, else the first; null
    if there is none."""
    raw = strip(composed(c) if compose else filled(c))
    tidy = lambda x: F.regexp_replace(F.lower(x), r"[.,;:\-]+$", "")
    found = tidy(F.regexp_extract(raw, f"(?iU){fixed.LABELLED_NUMBER}", 1))
    labelled = F.when(found.rlike(r"(?U)\d"), found)
    segments = F.transform(F.split(raw, ","), lambda s: tidy(F.regexp_extract(strip(s), f"(?U){fixed.SEGMENT_NUMBER}", 1)))
    first = F.get(F.filter(segments, lambda s: s != ""), F.lit(0))
    plain = F.lower(F.regexp_extract(raw, f"(?U){fixed.PLAIN_NUMBER}", 0))
    return F.coalesce(labelled, first, F.when(plain != "", plain))


# Similarities


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; none of a shorter text."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - F.lit(n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def gram_cosine(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """Cosine of two gram sets: exactly 1 for equal sets (so for two empty ones), 0 if one is empty. Equal texts aren't
    intersected."""
    x, y, both = F.size(grams_a), F.size(grams_b), F.size(F.array_intersect(grams_a, grams_b))
    some = F.when((both == x) & (both == y), 1.0).otherwise(both / (F.sqrt(x.cast("double")) * F.sqrt(y.cast("double"))))
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).when(a == b, 1.0).otherwise(some)


def edit_similarity(a: Column, b: Column) -> Column:
    x, y = F.length(a), F.length(b)
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.lit(1.0) - F.levenshtein(a, b) / F.greatest(x, y))


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.length(a), F.length(b)
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y))


def bigrams(c: Column) -> Column:
    """All character bigrams, repeated as they are."""
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - F.lit(1), F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bigram_dice(a: Column, b: Column) -> Column:
    """Twice the common bigrams (with repeats) over all; 1 for equal texts, 0 if either has none."""
    x, y = bigrams(a), bigrams(b)
    times = lambda xs, g: F.size(F.filter(xs, lambda z: z == g))
    both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, g: acc + F.least(times(x, g), times(y, g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(F.lit(2.0) * both / (F.size(x) + F.size(y)))


def bigram_marks(c: Column) -> Column:
    """The character bigrams of an ASCII text as numbers, each with how many equal ones come before it: no two are the same,
    so that common bigrams with repeats are a set's intersection."""
    code = lambda g: F.ascii(g).cast("long") * 128 + F.ascii(F.substr(g, F.lit(2), F.lit(1)))
    bound = F.array(F.sort_array(F.transform(bigrams(c), code)))  # sorted once, then read by each of its bigrams
    return F.get(F.transform(bound, lambda xs: F.transform(xs, lambda x, i: x * F.lit(1 << 32) + (i - F.array_position(xs, x)))), F.lit(0))


# Profiling


def clean_text(c: Column | str, fold: bool = True) -> Column:
    """ASCII letters and digits in lower case; with `fold`, accented letters lose their accents first."""
    raw = ascii_fold(filled(c)) if fold else filled(c)
    return F.trim(F.regexp_replace(F.replace(F.lower(raw), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def clean_address(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", " "))


def clean_tokens(clean: Column, stopwords: bool = True, least: int = 2) -> Column:
    """Distinct words of a cleaned text, without stopwords and legal forms if asked for."""
    out = F.array_distinct(F.filter(F.split(clean, " "), lambda t: F.length(t) >= least))
    return F.array_except(out, words(*fixed.PROFILE_STOPWORDS, *fixed.PROFILE_SUFFIXES)) if stopwords else out


def strip_profile_suffixes(clean: Column) -> Column:
    """A cleaned name without legal forms at its end; as it is if nothing is left."""
    bare = F.trim(F.regexp_replace(F.concat(F.lit(" "), clean), rf"(?: (?:{'|'.join(fixed.PROFILE_SUFFIXES)}))+$", ""))
    return F.when(bare != "", bare).otherwise(clean)


def numbers(c: Column | str, pattern: str = r"\b\d+\b") -> Column:
    return F.regexp_extract_all(filled(c), F.lit(pattern), F.lit(0))


def has_non_ascii(c: Column | str) -> Column:
    return filled(c).rlike(r"[^\x00-\x7F]")


def address_part(c: Column | str, from_end: int) -> Column:
    """A part between commas counted from the end (1: the last), trimmed, in lower case; null if there are fewer."""
    parts = F.filter(F.transform(F.split(filled(c), ","), lambda p: strip(F.lower(p))), lambda p: p != "")
    return F.when(F.size(parts) >= from_end, F.try_element_at(parts, F.lit(-from_end)))


# Keys


def exact_key(country: Column, name: Column) -> Column:
    return F.when(strip(filled(name)) == "", "").otherwise(F.concat_ws("::", F.upper(strip(country)), F.lit("name"), strip(name)))


def prefix_key(country: Column, name: Column, size: int = 5) -> Column:
    return F.when(strip(filled(name)) == "", "").otherwise(F.concat_ws("::", F.upper(strip(country)), F.lit(f"pref{size}"), F.substring(strip(name), 1, size)))


def house_key(country: Column, house: Column) -> Column:
    return F.when(strip(filled(house)) != "", F.concat_ws("::", F.upper(strip(country)), F.lit("house"), F.lower(strip(house))))


def house_prefix_key(country: Column, house: Column, name: Column, size: int = 3) -> Column:
    ok = (strip(filled(house)) != "") & (strip(filled(name)) != "")
    return F.when(ok, F.concat_ws("::", F.upper(strip(country)), F.lit(f"h_pref{size}"), F.lower(strip(house)), F.substring(strip(name), 1, size)))
