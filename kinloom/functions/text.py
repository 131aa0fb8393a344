"""Normalised views of names, addresses and countries. The raw text always stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode as U
from .arrays import mapped
from .vocabulary import COUNTRY_ABBREVIATIONS, LEGAL_ENDINGS, LEGAL_ENDINGS_FR, NULL_FIELDS

#: White space as Python strips it: Unicode white space and the four separators.
_SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (trim would take blanks only)."""
    return F.regexp_replace(c, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_missing(c: Column) -> Column:
    """Null or white space only."""
    return c.isNull() | F.regexp_like(c, F.lit(f"(?U)^{_SPACE}*$"))


def is_null_field(c: Column) -> Column:
    """A field that is empty or a whole-field null word."""
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*NULL_FIELDS)


def words(folded: Column) -> Column:
    """Runs of letters and digits of an already folded text; marks end a run."""
    return F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def words_with_marks(folded: Column) -> Column:
    """Runs of letters, digits and combining marks, joiners left out."""
    joined = F.translate(F.coalesce(folded, F.lit("")), "\u200c\u200d", "")
    return F.regexp_extract_all(joined, F.lit(r"([\p{L}\p{N}\p{M}]+)"), F.lit(1))


def lower(c: Column) -> Column:
    """Lower case letter by letter: a sigma at the end of a word is as any other, and a dotted capital I has no mark."""
    return F.lower(F.translate(c, "\u03a3\u0130", "\u03c3i"))


def marked_runs(text: Column) -> Column:
    """Runs of letters, digits and combining marks of a text as it stands; null stays null."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}\p{M}]+)"), F.lit(1))


def tokenize(c: Column) -> Column:
    """Case-folded tokens in order, repeats kept; null has none."""
    return words(U.casefold_nfkc(c))


def audit_tokens(c: Column) -> Column:
    """Tokens of the variation labels: marks stay attached."""
    return words_with_marks(U.casefold_nfc(c))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokenize(c))


def numeric_tokens(c: Column) -> Column:
    """Digit runs of the raw text, leading zeros kept."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\p{Nd}+)"), F.lit(1))


def ascii_numbers(c: Column) -> Column:
    """Runs of the digits 0 to 9; null stays null."""
    return F.regexp_extract_all(c, F.lit(r"([0-9]+)"), F.lit(1))


def without_leading_zeros(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.regexp_replace(x, "^0+(?=.)", ""))


def drop_endings(tokens: Column, endings=LEGAL_ENDINGS) -> Column:
    """Tokens up to the last one that is no legal-form word."""
    last = F.array_max(F.transform(tokens, lambda t, i: F.when(t.isin(*endings), F.lit(0)).otherwise(i + 1)))
    return F.slice(tokens, F.lit(1), F.coalesce(last, F.lit(0)))


def legal_form_reduced(c: Column, endings=LEGAL_ENDINGS) -> Column:
    """The folded name without trailing legal-form words; empty if it has no others."""
    return F.array_join(drop_endings(words(U.casefold_nfkc(U.fold_latin(c))), endings), " ")


def legal_form_by_country(c: Column, country: Column) -> Column:
    """The reduced name; names of France also lose the French legal forms."""
    french = normalize_country(country).isin("fr", "france")
    return F.when(french, legal_form_reduced(c, tuple(dict.fromkeys(LEGAL_ENDINGS + LEGAL_ENDINGS_FR)))).otherwise(legal_form_reduced(c))


def address_by_country(c: Column, country: Column) -> Column:
    """Address tokens with the abbreviations of their country written out; those of unknown countries stay as they are."""
    tokens = tokenize(c)
    out = tokens
    for names, table in COUNTRY_ABBREVIATIONS.items():
        out = F.when(normalize_country(country).isin(*names), mapped(tokens, table)).otherwise(out)
    return out


def address_numbers(c: Column) -> Column:
    """House numbers as written but for leading zeros: `12/3`, `12a` and `5 bis` stay whole."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([0-9]+(?:/[0-9]+)*(?: (?:bis|ter|quater)\b|[a-z]\b)?)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "^0+(?=[0-9])", ""), "/0+(?=[0-9])", "/"))


def first_letters(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def initials(c: Column) -> Column:
    """First letters of all folded tokens, legal forms among them."""
    return first_letters(words(U.casefold_nfkc(U.fold_latin(c))))


def normalize_country(c: Column) -> Column:
    return F.coalesce(U.casefold(strip(c)), F.lit(""))


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(strip(c), "(?U)\\s+", " ")


def alias_of(c: Column) -> Column:
    """What follows a DBA or formerly marker; empty without one."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?iU)\b(?:dba|formerly|trading as):?\s+(.+)$", 1)


def domain_stem(c: Column) -> Column:
    """A name written as a domain, without scheme, www and ending; null for others."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.nullif(F.regexp_extract(text, r"^(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:com|in|net|org)\b", 1), F.lit(""))


def normalized_text(c: Column) -> Column:
    """The name view: nine fields."""
    tokens = tokenize(c)
    return F.struct(
        c.alias("raw"), is_missing(c).alias("missing"), U.casefold_nfkc(c).alias("casefold"), U.fold_latin(c).alias("ascii_fold"), tokens.alias("tokens"),
        F.array_distinct(tokens).alias("token_set"), numeric_tokens(c).alias("numeric_tokens"), legal_form_reduced(c).alias("legal_reduced"), initials(c).alias("initials"),
    )


def normalized_address(c: Column) -> Column:
    """The address view: five fields."""
    tokens = tokenize(c)
    return F.struct(c.alias("raw"), is_missing(c).alias("missing"), tokens.alias("tokens"), F.array_distinct(tokens).alias("token_set"), numeric_tokens(c).alias("numeric_tokens"))


def quality_flags(c: Column) -> Column:
    """Flags of a field: missing, length, scripts, null word, digits."""
    return F.struct(is_missing(c).alias("missing"), F.length(c).alias("n_chars"), U.scripts(c).alias("scripts"), is_null_field(c).alias("placeholder"), F.size(numeric_tokens(c)).alias("n_numbers"))
