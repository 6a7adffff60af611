"""Text analysis as column expressions: everything here stays inside whole-stage code generation or array functions.

A null input gives null, or an empty array where an array is returned. Long texts are analysed whole.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a run of letters, digits and underscores. ``\w`` differs between engines, these classes don't.
TOKEN = r"[\p{L}\p{N}_]+"

# Common English function words. A full list of any length is given as a parameter (``load_stop_words``);
# single letters are stop words by rule.
_FUNCTION_WORDS = """
about above across after again against all almost alone along already also although always am among an and another any
anyone are around as ask at away be became because become been before behind being below between both but by came can
cannot could did do does doing done down during each either else enough even ever every few first for from further get
give go got had has have having he her here hers herself him himself his how however if in indeed instead into is it its
itself just keep last least less let like made many may me might more most mostly much must my myself near neither never
next no nobody none nor not nothing now of off often on once one only onto or other others our ours out over own per
perhaps quite rather really said same see seem several she should since so some still such than that the their them then
there these they this those though three through thus to together too toward two under until up upon us very was we well
were what when where whether which while who whole whom whose why will with within without would yet you your
""".split()
STOP_WORDS = frozenset(_FUNCTION_WORDS) | frozenset(string.ascii_lowercase)


def load_stop_words(path: str) -> frozenset[str]:
    """The stop words of a text file with one word a line; the list is read once on the driver."""
    with open(path, encoding="utf-8") as stream:
        return frozenset(line.strip().lower() for line in stream if line.strip())


def tokens(text: Column) -> Column:
    """Lower-case tokens with at least one ASCII letter or digit, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: F.regexp_like(t, F.lit("[a-z0-9]")))


def without_stop_words(words: Column, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """The words that aren't stop words; the list becomes a hash set in the plan, not a scan per word."""
    return F.filter(words, lambda t: ~t.isin(*sorted(stop_words))) if stop_words else words


def without_stop_words_cased(text: Column, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """The words of a text that aren't stop words in any letter case, as they were written, joined by spaces."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    return F.array_join(F.filter(words, lambda t: ~F.lower(t).isin(*sorted(stop_words))) if stop_words else words, " ")


def analysed(text: Column, stopping: bool = True, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """Tokens less stop words; stemming is a step of its own over the distinct vocabulary."""
    return without_stop_words(tokens(text), stop_words) if stopping else tokens(text)


def non_words_to_space(text: Column) -> Column:
    """Every character that is no word character or white space becomes a space."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")


def alpha_tokens(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


def clean_sentence_text(text: Column) -> Column:
    """Typographic quotes to spaces, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[’”“]", " "), r"\s+", " "))


def sentences(text: Column) -> Column:
    """The text cut after ``.``, ``!`` or ``?`` and white space; empty pieces are left out."""
    return F.filter(F.split(clean_sentence_text(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def segments(text: Column) -> Column:
    """The text split at every ``.``, ``!`` and ``?``, with empty segments."""
    return F.split(text, "[.!?]")


def bigrams(words: Column) -> Column:
    """Array of structs (first, second) of neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.transform(F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b")), lambda z: F.struct(z["a"].alias("first"), z["b"].alias("second")))


def words_of_line(line: Column) -> Column:
    """Lower-case word tokens of a line, also those without ASCII letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(line, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def node_name(name: Column) -> Column:
    """A dictionary key: 40 characters, lower case, ``[a-z0-9 :_-]`` only, hyphens as spaces, letters and digits apart."""
    kept = F.regexp_replace(F.lower(F.substring(F.coalesce(name, F.lit("")), 1, 40)), r"[^a-z0-9 :_\-]", "")
    apart = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, "-", " "), r"(?<=[a-z])(?=[0-9])", " "), r"(?<=[0-9])(?=[a-z])", " ")
    return F.trim(F.regexp_replace(apart, " +", " "))


def node_name_of(name: str | None) -> str:
    """``node_name`` of one string on the driver."""
    kept = re.sub(r"[^a-z0-9 :_\-]", "", (name or "")[:40].lower()).replace("-", " ")
    return re.sub(" +", " ", re.sub(r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ", kept)).strip()


def plain_word(name: Column) -> Column:
    """A user's word without special characters; repeated hyphens become one."""
    kept = F.regexp_replace(F.lower(F.substring(F.coalesce(name, F.lit("")), 1, 40)), r"[^a-z0-9 :_\-]", "")
    return F.trim(F.regexp_replace(kept, "-+", "-"))


def clean_markup_text(text: Column) -> Column:
    """Any white space, quotes, parentheses and plus signs in runs become one space."""
    return F.trim(F.regexp_replace(text, r"""[(\s\p{Z}\x85\x1c-\x1f+)\t"']+""", " "))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def url_source(url: Column) -> Column:
    """The second label of the url's host."""
    return F.get(F.split(url, r"\."), F.lit(1))


def url_topic(url: Column, parts: int | None = 2) -> Column:
    """The folders of the url's path joined by ``-``: the first ``parts``, or all."""
    steps = F.split(url, "/")
    folders = F.slice(steps, 4, F.greatest(F.size(steps) - 4, F.lit(0)))
    return F.array_join(F.slice(folders, 1, parts) if parts else folders, "-")


def url_host(url: Column) -> Column:
    return F.get(F.split(url, "/"), F.lit(2))


def lead(text: Column, pieces: int = 3) -> Column:
    """The text up to its ``pieces``-th full stop."""
    return F.substring_index(text, ".", pieces)


def day(value: Column) -> Column:
    """The date of the first ten characters, null if they are none."""
    return F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")


#: Further forms of dates, tried in order.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyyMMdd", "dd.MM.yyyy")


def any_day(value: Column) -> Column:
    """The date of a value in any of the forms, null if it has none."""
    text = F.trim(value)
    iso = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.substring(text, 1, 10)).otherwise(text)
    return F.coalesce(*[F.try_to_date(iso, form) for form in DATE_FORMS])


def found_day(text: Column) -> Column:
    """The first ``dddd-dd-dd`` in the text, empty if there is none."""
    return F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)


def decoded_url(text: Column) -> Column:
    return F.try_url_decode(text)
