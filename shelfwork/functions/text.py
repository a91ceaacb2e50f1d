"""Text functions: columns in, columns out, all evaluated in the JVM.

The patterns stay inside the subset on which Java, RE2 and Python agree.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed

WHITE = fixed.WHITE
#: Its letters, one by one.
WHITE_LETTERS = "".join(letter for letter in map(chr, range(0x3001)) if letter.isspace())


def _flat(pattern: str) -> str:
    """The same character class with its ranges written out.

    Java tests a class of single letters with one table lookup; a class of
    several ranges is a chain of calls, about five times slower on whole texts.
    """
    letters = string.ascii_letters + string.digits
    return pattern.replace("a-zA-Z0-9", letters)


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove white space at both ends (``trim`` removes spaces only); only the ends are looked at."""
    return F.btrim(_column(c), F.lit(WHITE_LETTERS))


def blanked(c) -> Column:
    """Every letter of white space as a blank.

    One table lookup for each letter, so that patterns need no class of all scripts'
    white space, which costs several times as much on whole texts.
    """
    return F.translate(_column(c), WHITE_LETTERS, " " * len(WHITE_LETTERS))


def _short(pattern: str) -> str:
    """A pattern for blanked texts: the blank stands for all white space in its classes."""
    return pattern.replace(fixed.WHITE_LETTERS, " ")


# ---------------------------------------------------------------- assembling


def merge_title_description(
    title, description, sep: str = "; ", null_as: str = " ", on_equal: str = "title"
) -> Column:
    """Title and description as one text.

    A description equal to the title adds nothing: the title alone remains, or a
    blank with ``on_equal='blank'``.
    """
    if on_equal not in ("title", "blank"):
        raise ValueError("on_equal is 'title' or 'blank'")
    title = _column(title)
    filled = F.coalesce(_column(description), F.lit(null_as))
    same = title if on_equal == "title" else F.lit(" ")
    return F.when(filled == title, same).otherwise(F.concat(title, F.lit(sep), filled))


def merge_parts(*parts, sep: str = ". ", strip_chars: str = ". ") -> Column:
    """Join the non-empty parts, then strip separators at both ends."""
    kept = [F.nullif(_column(p), F.lit("")) for p in parts]
    return F.btrim(F.concat_ws(sep, *kept), F.lit(strip_chars))


def image_name(image_id, product_id) -> Column:
    return F.concat(
        F.lit("image_"), _column(image_id).cast("string"),
        F.lit("_product_"), _column(product_id).cast("string"), F.lit(".jpg"),
    )


def image_candidates(image_id, product_id) -> Column:
    """The file names an image may have, best first."""
    image = _column(image_id).cast("string")
    return F.array(
        image_name(image_id, product_id),
        F.concat(image, F.lit(".jpg")),
        F.concat(F.lit("image_"), image, F.lit(".jpg")),
    )


def folder_name(category) -> Column:
    """A category as a folder name; null becomes ``unknown``."""
    return F.regexp_replace(F.coalesce(_column(category), F.lit("unknown")), "[^0-9A-Za-z_\\-]", "_")


def preview(c, length: int = 500) -> Column:
    c = _column(c)
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def move_prefix(c, old: str, new: str) -> Column:
    return F.replace(_column(c), F.lit(old), F.lit(new))


def fill_empty(c, value: str = "Empty") -> Column:
    return F.coalesce(F.nullif(_column(c), F.lit("")), F.lit(value))


# ------------------------------------------------------------------- cleaning


def replace_all(c, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda col, p: F.replace(col, F.lit(p[0]), F.lit(p[1])), pairs, _column(c))


def fix_mojibake(c, longest_first: bool = False) -> Column:
    """Replace common mis-decoded letters in table order, or longest entry first."""
    pairs = fixed.MOJIBAKE
    if longest_first:
        pairs = sorted(pairs, key=lambda p: -len(p[0]))
    return replace_all(F.coalesce(_column(c), F.lit("")), pairs)


def _guarded(c: Column, marks: Sequence[str], pattern: str) -> Column:
    """Run a costly pattern only on texts that hold one of its literal marks."""
    hit = reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in marks])
    return F.when(hit, F.regexp_replace(c, pattern, "")).otherwise(c)


def remove_emails(c) -> Column:
    return _guarded(_column(c), ["@"], fixed.EMAILS)


def remove_web_addresses(c) -> Column:
    return _guarded(_column(c), ["://", "www"], fixed.WEB_ADDRESSES)


def clean_text(c) -> Column:
    """Mojibake table, tags, web words, emails, entities, charset, white space."""
    c = F.regexp_replace(blanked(fix_mojibake(c)), fixed.TAGS, "")
    c = _guarded(c, ["http", "www"], _short(fixed.WEB_WORDS))
    c = _guarded(c, ["@"], _short(fixed.EMAILS))
    c = F.regexp_replace(c, fixed.ENTITIES, " ")
    c = F.regexp_replace(c, _flat(_short(fixed.OUTSIDE_CHARSET)), " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def _accent_table() -> tuple[str, str]:
    """Letters whose decomposition is one base letter plus marks, and their bases."""
    letters, bases = [], []
    for code in range(0xC0, 0x1F000):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        kept = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(kept) == 1 and kept[0] != letter:
            letters.append(letter)
            bases.append(kept[0])
    return "".join(letters), "".join(bases)


ACCENTED, PLAIN = _accent_table()


def strip_accents(c) -> Column:
    """Remove accents: letters become their base letter, free marks go."""
    return F.regexp_replace(F.translate(_column(c), ACCENTED, PLAIN), "\\p{Mn}+", "")


def model_text(c) -> Column:
    """Lower case, no accents, marks set apart, only ``a-zA-Z0-9.°()`` kept."""
    c = strip_accents(strip(F.lower(_column(c))))
    c = F.regexp_replace(c, fixed.SPACED_MARKS, " $1 ")
    c = F.regexp_replace(c, fixed.QUOTES_AND_SPACES, " ")
    return F.regexp_replace(c, _flat(fixed.OUTSIDE_MODEL_TEXT), " ")


def contraction_table(longest_first: bool = False) -> dict[str, str]:
    straight = fixed.CONTRACTIONS
    table = {**straight, **{k.replace("'", "’"): v for k, v in straight.items()}}
    if longest_first:
        table = dict(sorted(table.items(), key=lambda kv: -len(kv[0])))
    return table


def contraction_pattern(longest_first: bool = False) -> str:
    """All contractions in order; no entry holds a letter with a meaning of its own in patterns."""
    return "|".join(contraction_table(longest_first))


def expand_contractions(c, longest_first: bool = False) -> Column:
    """Expand English contractions in one pass; of the entries that match at a place the first in the table wins.

    The text is cut at its contractions, which are looked up and put back between
    the parts. Only texts with an apostrophe are searched, and in them only words with one.
    """
    c = _column(c)
    entries = [F.lit(x) for pair in contraction_table(longest_first).items() for x in pair]
    pattern = F.lit(f"(?=[a-zA-Z]*['’])(?:{contraction_pattern(longest_first)})")
    found = F.transform(F.regexp_extract_all(c, pattern, F.lit(0)), lambda m: F.element_at(F.create_map(*entries), m))
    parts = F.zip_with(F.split(c, pattern, F.lit(-1)), found, lambda part, full: F.concat(part, F.coalesce(full, F.lit(""))))
    hit = F.contains(c, F.lit("'")) | F.contains(c, F.lit("’"))
    return F.when(hit, F.array_join(parts, "")).otherwise(c)


def remove_possessives(c) -> Column:
    return replace_all(c, [(p, "") for p in fixed.POSSESSIVES])


def collapse_spaces(c) -> Column:
    return F.regexp_replace(_column(c), " +", " ")


def split_letters_digits(c) -> Column:
    c = F.regexp_replace(_column(c), "([A-Za-z])([0-9])", "$1 $2")
    return F.regexp_replace(c, "([0-9])([A-Za-z])", "$1 $2")


def remove_punctuation(c) -> Column:
    return F.translate(_column(c), fixed.PUNCTUATION, "")


def clean_reply(reply, original) -> Column:
    """A model reply on one line without its prefix; the original when empty."""
    c = F.regexp_replace(strip(reply), fixed.REPLY_PREFIXES, "")
    c = F.trim(F.regexp_replace(blanked(c), " +", " "))
    return F.coalesce(F.nullif(c, F.lit("")), _column(original))


# ------------------------------------------------------------------- measuring


def word_count(c) -> Column:
    """Words between single spaces; empty words count."""
    return F.size(F.split(_column(c), " "))


def word_count_white(c) -> Column:
    """Words between runs of white space."""
    return F.size(words(c))


def words(c) -> Column:
    return F.filter(F.split(blanked(c), " +"), lambda w: w != "")


def char_count(c) -> Column:
    return F.length(F.coalesce(_column(c), F.lit("")))


def sentences(c, lower: bool = False) -> Column:
    """Sentences end at runs of ``.``, ``!`` or ``?``."""
    c = F.lower(_column(c)) if lower else _column(c)
    found = F.regexp_extract_all(c, F.lit("[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def similarity_tokens(c) -> Column:
    """Runs of two or more word characters, lower case."""
    return F.regexp_extract_all(F.lower(_column(c)), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))


def word_tokens(c) -> Column:
    """Runs of word characters as written."""
    return F.regexp_extract_all(_column(c), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def vocabulary_tokens(c) -> Column:
    """Lower-case words between separators, as used for the vocabulary."""
    spaced = F.translate(F.lower(_column(c)), fixed.WORD_SEPARATORS, " " * len(fixed.WORD_SEPARATORS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def char_ngrams(c, n: int) -> Column:
    """All overlapping runs of n characters, found in one pass."""
    return F.regexp_extract_all(_column(c), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def word_ngrams(tokens, n: int) -> Column:
    tokens = _column(tokens)
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


# ------------------------------------------------------------------ batch texts


def numbered_batch(pairs) -> Column:
    """``1. a;\\n2. b`` from an array of structs (number, line) in order of number."""
    lines = F.transform(
        F.sort_array(pairs), lambda p: F.concat(p["number"].cast("string"), F.lit(". "), p["line"])
    )
    return F.array_join(lines, ";\n")


def parse_numbered(reply, inline: bool = False, single: bool = False) -> Column:
    """A numbered reply as a map number -> text, later numbers win.

    With ``single`` a reply without numbers is the text of row 1.
    """
    reply = strip(reply)
    pattern = F.lit(fixed.NUMBERED_INLINE if inline else fixed.NUMBERED_LINE)
    numbers = F.regexp_extract_all(reply, pattern, F.lit(1))
    texts = F.regexp_extract_all(reply, pattern, F.lit(2))
    found = F.arrays_zip(numbers.alias("n"), texts.alias("t"))
    last = F.filter(
        found,
        lambda p, i: ~F.exists(
            F.slice(numbers, i + 2, F.greatest(F.size(numbers) - i - 1, F.lit(0))), lambda n: n == p["n"]
        ),
    )
    parsed = F.map_from_entries(F.transform(last, lambda p: F.struct(p["n"], p["t"])))
    if not single:
        return parsed
    return F.when(F.size(numbers) == 0, F.create_map(F.lit("1"), reply)).otherwise(parsed)
