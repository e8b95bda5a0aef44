"""Text expressions: missing values, fixed-width text, name keys, dates, flags.

All of them are native Column expressions, so they stay inside generated code.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from cargofile.schema import MISSING_TOKENS, MONTHS, ACTIVITIES

# ASCII blanks plus the no-break space; Spark's trim() alone only drops U+0020.
BLANKS = " \t\n\r\x0b\x0c "

# Letters whose ASCII form is not a plain accent strip.
_SINGLE = {
    "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l",
    "Ħ": "H", "ħ": "h", "ı": "i", "Ŧ": "T", "ŧ": "t", "ſ": "s", "ĸ": "k", "Ŀ": "L", "ŀ": "l",
    "×": "x", "÷": "/", "º": "o", "ª": "a", "²": "2", "³": "3", "¹": "1", "µ": "u", "·": "*",
    "´": "'", "¸": ",", "¡": "!", "¿": "?", "¨": '"', "¯": "-", " ": " ", "¦": "|",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "•": "*",
}
_MULTI = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th",
    "Ĳ": "IJ", "ĳ": "ij", "Ŋ": "NG", "ŋ": "ng", "ŉ": "'n",
    "€": "EUR", "£": "PS", "°": "deg", "±": "+-", "«": "<<", "»": ">>", "©": "(c)", "®": "(r)",
    "¼": " 1/4", "½": " 1/2", "¾": " 3/4", "…": "...", "§": "SS", "™": "(tm)",
}


def _accent_pairs() -> tuple[str, str]:
    """Latin letters whose canonical decomposition starts with an ASCII letter."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACC_SRC, _ACC_DST = _accent_pairs()
_NON_ASCII = r"[^\x00-\x7F]"


def _translation(upper: bool) -> tuple[str, str]:
    """One translate() table: blanks → space, accents and single letters → ASCII, other
    control characters dropped (they come last, beyond the end of the target)."""
    pairs = {c: " " for c in "\n\r\t\x0b\x0c\x1c\x1d\x1e\x1f"}
    pairs |= dict(zip(_ACC_SRC, _ACC_DST)) | _SINGLE
    if upper:
        pairs = {c: r.upper() for c, r in pairs.items()}
        pairs |= {c: c.upper() for c in "abcdefghijklmnopqrstuvwxyz"}
    dropped = "".join(chr(i) for i in [*range(1, 9), *range(0x0E, 0x1C), *range(0x7F, 0xA0)])
    return "".join(pairs) + dropped, "".join(pairs.values())


_PLAIN_TABLE, _UPPER_TABLE = _translation(False), _translation(True)
# Printable ASCII that is no small letter.
_FLAT = r"^[ -`{-~]*\z"


def _is_ascii(c: Column) -> Column:
    """Whether a text has as many bytes as characters; a regular expression takes many times longer."""
    return F.octet_length(c) == F.length(c)


def _single_blanks(c: Column) -> Column:
    return ~(c.startswith(" ") | c.endswith(" ") | c.contains("  "))


def _is_flat(c: Column) -> Column:
    """Already one line of printable upper-case ASCII with single blanks inside."""
    return (c != "") & c.rlike(_FLAT) & _single_blanks(c)


def _spell_out(c: Column) -> Column:
    """ASCII letter by letter; only for text that still holds characters without a plain form."""
    table = F.create_map(*[F.lit(x) for kv in _MULTI.items() for x in kv])
    spelled = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")
    return F.when(c.rlike(_NON_ASCII), F.regexp_replace(spelled, _NON_ASCII + "+", "")).otherwise(c)


def to_ascii(c: Column) -> Column:
    """Transliterate to ASCII; what has no ASCII form is dropped."""
    return F.when(c.rlike(_NON_ASCII), _spell_out(F.translate(c, *_PLAIN_TABLE))).otherwise(c)


def fold_accents(c: Column) -> Column:
    """Drop diacritics only (no transliteration of ß, Ø …)."""
    full = F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), _ACC_SRC, _ACC_DST)
    return F.when(c.rlike(_NON_ASCII), full).otherwise(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean(c: Column) -> Column:
    """Trimmed text, or null when blank or one of the missing-value tokens."""
    t = strip(c)
    return F.when(~F.upper(t).isin("", *MISSING_TOKENS), t)


def clean_columns(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """clean() of many columns, trimmed in one step and tested in the next."""
    df = df.withColumns({k: strip(F.col(c)) for k, c in texts.items()})
    return df.withColumns({
        k: F.when((F.length(k) > 4) | ~F.upper(k).isin("", *MISSING_TOKENS), F.col(k)) for k in texts})


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _flatten(c: Column) -> Column:
    full = F.upper(_spell_out(F.translate(c, *_UPPER_TABLE)))
    return F.when(_is_flat(c), c).otherwise(F.trim(F.regexp_replace(full, " {2,}", " ")))


def flat_text(c: Column) -> Column:
    """Upper-case ASCII on one line, single blanks, printable characters only."""
    return _flatten(c)


def flatten_columns(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """flat_text() of many columns in steps, so that no step repeats an expensive input."""
    df = df.withColumns(texts)
    df = df.withColumns({
        k: F.when(_is_flat(F.col(k)), F.col(k)).otherwise(F.translate(F.col(k), *_UPPER_TABLE)) for k in texts})
    df = df.withColumns({
        k: F.when(~_is_ascii(F.col(k)), F.upper(_spell_out(F.col(k)))).otherwise(F.col(k)) for k in texts})
    return df.withColumns({
        k: F.when(~_single_blanks(F.col(k)), F.trim(F.regexp_replace(k, " {2,}", " "))).otherwise(F.col(k)) for k in texts})


def fixed_text(c: Column, width: int) -> Column:
    return F.rpad(F.coalesce(flat_text(c), F.lit("")), width, " ")


def fixed_number(c: Column, width: int) -> Column:
    """Digits, zero-filled on the left; longer values are kept, never cut."""
    d = F.coalesce(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))
    return F.when(F.length(d) < width, F.lpad(d, width, "0")).otherwise(d)


def fixed_alnum(c: Column, width: int) -> Column:
    """Letters and digits without leading zeros, blank-filled on the right."""
    body = F.regexp_replace(F.translate(c, "\n\r\t", "   "), "^0+", "")
    body = F.when(body == "", "0").otherwise(body)
    body = F.regexp_replace(F.upper(to_ascii(body)), "[^A-Z0-9]+", "")
    # An empty source is blank, not "0".
    return F.rpad(F.when(c != "", body).otherwise(""), width, " ")


_KEY = r"^[A-Z0-9 ]*\z"


def _key(c: Column) -> Column:
    """Upper case, no diacritics, runs of anything but letters and digits → one blank.

    ASCII needs upper() alone and one translate() covers Latin text; letters whose capital has several characters (ß) or
    that come with combining marks take the long way.
    """
    quick = F.translate(c, *_KEY_TABLE)
    long_way = F.upper(c)
    long_way = F.translate(F.regexp_replace(long_way, r"\p{Mn}+", ""), _ACC_SRC, _ACC_DST)
    squeeze = lambda x: F.trim(F.regexp_replace(x, "[^A-Z0-9]+", " "))
    done = (c != "") & c.rlike(_KEY) & _single_blanks(c)
    return F.when(done, c).when(_is_ascii(c), squeeze(F.upper(c))).when(_is_ascii(quick), squeeze(quick)).otherwise(squeeze(long_way))


_KEY_TABLE = (
    _ACC_SRC + "abcdefghijklmnopqrstuvwxyz", _ACC_DST.upper() + "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def name_key(c: Column) -> Column:
    """Comparison key of a name; '' when nothing comparable is left."""
    return clean_name_key(clean(c))


def clean_name_key(c: Column) -> Column:
    """name_key() of a column that clean() made, which is then not cleaned again for every test of the key."""
    return F.coalesce(_key(c), F.lit(""))


# Names that stand for "no name" in the learned memory.
_PLACEHOLDER_KEYS = ("NAO INFORMADO", "SEM NOME", "N/A", "NA", "NONE", "NULL")


def memory_key(c: Column) -> Column:
    """name_key() variant of the learned memory: placeholder names have no key."""
    key = _key(c)
    return F.when(key.isin(*_PLACEHOLDER_KEYS), "").otherwise(F.coalesce(key, F.lit("")))


def storage_flag(c: Column) -> Column:
    first = F.upper(F.left(strip(c), F.lit(1)))
    return F.when(first.isin("P", "A"), first).otherwise("P")


def month_abbr(month: Column) -> Column:
    """Three-letter month; null outside 1–12."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.when(month.between(1, 12), F.element_at(names, month.cast("int")))


def activity_flags(**active: bool) -> str:
    """Eight 0/1 flags in layout order; transport is always on."""
    chosen = {k for k, v in active.items() if v} | {"transporte"}
    return "".join("1" if a in chosen else "0" for a in ACTIVITIES)


BR_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"


def is_calendar_date(c: Column) -> Column:
    """True when a d/m/yyyy text names a real day (plain integer arithmetic, ANSI-safe)."""
    part = [F.split_part(c, F.lit("/"), F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    day, month, year = part
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = (
        F.when(month.isin(4, 6, 9, 11), 30)
        .when(month == 2, F.when(leap, 29).otherwise(28))
        .otherwise(31)
    )
    ok = c.rlike(BR_DATE) & (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= last)
    return F.coalesce(ok, F.lit(False))


def file_stem(c: Column) -> Column:
    """ASCII stem of a report name for output file names (30 characters at most)."""
    base = F.regexp_replace(c, r"^.*[/\\]", "")
    base = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    flat = F.regexp_replace(F.upper(to_ascii(base)), "[^A-Z0-9]+", "_")
    return F.left(F.btrim(flat, F.lit("_")), F.lit(30))


# Character-class tests of a written line.
def has_control(c: Column) -> Column:
    return c.rlike(r"[\p{C}\p{Z}&&[^ ]]")


def has_lower(c: Column) -> Column:
    return c.rlike("[a-z]")


def has_non_ascii(c: Column) -> Column:
    return c.rlike(_NON_ASCII)


def forbidden_chars(c: Column) -> Column:
    """Distinct non-ASCII characters of a line, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({_NON_ASCII})"), 1)))
