"""Commands in canonical ASCII form.

native() is a tree of built-in expressions and runs in the JVM. It covers ASCII and all characters that
fold to one character or none; rows with others (ligature-like characters, Hangul, fractions, ...) can be sent through
exact(), a pandas UDF with the same result type, which knows the whole of NFKD.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Escape sequences, tried in this order after the ESC character:
# control sequence; operating system command; device control, privacy message and the like; two-character; others.
ESCAPES = r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[PX^_][^\x1b]*(?:\x1b\\)|[@-Z\x5c-\x5f]|[ -/]*[0-~])"

# Characters that NFKD leaves, and what they become.
FOLDS = (
    ("ØøÐðĐđĦħŁłŒœÆæÞþı", ("O", "o", "D", "d", "D", "d", "H", "h", "L", "l", "OE", "oe", "AE", "ae", "TH", "th", "i")),
    ("ɑɐəɛɜɪɩɯʏʼ", ("a", "a", "e", "e", "e", "i", "i", "u", "y", "'")),
    ("–—‐‑‒−", ("-",) * 6),
    ("‘’‚‛′", ("'",) * 5),
    ("“”„‟″«»", ('"',) * 7),
    ("•·×÷", ("*", "*", "x", "/")),
    ("\u200b\u200c\u200d\ufeff\ufffd", ("",) * 5),
)
_AFTER = {c: to for chars, tos in FOLDS for c, to in zip(chars, tos, strict=True)}

#: One pass gives contents and canonical operators: "&&" and "||" before single characters.
TOKENS = r"&&|\|\||[;|&\r\n]|[^;|&\r\n]+"
OPERATORS = ("&&", "||", ";", "|", "&", "\r", "\n")

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("unquoted", T.StringType()), T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("dropped_non_ascii", T.IntegerType())])


def fold_char(c: str) -> str:
    """What a character becomes before those outside printable ASCII are dropped."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M")
    return "".join(_AFTER.get(x, x) for x in plain)


@cache
def fold_maps() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """For translate(): characters and their replacements (those without go); longer replacements;
    and the characters, as a regex class, that only exact() can fold."""
    one, gone, long, other = [], [], [], []
    for code in range(0x80, 0x30000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        to = fold_char(c)
        if to == c:
            continue
        if to == "":
            gone.append(c)
        elif len(to) == 1 and " " <= to <= "~":
            one.append((c, to))
        elif c in _AFTER:
            long.append((c, to))
        elif len(to) > 1 or to != c:
            other.append(code)
    ranges = []
    for code in other:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    cls = "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return "".join(c for c, _ in one) + "".join(gone), "".join(t for _, t in one), tuple(long), f"[{cls}]"


def fold(c: Column) -> Column:
    """Text of ASCII only stays as it is and isn't looked up character by character."""
    chars, to, long, _ = fold_maps()
    folded = F.translate(c, chars, to)
    for a, b in long:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(folded)


def needs_exact(c: Column) -> Column:
    return c.rlike(fold_maps()[3])


def strip_escapes(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPES, "")


def clean_piece(c: Column) -> Column:
    """Controls, folding, lower case, spaces."""
    c = F.regexp_replace(c, r"[\t\x0B\f\r\n]", " ")
    c = F.regexp_replace(c, r"[\x00-\x1F\x7F]", "")
    c = F.regexp_replace(fold(c), r"[^\x20-\x7E]", "")
    return F.trim(F.regexp_replace(F.lower(c), r" {2,}", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKENS), F.lit(0))


#: Marks before and after an operator in folded text. The input's own go first, as controls that are dropped anyway.
OPEN, CLOSE = "\x02", "\x03"


def _each(c: Column, chars: str, to: str) -> Column:
    """Each of a few characters replaced: a search of the bytes for each, where translate() looks every character up."""
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(to))
    return c


def marked(plain: Column) -> Column:
    """Folded text with its operators between marks: what folds to an operator's character isn't one, so they are marked before."""
    c = _each(plain, OPEN + CLOSE, "\x04")
    return fold(F.regexp_replace(c, r"(&&|\|\||[;|&\r\n])", f"{OPEN}$1{CLOSE}"))


def cleaned(folded: Column) -> Column:
    """Marked text in lower-case printable ASCII; a line end between marks becomes a space."""
    c = _each(folded, "\t\x0b\f\r\n", " ")
    return F.lower(F.regexp_replace(c, f"[^\\x20-\\x7E{OPEN}{CLOSE}]", ""))


def text_view(clean: Column) -> Column:
    """Contents and operators, ";" for line ends, single spaces between all."""
    c = _each(F.replace(clean, F.lit(f"{OPEN} {CLOSE}"), F.lit(" ; ")), OPEN + CLOSE, " ")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def segments(clean: Column) -> Column:
    contents = F.split(clean, f"{OPEN}[^{CLOSE}]*{CLOSE}")
    return F.filter(F.transform(contents, lambda t: F.trim(F.regexp_replace(t, " {2,}", " "))), lambda s: s != "")


def unquoted_view(text: Column) -> Column:
    return _each(text, "'\"", "")


def dropped(folded: Column) -> Column:
    """Characters that have no ASCII form, counted over the whole input without escapes; controls count, marks don't."""
    return F.length(F.regexp_replace(folded, f"[\\x20-\\x7E{OPEN}{CLOSE}]", "")).cast("int")


def native(c: Column) -> Column:
    folded = marked(strip_escapes(c))
    text = text_view(cleaned(folded))
    return F.struct(text.alias("text"), unquoted_view(text).alias("unquoted"), segments(cleaned(folded)).alias("segments"), dropped(folded).alias("dropped_non_ascii"))


def normalize_commands(df: DataFrame, column: str = "command", exotic: bool = False) -> DataFrame:
    """Adds text, unquoted, segments, dropped_non_ascii; null commands give nulls.

    Operators are marked and characters folded once; all results are cut from that text, which is its own
    projection. With ``exotic``, rows that need it go through exact(); the others send nulls there.
    """
    out = df.withColumn("folded_", marked(strip_escapes(F.col(column))))
    out = out.withColumn("clean_", cleaned(F.col("folded_")))
    out = out.withColumn("text", text_view(F.col("clean_"))).withColumn("segments", segments(F.col("clean_")))
    out = out.withColumn("unquoted", unquoted_view(F.col("text"))).withColumn("dropped_non_ascii", dropped(F.col("folded_")))
    if exotic:
        out = out.withColumn("exact_", exact(F.when(needs_exact(F.col(column)), F.col(column))))
        for f in RESULT.fieldNames():
            out = out.withColumn(f, F.coalesce(F.col(f"exact_.{f}"), F.col(f)))
        out = out.drop("exact_")
    return out.drop("folded_", "clean_")


_ESCAPES, _TOKENS = re.compile(ESCAPES), re.compile(TOKENS)


def _fold_text(s: str) -> tuple[str, int]:
    folded = "".join(map(fold_char, s))
    kept = "".join(c for c in folded if " " <= c <= "~")
    return kept, len(folded) - len(kept)


def _exact_one(command: str | None) -> dict | None:
    if command is None:
        return None
    plain = _ESCAPES.sub("", command)
    shown, segs = [], []
    for t in _TOKENS.findall(plain):
        if t in OPERATORS:
            shown.append(f" {';' if t in ';\r\n' else t} ")
            continue
        s = re.sub("[\x00-\x1f\x7f]", "", re.sub("[\t\x0b\f\r\n]", " ", t))
        s = re.sub(" {2,}", " ", "".join(c.lower() if c.isascii() else c for c in _fold_text(s)[0])).strip(" ")
        shown.append(s)
        segs += [s] if s else []
    text = re.sub(" {2,}", " ", " ".join(shown)).strip(" ")
    return {"text": text, "unquoted": text.replace("'", "").replace('"', ""), "segments": segs, "dropped_non_ascii": _fold_text(plain)[1]}


@F.pandas_udf(RESULT)
def exact(commands: pd.Series) -> pd.DataFrame:
    rows = [_exact_one(c) or dict.fromkeys(RESULT.fieldNames()) for c in commands]
    out = pd.DataFrame(rows, columns=RESULT.fieldNames())
    out["dropped_non_ascii"] = out["dropped_non_ascii"].astype("Int32")
    return out
