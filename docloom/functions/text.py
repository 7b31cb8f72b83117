"""Column helpers whose results agree with JavaScript string semantics where that matters."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# White space as ECMAScript has it (Java's \s is ASCII only), but for the space itself.
_SPACES = r"\t-\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS, NOT_WS = f"[ {_SPACES}]", f"[^ {_SPACES}]"
#: the same, character by character, for functions that take no pattern
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value), with the value evaluated once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def word(pattern: str) -> str:
    """The pattern between ASCII word boundaries."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def js_trim(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(WS_CHARS))


def js_trim_start(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(WS_CHARS))


def collapse(c: Column | str) -> Column:
    """White space runs become one space, none is left at the ends."""
    plain = F.translate(col(c), WS_CHARS[1:], " " * (len(WS_CHARS) - 1))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 code units: astral characters count twice."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def utf16_span(c: Column | str, start: Column | str, end: Column | str) -> Column:
    """The text between two offsets in UTF-16 code units, as far as it goes."""
    cut = F.substring(F.encode(col(c), "UTF-16BE"), (2 * col(start) + 1).cast("int"), (2 * (col(end) - col(start))).cast("int"))
    return F.decode(cut, "UTF-16BE")


def approx_tokens(c: Column | str) -> Column:
    """A token per four UTF-16 code units, rounded up."""
    return F.ceil(F.octet_length(F.encode(col(c), "UTF-16BE")) / 8).cast("int")


def half_up(c: Column) -> Column:
    """Rounds halves up, negative ones too."""
    return F.floor(c + 0.5)


def source_id(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c).cast("binary"), 256), 1, 16)


def group_digits(c: Column | str) -> Column:
    return F.format_number(col(c), 0)


def register(spark: SparkSession) -> None:
    """The helpers as SQL functions of the session."""
    for name, args, kind, body in [
        ("approx_tokens", "t STRING", "INT", "CAST(ceil(octet_length(encode(t, 'UTF-16BE')) / 8) AS INT)"),
        ("source_id", "t STRING", "STRING", "substring(sha2(CAST(t AS BINARY), 256), 1, 16)"),
        ("utf16_length", "t STRING", "INT", "CAST(octet_length(encode(t, 'UTF-16BE')) / 2 AS INT)"),
        ("half_up", "x DOUBLE", "BIGINT", "floor(x + 0.5D)"),
    ]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
