"""Text helpers as Column expressions: Unicode whitespace, ASCII case, UTF-16, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def utrim(value: Column | str) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.regexp_replace(_c(value), f"^{WS}+|{WS}+$", "")


def clean_text(value: Column | str) -> Column:
    """Runs of Unicode whitespace become one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(value), f"{WS}+", " "))


def is_blank(value: Column | str) -> Column:
    return ~_c(value).rlike(rf"[^\p{{IsWhite_Space}}]")


def ascii_lower(value: Column | str) -> Column:
    return F.translate(_c(value), ASCII_UPPER, ASCII_LOWER)


def nbytes(value: Column | str) -> Column:
    return F.octet_length(_c(value))


def utf16_len(value: Column | str) -> Column:
    return (F.octet_length(F.encode(_c(value), "UTF-16BE")) / 2).cast("int")


def utf16_slice(value: Column | str, start: Column | str, end: Column | str) -> Column:
    units = F.encode(_c(value), "UTF-16BE")
    begin, stop = _c(start), _c(end)
    return F.decode(F.substring(units, begin * 2 + 1, (stop - begin) * 2), "UTF-16BE")


def splits_surrogate(value: Column | str, offset: Column | str) -> Column:
    """True if the UTF-16 offset falls between the halves of one character."""
    unit = F.hex(F.substring(F.encode(_c(value), "UTF-16BE"), _c(offset) * 2 + 1, F.lit(2)))
    return unit.between("DC00", "DFFF")


def json_escaped_bytes(value: Column | str) -> Column:
    """UTF-8 bytes of the text inside a JSON string literal, without the quotes."""
    return F.octet_length(F.to_json(F.struct(_c(value).alias("v")))) - F.lit(8)


def sha_hex(value: Column | str) -> Column:
    return F.sha2(_c(value).cast("string"), 256)


def length_prefixed_sha(*parts: Column | str) -> Column:
    """sha256 over every part, each led by its byte length as 8 big-endian bytes."""
    pieces = []
    for part in parts:
        text = _c(part)
        pieces.append(F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))
        pieces.append(F.encode(text, "UTF-8"))
    return F.sha2(F.concat(*pieces), 256)


def stable_id(namespace: str, *parts: Column | str) -> Column:
    """``<namespace>-`` + sha256(namespace, then a zero byte and each part)."""
    pieces = [F.encode(F.lit(namespace), "UTF-8")]
    for part in parts:
        pieces.append(F.unhex(F.lit("00")))
        pieces.append(F.encode(_c(part).cast("string"), "UTF-8"))
    return F.concat(F.lit(f"{namespace}-"), F.sha2(F.concat(*pieces), 256))
