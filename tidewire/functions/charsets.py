"""Text of bytes whose character set is told badly or not at all, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What bytes 0x80 to 0x9F stand for where they are letters; the others stay control characters. Fixed values.
WESTERN = dict(zip((*range(0x80, 0x81), *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F), "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ", strict=True))
#: Names of sets that are read as Western. Fixed values.
WESTERN_NAMES = ("iso-8859-1", "iso8859-1", "iso_8859-1", "latin1", "l1", "windows-1252", "cp1252", "x-cp1252", "ascii", "us-ascii")


def declared(raw: Column) -> Column:
    """The character set that the first kilobyte of a page or feed names, in lower case; null if none."""
    head = F.decode(F.substring(raw, 1, 1024), "ISO-8859-1")
    xml = F.regexp_extract(head, r"""(?i)<\?xml[^>]*encoding=["']([\w.-]+)["']""", 1)
    meta = F.regexp_extract(head, r"""(?i)<meta[^>]+charset=["']?([\w.-]+)""", 1)
    return F.lower(F.coalesce(F.nullif(xml, F.lit("")), F.nullif(meta, F.lit(""))))


def western(raw: Column) -> Column:
    """Bytes as Western text: curly quotes and dashes where Latin-1 has control characters."""
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, WESTERN)), "".join(WESTERN.values()))


def _wide(raw: Column, name: str) -> Column:
    """Text of two-byte units; a byte left over gives a replacement character, a half of a pair that stands alone too."""
    even = F.substring(raw, 1, (F.length(raw) - F.length(raw) % 2).cast("int"))
    return F.concat(F.decode(even, name), F.when(F.length(raw) % 2 == 1, F.lit("�")).otherwise(""))


def decoded(raw: Column, said: Column | None = None) -> Column:
    """The text of a body: by its byte order mark, as UTF-8 if it is valid, by the set that is said or that it names, else with replacements.

    Real UTF-8 under a wrong name is commoner than other text that happens to be valid UTF-8. Names
    other than Western and two-byte ones are not known here. Null stays null.
    """
    mark = F.hex(F.substring(raw, 1, 2))
    bare = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.substring(raw, F.lit(4), F.length(raw))).otherwise(raw)
    text = bare.cast("string")
    name = F.lower(F.coalesce(*([F.nullif(F.trim(said), F.lit(""))] if said is not None else []), declared(raw)))
    return (
        F.when(mark == "FFFE", _wide(F.substring(raw, F.lit(3), F.length(raw)), "UTF-16LE"))
        .when(mark == "FEFF", _wide(F.substring(raw, F.lit(3), F.length(raw)), "UTF-16BE"))
        .when(F.is_valid_utf8(text), text)
        .when(name.isin(*WESTERN_NAMES), western(raw))
        .when(name == "utf-16le", _wide(raw, "UTF-16LE"))
        .when(name == "utf-16be", _wide(raw, "UTF-16BE"))
        .otherwise(F.make_valid_utf8(text))
    )
