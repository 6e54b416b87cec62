"""The few functions that need Python: block files of sector membership and initials of names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of block files: where blocks begin, bytes of the smallest file, bytes and characters of a name, and the zeros that may
#: stand before a code.
FIRST, SMALLEST, NAME_BYTES, NAME_CHARS, GAP = 0x140, 0x200, 32, (2, 16), 16
#: A name of two-byte characters, or of a digit and a letter before these; zero; flags up to 02 00 or 02 00 00 00; six digits and a zero
#: for each code, with up to GAP zeros between.
_BLOCK = re.compile(
    rb"((?:[\x81-\xfe][\x40-\xfe]|(?:5G|3D|2B)(?=[\x81-\xfe]))[^\x00]{0,%d})\x00" % (NAME_BYTES - 2)
    + rb".{0,14}?\x02\x00(?:\x00\x00)?"
    + rb"\x00{0,%d}([0-9]{6}(?=\x00)(?:\x00{1,%d}[0-9]{6}(?=\x00))*)" % (GAP, GAP + 1),
    re.DOTALL,
)
_NAME_CHAR = re.compile(r"[\w+\-*]")


def blocks(data: bytes) -> Iterator[tuple[str, list[str]]]:
    """(name, codes) of each block of a block file. What can't be read is passed over up to the next place where a block may
    begin; so of a name that is too long the end counts."""
    at = FIRST if len(data) >= SMALLEST else len(data)
    while found := _BLOCK.search(data, at):
        try:
            name = found[1].decode("gbk").strip()
        except UnicodeDecodeError:
            name = ""
        if NAME_CHARS[0] <= len(name) <= NAME_CHARS[1] and len(_NAME_CHAR.findall(name)) >= 2:
            yield name, [c.decode() for c in re.findall(rb"[0-9]{6}", found[2])]
            at = found.end()
        else:
            at = found.start() + 1


@F.udtf(returnType="name string, nth int, stock_code string")
class BlockMembers:
    """A row for each code of each block of a file's bytes, numbered within the block."""

    def eval(self, data: bytes) -> Iterator[tuple[str, int, str]]:
        for name, codes in blocks(bytes(data or b"")):
            for nth, code in enumerate(codes):
                yield name, nth, code


def block_members(files: DataFrame) -> DataFrame:
    """path, name, nth, stock_code of block files (path, content), as the binaryFile source reads them: a file is one row, of a few MB."""
    return files.lateralJoin(BlockMembers(F.col("content").outer())).select("path", "name", "nth", "stock_code")


def initials(name: Column, readings: dict[str, str]) -> Column:
    """First letters of a name's characters by a table of readings; ASCII letters and digits stand for themselves."""

    @F.pandas_udf("string")
    def first_letters(names: pd.Series) -> pd.Series:
        letter = lambda c: c.upper() if c.isascii() and c.isalnum() else readings.get(c, "")[:1].upper()
        return names.map(lambda n: None if n is None else "".join(letter(c) for c in n))

    return first_letters(name)
