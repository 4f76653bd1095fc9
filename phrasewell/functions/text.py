"""Text rules as column expressions: lines, identifiers, zones, definitions, left context."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers, comment marks, structural characters and white space.
IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]{2,}"
COMMENT = r"^(#|//|/\*|\*|<!--|>)"
STRUCTURAL = r"[{}()\[\]<>;:=|&!@#$%^*\-+/?\\]"
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts a line into word runs and the rest; the pieces concatenate to the line again.
PIECES = "[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+"
DEFINITION = r"(?<![A-Za-z0-9_.])[a-zA-Z_][a-zA-Z0-9_]{2,}+(?=[ \t]*+[A-Za-z0-9_]*+[ \t]*+(?:[(<\[=:{]|->))"

# What may follow "#" in a directive, by its first two letters.
DIRECTIVES = ("in", "de", "if", "en", "pr", "er", "wa")


def lines(text: Column) -> Column:
    """Array of lines: split at LF or CRLF, no extra line after a final newline, none for empty text."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(F.length(text) > 0, F.split(body, r"\r?\n", -1)).otherwise(F.array().cast("array<string>"))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE_SPACE))


def identifiers(line: Column) -> Column:
    """Array of identifiers of three characters or more, in order, repeats kept."""
    return F.regexp_extract_all(line, F.lit(IDENTIFIER), F.lit(0))


def identifier_list(text: str) -> list[str]:
    """The same for a query string on the driver."""
    return re.findall(IDENTIFIER, text, re.ASCII)


def definitions(line: Column) -> Column:
    """Array of identifiers that look defined here: not after a word character or dot, and an opener follows, one word at most between."""
    return F.regexp_extract_all(line, F.lit(DEFINITION), F.lit(0))


def is_comment(line: Column) -> Column:
    return trimmed(line).rlike(COMMENT)


def _without(s: Column, pattern: str) -> Column:
    return F.regexp_replace(s, pattern, "")


def zone_of_trimmed(s: Column, names: Column) -> Column:
    """0 for code, 1 for prose, of a line without outer white space that holds ``names`` identifiers.

    From three identifiers on, no ratio matters, so characters are counted in short lines only.
    """
    size = F.greatest(F.octet_length(s), F.lit(1))
    lower, structural = F.length(_without(s, "[^a-z]+")) / size, (F.length(s) - F.length(_without(s, STRUCTURAL + "+"))) / size
    words = F.greatest(F.regexp_count(s, F.lit(r"(?U)\S+")), F.lit(1))
    hashed = F.when(F.substring(s, 2, 1) == "!", 0).when((F.octet_length(s) > 2) & F.substring(s, 2, 2).isin(*DIRECTIVES), 0).otherwise(1)
    return (
        F.when(s == "", 1)
        .when(s.startswith("//") | s.startswith("/*"), 1)
        .when(s.startswith("#"), hashed)
        .when(s.startswith("*") | s.startswith("<!--") | s.startswith(">"), 1)
        .when(names >= 3, 0)
        .when(names == 0, 1)
        .when((lower > 0.65) & (structural < 0.08), 1)
        .when((names < 2) & (lower > 0.5) & (structural < 0.05) & (F.octet_length(_without(s, r"(?U)\s+")) / words < 6), 1)
        .otherwise(0)
    )


def line_zone(line: Column) -> Column:
    """The zone of a line, which is trimmed and searched for identifiers once."""
    facts = F.struct(trimmed(line).alias("s"), F.regexp_count(line, F.lit(IDENTIFIER)).alias("n"))
    return F.transform(F.array(facts), lambda x: zone_of_trimmed(x["s"], x["n"]))[0]


def pieces(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(PIECES), F.lit(0))


def left_word(prefix: Column) -> Column:
    """Last white-space separated word of the text before a token: 30 characters at most, lower case; "" if there is none."""
    ended = F.regexp_replace(prefix, r"(?U)\s+\z", "")
    return F.lower(F.left(F.regexp_replace(ended, r"(?sU)^.*\s", ""), F.lit(30)))


def extension(path: Column) -> Column:
    """Text after the last dot (the whole path without one) if it has 6 bytes at most, else null."""
    ext = F.substring_index(path, ".", -1)
    return F.when(F.octet_length(ext) <= 6, ext)


def module(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def pack_flags(is_def: Column, zone: Column, count: Column) -> Column:
    """is_def + 1 in 2 bits, zone in 1, the count up to 31 in 5."""
    return (is_def + 1).bitwiseAND(F.lit(3)).bitwiseOR(F.shiftleft(zone.bitwiseAND(F.lit(1)).cast("int"), 2)).bitwiseOR(F.shiftleft(F.least(count, F.lit(31)).cast("int"), 3)).cast("int")


def unpack_flags(flags: Column) -> Column:
    """Struct of ``is_def, zone, count`` (31: 31 or more)."""
    return F.struct((flags.bitwiseAND(F.lit(3)) - 1).alias("is_def"), F.shiftright(flags, 2).bitwiseAND(F.lit(1)).alias("zone"), F.shiftright(flags, 3).bitwiseAND(F.lit(31)).alias("count"))


def pack_line(line: Column) -> Column:
    return F.pmod(line, F.lit(65536))


def cut_body(body: Column, most: int = 51_200) -> Column:
    """Bodies above ``most`` bytes are cut there and marked."""
    return F.when(F.octet_length(body) > most, F.concat(F.left(body, F.lit(most)), F.lit("\n... [truncated]"))).otherwise(body)
