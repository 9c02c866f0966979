"""Text, name and identifier expressions. Each takes and returns columns and stays in the JVM."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of HTML's markup, as far as it decides what is text. Loops are possessive, so no input makes a match recurse.
_WS = r"[ \t\n\f\r]"
_VALUE = r""""[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^ \t\n\f\r"'>][^ \t\n\f\r>]*+"""
_ATTRIBUTES = rf"(?:[ \t\n\f\r/]++|(?:=[^ \t\n\f\r/>=]*+|[^ \t\n\f\r/>=]++)(?:{_WS}*+={_WS}*+(?:{_VALUE})?+)?+)*+(?:>|\z)"
_HIDDEN = r"(?=[ \t\n\f\r/>]|\z)"
MARKUP = "(?is)" + "|".join(
    (
        r"<!--(?:-?>|.*?(?:--!?>|\z))",  # comments, closed or not
        rf"<(script|style){_HIDDEN}{_ATTRIBUTES}.*?(?:</\1{_HIDDEN}{_ATTRIBUTES}|\z)",  # elements whose content is no text
        rf"</?[a-z][^ \t\n\f\r/>]*+{_ATTRIBUTES}",  # tags: a quoted value may hold anything
        r"<[!?][^>]*+(?:>|\z)|</>|</[^a-z>][^>]*+(?:>|\z)",  # declarations, and what browsers take for comments
    )
)

#: Named character references, with the semicolon, and those that count without it too; a no-break space is a blank here.
NAMED = {name: text.replace("\xa0", " ") for name, text in html5.items()}
_BARE = "|".join(sorted((n for n in NAMED if n[-1] != ";"), key=lambda n: (-len(n), n)))
#: Numbers from 0x80 to 0x9F mean what Windows-1252 has there.
_C1 = [(chr(n), bytes([n]).decode("cp1252")) for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_PAIR, _KEY = "\x01", "\x02"


def trim_all(c: Column) -> Column:
    """Strip every kind of ASCII white space at both ends, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def symbol(c: Column) -> Column:
    return F.upper(trim_all(c))


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\x0B\f]+", " "))


def slugify(c: Column) -> Column:
    """Lower case, each run outside ``a-z0-9-`` a dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9-]+", "-"), "^-+|-+$", "")


def safe_name(c: Column, most: int = 120) -> Column:
    """A file name: each run outside letters, digits, dot, underscore and dash is an underscore."""
    return F.substring(F.regexp_replace(c, "[^a-zA-Z0-9._-]+", "_"), 1, most)


def collection_slug(symbol_col: Column, keyword: str, prefix: str | None = "filings") -> Column:
    slug = slugify(F.concat_ws("-", F.upper(symbol_col), F.lit(keyword)))
    return F.concat(F.lit(f"{prefix}_"), slug) if prefix else slug


def normalize_cik(c: Column) -> Column:
    """Digits only, padded with zeros to ten; longer numbers are not cut. No digit gives null."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) > 0, F.lpad(digits, F.greatest(F.lit(10), F.length(digits)), F.lit("0")))


def size_bytes(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def html_title(c: Column) -> Column:
    """Text of the first title element, null if there is none."""
    found = F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(collapse_whitespace(found), F.lit(""))


def html_text(c: Column, decode: bool = True, bare: bool = True) -> Column:
    """Visible text: script, style and comments dropped, tags a blank each, references decoded, white space collapsed. Native.

    Markup that never ends, as an open comment, script or quoted value, hides the rest, as it does in a browser. Elements
    other than script and style whose content browsers read as plain text (title, textarea) are read like any.
    Without ``bare``, references that lack their semicolon, as where a text was cut off, stay as they are.
    """
    out = F.regexp_replace(c, MARKUP, " ")
    return collapse_whitespace(decode_references(out, bare) if decode else out)


def _character(number: Column) -> Column:
    """The text of a code point; the replacement character for those that are none."""
    wrong = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, F.lit("0"))), "UTF-32")
    return F.when(wrong, F.lit("\ufffd")).otherwise(F.translate(char, "".join(a for a, _ in _C1) + "\xa0", "".join(b for _, b in _C1) + " "))


def decode_references(c: Column, bare: bool = True) -> Column:
    """Numeric and named character references as the characters they stand for, each once: what they make is not read again.

    With ``bare``, those that browsers read without a semicolon are decoded without it too.
    """
    end = ";?" if bare else ";"
    names = F.str_to_map(F.lit(_PAIR.join(f"{k}{_KEY}{v}" for k, v in NAMED.items())), F.lit(_PAIR), F.lit(_KEY))

    def one(piece: Column) -> Column:
        digits, hexes = (F.regexp_extract(piece, p, 1) for p in (f"^#0*([0-9]+){end}", f"^#[xX]0*([0-9a-fA-F]+){end}"))
        code = F.when(digits != "", F.when(F.length(digits) <= 7, digits.cast("int")).otherwise(0x110000)).otherwise(F.when(F.length(hexes) <= 6, F.conv(hexes, 16, 10).cast("int")).otherwise(0x110000))
        name, short = F.regexp_extract(piece, "^[a-zA-Z][a-zA-Z0-9]*;", 0), F.regexp_extract(piece, f"^(?:{_BARE})", 0) if bare else F.lit("")
        rest = lambda found: F.substring(piece, F.length(found) + 1, F.length(piece))
        number = F.regexp_extract(piece, f"^#(?:[0-9]+|[xX][0-9a-fA-F]+){end}", 0)
        return (
            F.when(number != "", F.concat(_character(code), rest(number)))
            .when(F.try_element_at(names, name).isNotNull(), F.concat(F.try_element_at(names, name), rest(name)))
            .when(short != "", F.concat(F.try_element_at(names, short), rest(short)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(c, "&", -1)
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""))
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def has_keyword(text: Column, keyword: str) -> Column:
    """The keyword, whatever its case, as a plain substring."""
    return F.contains(F.lower(text), F.lit(keyword.lower()))


def stable_id(*parts: Column) -> Column:
    """A deterministic id: reruns write the same points."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def format_prompt(template: str, **values: Column) -> Column:
    """Fill ``{name}`` fields with columns; doubled braces are literal. The template is cut up on the driver."""
    import string

    pieces = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field:
            pieces.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")
