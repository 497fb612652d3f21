"""Column functions over text: all built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often it is named there (a plain Column is written out anew each time)."""
    return F.transform(F.array(value), use)[0]


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


# The named characters of HTML that texts of offices use, &amp; last.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß",
    "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç", "ocirc": "ô", "icirc": "î", "ucirc": "û", "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú",
    "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bdquo": "„", "sbquo": "‚", "laquo": "«", "raquo": "»",
    "euro": "€", "pound": "£", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "middot": "·", "bull": "•", "times": "×", "sect": "§", "plusmn": "±", "amp": "&",
}


def numbered_characters(text: Column) -> Column:
    """``&#8364;`` and ``&#x20ac;`` as the characters they stand for; others stay as they are."""
    parts = F.split(text, "&#(?=[0-9]{1,7};|[xX][0-9a-fA-F]{1,6};)", -1)
    code = lambda part: F.coalesce(F.conv(F.nullif(F.regexp_extract(part, "^[xX]([0-9a-fA-F]+);", 1), F.lit("")), 16, 10), F.regexp_extract(part, "^([0-9]+);", 1)).cast("int")
    known = lambda c: F.when((c > 0) & (c < 0x110000) & ~c.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")).otherwise("\ufffd")
    shown = F.transform(F.slice(parts, 2, 1 << 30), lambda part: F.concat(known(code(part)), F.regexp_replace(part, "^[0-9a-fA-FxX]+;", "")))
    return F.when(text.contains("&#"), F.concat(parts[0], F.array_join(shown, ""))).otherwise(text)


def unescape(text: Column) -> Column:
    """Named and numbered characters of HTML resolved, once."""
    out = numbered_characters(text)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def strip_html(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags; characters resolved; white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return collapse(unescape(out))


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def like_person(column: Column, wanted: str) -> Column:
    """Substring on lower case in which ``*`` is the only wildcard."""
    plain = wanted.lower()
    if "*" not in plain:
        return F.lower(column).contains(plain)
    escaped = plain.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return F.lower(column).like(f"%{escaped}%")


def in_subtree(path: Column, folder: str) -> Column:
    """The folder itself or anything below it, never a namesake with a longer name."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def snippet(text: Column, wanted: Sequence[str], size: int) -> Column:
    """``size`` characters around the first of the lower-case words, a quarter of them before it; where the start is cut off, an ellipsis counts in.

    Without a match, and where the match stands near the start, the head of the text.  Null stays null.
    """
    lower = F.lower(text)
    places = F.filter(F.array(*[F.locate(w, lower) for w in wanted]), lambda p: p > 0) if wanted else F.array().cast("array<int>")
    start = F.greatest(F.lit(0), F.array_min(places) - 1 - size // 4)
    return F.when(start > 0, F.concat(F.lit("…"), F.ltrim(F.substring(text, start + 1, F.lit(size - 1))))).otherwise(F.left(text, F.lit(size)))
