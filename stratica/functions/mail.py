"""Column functions over mail texts, headers, file names and answers of services."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where quoted history begins, and where a signature begins.
QUOTE_MARKS = (
    r"_{25,}",
    r"(?m:^\s*_{10,}\s*$)",
    r"(?i:-{3,}\s*(Original Message|Ursprüngliche Nachricht)\s*-{3,})",
    r"(?im:^\s*(From|Von):\s.*(?:\n.*){0,4}?^\s*(Sent|Gesendet|Date):\s)",
    r"(?ims:^[ \t>]*On\b.{0,300}?\bwrote:\s*$)",
    r"(?ims:^[ \t>]*Am\b.{0,300}?\bschrieb\b.{0,120}?:\s*$)",
)
SIGNATURE_MARKS = (
    r"(?m:^-- ?$)",
    r"(?im:^\s*Sent from (my |Outlook).*$)",
    r"(?im:^\s*Von meinem (iPhone|iPad|Samsung|Android).*$)",
    r"(?im:^\s*Get Outlook for (iOS|Android).*$)",
)
REFUSED_STATUS, GONE_STATUS = (403,), (404, 410)


#: What the marks' signs stand for: white space and edges of words in ASCII, letters in every case that Unicode folds to them.
SPELLED = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\s": r"[\t\n\f\r ]", "k": "[kK\u212a]", "s": "[sS\u017f]", "ü": "[üÜ]"}


def spelled(mark: str) -> str:
    """A mark in Java's syntax: its ``\\b`` goes by Unicode, its ``\\s`` has the vertical tab, and ``(?i)`` folds ASCII letters alone."""
    return re.sub(r"\\.|\(\?[a-z]+:|[ksü]", lambda m: SPELLED.get(m[0] if len(m[0]) > 1 else m[0].lower(), m[0]), mark, flags=re.IGNORECASE)


def strip_quoted(text: Column) -> Column:
    """The new part of a mail: cut at the first quote mark, then at signature marks (never at the start), without ``>`` lines.  Null stays null."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    # what follows a mark goes with it: no places are counted, which Java does in units of UTF-16
    out = F.regexp_replace(out, "(?d)(?:" + "|".join(map(spelled, QUOTE_MARKS)) + ")(?s:.*)", "")
    for mark in SIGNATURE_MARKS:
        out = F.regexp_replace(out, r"(?d)(?!\A)" + spelled(mark) + "(?s:.*)", "")
    return F.regexp_replace(out, r"(?md)^[ \t]*>.*$", "")


def thread_key(thread_index: Column, references: Column, reply_to: Column, message_id: Column) -> Column:
    """Conversation of a mail: the first 22 bytes of its index, else the first id it refers to, else its own; empty without any."""
    head = F.substring(F.try_to_binary(thread_index, F.lit("base64")), 1, 22)
    named = lambda c: F.nullif(F.regexp_extract(c, "<([^>]+)>", 1), F.lit(""))
    own = F.nullif(F.regexp_replace(F.trim(message_id), "^<+|>+$", ""), F.lit(""))
    first = F.coalesce(named(references), named(reply_to), own)
    return F.coalesce(F.when(F.octet_length(head) == 22, F.concat(F.lit("tix:"), F.lower(F.hex(head)))), F.concat(F.lit("mid:"), F.lower(first)), F.lit(""))


def safe_name(name: Column, instead: str = "anhang") -> Column:
    """The last part of a path without characters that file systems refuse, at most 150 characters."""
    last = F.element_at(F.split(F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit("\\"), F.lit("/")), "/", -1), -1)
    clean = F.left(F.regexp_replace(F.regexp_replace(last, r'[<>:"|?*\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", ""), F.lit(150))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(instead))


def extensions(names: Column) -> Column:
    """Sorted, distinct lower-case extensions (letters and digits, at most 8) of an attachment line."""
    found = F.transform(attachment_names(names), lambda n: F.regexp_extract(F.lower(n), r"\.([\p{L}\p{N}]{1,8})$", 1))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda e: e != ""))), " ")


def address_list(line: Column) -> Column:
    """(name, mail) of every address of a header line, in its order: ``Name <mail>``, ``"Last, First" <mail>`` or the address alone."""
    found = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(r'((?:"(?:[^"\\]|\\.)*"|[^,;<>"])*<[^<>]*>|[^\s,;<>"]+)'), F.lit(1))
    named = lambda a: F.regexp_replace(F.regexp_replace(F.trim(F.substring_index(a, "<", 1)), '^"|"$', ""), r"\\(.)", "$1")
    one = lambda a: F.when(a.contains("<"), F.struct(F.trim(named(a)).alias("name"), F.trim(F.regexp_extract(a, "<([^<>]*)>", 1)).alias("mail"))).otherwise(F.struct(F.lit("").alias("name"), a.alias("mail")))
    return F.transform(found, one)


def domains(addresses: Column) -> Column:
    """Sorted, distinct lower-case domains of an array of addresses."""
    found = F.transform(addresses, lambda a: F.regexp_extract(F.lower(F.trim(a)), "@([^@]*)$", 1))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda d: d != ""))), " ")


def external(party: Column, own: Sequence[str]) -> Column:
    """Whether any of the domains is not one's own; unknown without domains."""
    return F.when(F.trim(party) != "", F.size(F.array_except(F.split(F.trim(party), " +"), F.array(*[F.lit(d) for d in own]))) > 0)


def folder_unit(src: Column, root: Column, path: Column) -> Column:
    """The unit a folder belongs to: one segment for chats, boards, pages and notes, two for libraries, else the folder."""
    one = src.isin("teams", "planner", "pages", "onenote") | ((src == "datei") & (root == "teams"))
    return F.when(one, F.substring_index(path, "/", 1)).when((src == "datei") & (root == "sharepoint"), F.substring_index(path, "/", 2)).otherwise(path)


def verdict_class(status: Column, code: Column) -> Column:
    """refused, gone, or retry for an answer's status and error code."""
    return F.when(status.isin(*REFUSED_STATUS) | (F.lower(code) == "malwaredetected"), "refused").when(status.isin(*GONE_STATUS), "gone").otherwise("retry")


def source_uri(root: Column, rel: Column) -> Column:
    """A file's address: its path percent-encoded, slashes too, so that it is one segment."""
    encoded = F.replace(F.replace(F.url_encode(rel), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit("o365://"), root, F.lit("/"), F.replace(encoded, F.lit("%7E"), F.lit("~")))


def subject_stem(subject: Column) -> Column:
    """The subject without reply and forward prefixes."""
    return F.regexp_replace(F.trim(subject), r"(?i)^((re|aw|fw|fwd|wg)\s*:\s*)+", "")


def attachment_names(att: Column) -> Column:
    """Names of an attachment line: parted by ``|``, or in lines without one by blanks, where a name ends with a word that has an extension."""
    trimmed = lambda names: F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    ended = F.regexp_replace(F.regexp_replace(att, r"(\.[A-Za-z0-9]{1,8})( +|$)", "$1|"), " +", " ")
    return F.when(att.contains("|"), trimmed(F.split(att, r"\|", -1))).otherwise(trimmed(F.split(ended, r"\|", -1)))


def short_hash(text: Column) -> Column:
    """Eight hexadecimal characters by which shortened names differ."""
    return F.left(F.sha1(F.coalesce(text, F.lit(""))), F.lit(8))


def phones(text: Column) -> Column:
    """Sorted, distinct telephone numbers in a text: seven digits and more, with blanks, brackets, slashes and dashes between."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\+?\d[\d ()/-]{5,}\d)"), F.lit(1)), lambda t: F.trim(t))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: F.length(F.regexp_replace(t, r"\D", "")) >= 7)))


def contacts(text: Column) -> Column:
    """Sorted, distinct mail addresses in a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1))))


def window_size(chars: Column) -> Column:
    """Context of a model: the power of two that holds a quarter of the characters and 1,024 more, from 4,096 to 32,768."""
    needed = F.floor(chars / 4) + 1024
    return F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(needed))), F.lit(4096.0)), F.lit(32768.0)).cast("long")
