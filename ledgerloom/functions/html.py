"""HTML to plain text with built-in string expressions.

Follows a lenient parser: comments, declarations and the removed elements
disappear with their content, an unclosed removed element runs to the end of
the text, all other tags go and their text stays, character references are
decoded once. A reference may lack its semicolon where its name ends anyway;
an unknown one stays as it is.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.arrays import bind

# Elements whose content is no text.
REMOVED_ELEMENTS = ("style", "script", "head", "title")

# A quoted attribute value may hold '>'. All repeats are possessive: one pass,
# no backtracking on long texts.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
# A name ends with white space, a slash or the tag; a tag that closes itself has no content.
_REMOVED = rf"<({'|'.join(REMOVED_ELEMENTS)})(?=[\s/>]){_ATTRIBUTES}"
_DROPPED = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|{_REMOVED}(?:(?<=/)>|(?<!/)>.*?(?:</\1\s*>|\z))"
    r"|<![^>]*+>|<\?[^>]*+>"
)
_TAG = rf"</?[a-zA-Z]{_ATTRIBUTES}>"

# No character of any text.
_MARK = "\ufffe"
_REFERENCE = "^(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*)"

# All names of HTML 5, the usual ones first: a lookup tries them in turn.
_NAMES = {
    name: html5[f"{name};"]
    for name in ["amp", "quot", "lt", "gt", "nbsp", "apos", *name2codepoint, *(n.rstrip(";") for n in html5)]
}
# Numbers of control characters mean those of windows-1252.
_CONTROLS = {str(n): bytes([n]).decode("windows-1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def html_to_text(html: Column) -> Column:
    """The text of an HTML page.

    Where a tag was, a mark stays until references are decoded: a name without a
    semicolon ends there, and does not run on into the text behind the tag.
    """
    kept = F.regexp_replace(F.regexp_replace(html, _DROPPED, _MARK), _TAG, _MARK)
    return F.replace(decode_references(kept), F.lit(_MARK), F.lit(""))


def decode_references(text: Column) -> Column:
    """Replace character references such as &amp;, &#233; and &#xe9;."""
    controls = _constant_map(_CONTROLS)
    # A map is searched from its start, so there is one for each first letter.
    letters = sorted({name[0] for name in _NAMES})
    of_letter = {x: _constant_map({n: c for n, c in _NAMES.items() if n[0] == x}) for x in letters}
    names = F.create_map(*(column for x in letters for column in (F.lit(x), of_letter[x])))

    def character(reference):
        hexadecimal = F.regexp_extract(reference, "^#[xX]0*([0-9a-fA-F]*)$", 1)
        from_hexadecimal = F.when(F.length(hexadecimal) <= 6, F.conv(hexadecimal, 16, 10).cast("int"))
        is_decimal = F.substr(reference, F.lit(2)).rlike("^[0-9]+$")
        code = F.when(is_decimal, F.substr(reference, F.lit(2)).try_cast("int")).otherwise(from_hexadecimal)
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        known = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(controls, code.cast("string")), known, F.lit("\ufffd"))

    def decoded(part):
        reference = F.regexp_extract(part, _REFERENCE, 1)
        value = F.when(reference.startswith("#"), character(reference)).otherwise(
            F.try_element_at(F.try_element_at(names, F.substr(reference, F.lit(1), F.lit(1))), reference)
        )
        after = F.regexp_replace(F.substr(part, F.length(reference) + 1), "^;", "")
        return F.coalesce(F.concat(value, after), F.concat(F.lit("&"), part))

    def joined(pieces):
        tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))

    return bind(F.split(text, "&", -1), joined)


def _constant_map(entries: dict[str, str]) -> Column:
    """A map of text as one constant."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in entries.items())), F.lit("\x02"), F.lit("\x01"))
