"""Text expressions: accent folding, tokens, suffix reduction, slugs, path patterns. All run in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{Nd}]+"
#: (ending, what it becomes), the first that fits.
ENDINGS = (("coes", "cao"), ("soes", "sao"), ("zoes", "zao"), ("oes", "ao"), ("ais", "al"), ("eis", "el"), ("ois", "ol"), ("uis", "ul"), ("res", "r"))


def plain(text: str) -> str:
    """text without accents, in lower case; what fold() computes."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", bare).lower()


@cache
def _accents() -> tuple[str, str]:
    """Every letter that loses an accent, and what is left of it."""
    found = []
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c)[0] != "L" or 0xAC00 <= code < 0xD7A4:  # composed Hangul stays composed
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        bare = unicodedata.normalize("NFC", bare)
        if bare != c and len(bare) == 1:
            found.append((c, bare))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def unaccented(c: Column) -> Column:
    """c without accents; ASCII strings skip the table."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, *_accents()))


def fold(c: Column) -> Column:
    """c in lower case without accents, for comparing words."""
    return F.lower(unaccented(c))


def fold_text(c: Column) -> Column:
    """fold() for any text: combining marks go, too."""
    return F.lower(F.regexp_replace(unaccented(c), r"\p{Mn}+", ""))


def tokens(c: Column) -> Column:
    """The maximal runs of letters and digits, as written."""
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))


def words(c: Column) -> Column:
    """The folded tokens of a text; folding goes over the text once, since it keeps letters letters."""
    return tokens(fold(c))


def reduced(word: Column) -> Column:
    """A folded word's form without its plural ending; '' where it has none."""
    out = F.when(word.endswith("s") & ~word.endswith("ss") & ~word.endswith("is"), F.substr(word, F.lit(1), F.char_length(word) - 1)).otherwise(F.lit(""))
    for ending, to in reversed(ENDINGS):
        out = F.when(word.endswith(ending), F.concat(F.substr(word, F.lit(1), F.char_length(word) - len(ending)), F.lit(to))).otherwise(out)
    return F.when((F.octet_length(word) > 3) & (out != word), out).otherwise(F.lit(""))


def reduce_word(word: str) -> str:
    """reduced() of one word, for queries."""
    if len(word.encode()) <= 3:
        return ""
    for ending, to in ENDINGS:
        if word.endswith(ending):
            return word[: -len(ending)] + to
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "is")) else ""


def analyse(query: str) -> list[tuple[str, str]]:
    """(folded, reduced) of each token of a query."""
    import regex

    found = [plain(t) for t in regex.findall(TOKEN, query)]
    return [(t, reduce_word(t)) for t in found]


def terms(word: Column) -> Column:
    """The one or two terms a word is posted under."""
    return F.filter(F.array(word, reduced(word)), lambda t: t != "")


def slug(c: Column) -> Column:
    """What headings are compared by: folded, letters and digits only, single spaces between."""
    kept = F.regexp_replace(fold_text(c), r"[^\p{L}\p{Nd}\s]+", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def slug_of(text: str) -> str:
    kept = "".join(c for c in plain(text) if c.isalpha() or unicodedata.category(c) == "Nd" or c.isspace())
    return " ".join(kept.split())


def glob_regex(pattern: str) -> str | None:
    """A path pattern as a regular expression: * and ? stop at '/', [a-z], [^a], backslash escapes. None: malformed, matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            parts = []
            while True:
                if i >= len(pattern):
                    return None
                if pattern[i] == "]" and parts:
                    i += 1
                    break
                ends = []
                for _ in range(2):
                    if i >= len(pattern) or pattern[i] in "]-":
                        return None
                    i += pattern[i] == "\\"
                    if i >= len(pattern):
                        return None
                    ends.append(pattern[i])
                    i += 1
                    if pattern[i : i + 1] != "-" or len(ends) == 2:
                        break
                    i += 1
                if len(ends) == 2 and ends[0] > ends[1]:
                    continue
                parts.append("-".join("\\" + e if not e.isalnum() else e for e in ends))
            out.append(f"[{'^/' if negated else ''}{''.join(parts)}]")
        else:
            out.append(re.escape(c))
    return "^" + "".join(out) + "$"


def glob(c: Column, pattern: str) -> Column:
    expression = glob_regex(pattern)
    return F.lit(False) if expression is None else c.rlike("(?s)" + expression[:-1] + r"\z")


def percent_decoded(text: str) -> str:
    """%XX become bytes; what isn't such a triple stays."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "surrogateescape"))
    return raw.decode("utf-8", "replace")


def path_uri(path: str, scheme: str = "note") -> str:
    return f"{scheme}:///{quote(path, safe='/')}"


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of a text (counted from 0), as a text again."""
    return F.decode(F.substr(content.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
