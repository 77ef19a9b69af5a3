"""Text functions as columns; only Unicode normal forms need Python."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}"
SPACE = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"

#: The same classes for Java's expressions, whose scripts are dear: an ASCII character is settled before any is asked for.
NOT_ASCII = "[^\\x00-\\x7f]"
CJK_CLASS = f"[{NOT_ASCII}&&[{CJK}]]"
SPACE_CLASS = f"[\\s[{NOT_ASCII}&&[{SPACE}]]]"
EITHER_CLASS = f"[\\s[{NOT_ASCII}&&[{CJK}{SPACE}]]]"

#: Characters that ``upper_each`` keeps: their capitals take more than one character, or are younger than SQL's tables.
NO_CAPITAL = (
    "\u0149\u019b\u01f0\u0264\u0390\u03b0\u0587\u1c8a\u1e96-\u1e9a\u1f50\u1f52\u1f54\u1f56\u1f88-\u1f8f\u1f98-\u1f9f\u1fa8-\u1faf\u1fb2\u1fb4\u1fb6\u1fb7\u1fbc\u1fc2"
    "\u1fc4\u1fc6\u1fc7\u1fcc\u1fd2\u1fd3\u1fd6\u1fd7\u1fe2-\u1fe4\u1fe6\u1fe7\u1ff2\u1ff4\u1ff6\u1ff7\u1ffc\ua7cd\ua7db\ufb00-\ufb06\ufb13-\ufb17\U00010d70-\U00010d85"
)
#: Characters that have a capital of one character, though Spark's ``upper`` writes more than one.
SMALL = "ß" + "".join(chr(c + i) for c in (0x1F80, 0x1F90, 0x1FA0) for i in range(8)) + "ᾳῃῳ"
CAPITAL = "ẞ" + "".join(chr(c + i) for c in (0x1F88, 0x1F98, 0x1FA8) for i in range(8)) + "ᾼῌῼ"

#: Any character but those, of common scripts, that neither change in NFC nor join one before; a text without it is in NFC.
MAY_COMPOSE = "[^\\x00-\\u02ff\\u0400-\\u0482\\u048a-\\u052f\\u1e00-\\u1eff\\u2002-\\u200f\\u2010-\\u205f\\u2190-\\u21ff\\u2200-\\u2328\\u2500-\\u2a00\\u3001-\\u3029\\u3041-\\u3096\\u309b-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7a3\\uff01-\\uff60\\x{1f300}-\\x{1faff}]"
#: Any character beyond Latin, looked for first: one range is cheap to look for, many are not.
NOT_LATIN = "[^\\x00-\\u02ff]"
#: Rows that are Python strings at a time in a task.
SLICE = 256

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _normal(text: pa.Array, form: str) -> pa.Array:
    parts = (text.slice(at, SLICE).to_pylist() for at in range(0, len(text), SLICE))
    done = [pa.array([x if x is None or x.isascii() else unicodedata.normalize(form, x) for x in part], pa.string()) for part in parts]
    return pa.concat_arrays(done) if done else text


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    return _normal(text, "NFC")


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return _normal(text, "NFKC")


def count_matches(text: ColumnOrName, pattern: str) -> Column:
    return F.regexp_count(_c(text), F.lit(pattern))


def token_estimate(text: ColumnOrName) -> Column:
    """One token for each CJK character and for every four others that aren't white space."""
    other = F.length(F.regexp_replace(_c(text), f"{EITHER_CLASS}++", ""))
    return (count_matches(text, CJK_CLASS) + F.ceil(other / 4)).cast("long")


def detect_language(text: ColumnOrName) -> Column:
    """zh, en or und by the counts of Han and Latin characters."""
    han, latin = count_matches(text, "\\p{IsHan}"), count_matches(text, "\\p{IsLatin}")
    return F.when((han == 0) & (latin == 0), "und").when(han > latin * 0.2, "zh").otherwise("en")


def tidy(text: ColumnOrName) -> Column:
    """Line ends, trailing blanks and blank lines made uniform; trimmed. All of normalize_text but the normal form."""
    x = F.regexp_replace(_c(text), "\\r\\n?", "\n")
    x = F.regexp_replace(x, "[\\t ]++(?=\\n|\\z)", "")
    x = F.regexp_replace(x, "\\n{3,}", "\n\n")
    return F.regexp_replace(x, f"\\A{SPACE_CLASS}++|{SPACE_CLASS}++\\z", "")


def normalize_text(text: ColumnOrName) -> Column:
    """Python sees only texts that the normal form may change."""
    asked = F.when(_c(text).rlike(NOT_LATIN) & _c(text).rlike(MAY_COMPOSE), tidy(text))
    return F.coalesce(nfc(asked), tidy(text))


def normalize_label(text: ColumnOrName) -> Column:
    """NFKC, trimmed, white space made single, lower case."""
    return F.lower(F.trim(F.regexp_replace(nfkc(_c(text)), f"{SPACE_CLASS}++", " ")))


def upper_each(text: ColumnOrName) -> Column:
    """Upper case of each character by itself, as SQL has it: ß becomes ẞ, and one that has no single capital stays."""
    x = F.translate(_c(text), SMALL, CAPITAL)
    pieces = F.split(x, f"(?<=[{NO_CAPITAL}])|(?=[{NO_CAPITAL}])")
    apart = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"[{NO_CAPITAL}]"), p).otherwise(F.upper(p))), "")
    return F.when(x.rlike(f"[{NO_CAPITAL}]"), apart).otherwise(F.upper(x))


def sha256(text: ColumnOrName) -> Column:
    return F.sha2(_c(text), 256)


def tokens(text: ColumnOrName) -> Column:
    """The set of lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), "[^\\p{L}\\p{N}]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / F.when(union > 0, union))


def excerpt(text: ColumnOrName, needle: str, before: int = 80, width: int = 320) -> Column:
    """A window on the first place where ``needle`` is found, with ellipses where it cuts."""
    text = _c(text)
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(F.lit(1), at - before)
    head = F.when(start > 1, "…").otherwise("")
    tail = F.when(start + width - 1 < F.length(text), "…").otherwise("")
    return F.concat(head, text.substr(start, F.lit(width)), tail)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or ("\\" + glob[i] if not glob[i].isalnum() and glob[i] not in "/_-" else glob[i])
            i += 1
    return f"^{out}$"


def matches_any(path: ColumnOrName, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | _c(path).rlike(glob_pattern(g))
    return out


def is_hidden(path: ColumnOrName) -> Column:
    return _c(path).rlike("(^|/)\\.[^/]")


def is_sensitive(path: ColumnOrName) -> Column:
    """Environment files, keys and credential files."""
    return F.lower(_c(path)).rlike("(^|/)(\\.env[^/]*|[^/]*\\.(pem|key|p12)|credentials\\.json|secrets\\.json)$")


def has_secret(text: ColumnOrName) -> Column:
    """A value that looks like a key or password assignment."""
    return _c(text).rlike("(?i)(api[_-]?key|secret|token|password)[\"']?\\s*[:=]\\s*[\"']?[A-Za-z0-9_\\-./+]{12,}")


def mentions_any(text: ColumnOrName, terms: str) -> Column:
    """Whether any of the terms, parted by commas, semicolons or lines, is in the text."""
    parts = [t for t in (unicodedata.normalize("NFKC", x).strip().lower() for x in re.split("[,，;；\n]", terms)) if t]
    out = F.lit(False)
    for t in parts:
        out = out | F.contains(F.lower(_c(text)), F.lit(t))
    return out


def decode_path(path: ColumnOrName) -> Column:
    """Percent-decoding that leaves what can't be decoded, and plus signs, alone."""
    return F.coalesce(F.try_url_decode(F.replace(_c(path), F.lit("+"), F.lit("%2B"))), _c(path))


def canonical_map(m: ColumnOrName) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(m)))))
