"""Text, identifier and token functions as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
CAMEL = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+"
_CAMEL = re.compile(CAMEL)
# Words of programming languages that aren't taken for identifiers.
STOP = (
    "self", "cls", "def", "class", "return", "import", "from", "as", "if", "else", "elif", "for", "while", "try", "except", "finally", "with",
    "pass", "raise", "none", "true", "false", "and", "or", "not", "in", "is", "lambda", "yield", "await", "async", "global", "nonlocal", "del", "assert",
)
MOST_IDENTIFIERS, MOST_TERMS = 200, 300
#: Rows of a batch that are Python's objects at once.
SLICE = 128


def token_count(text: Column) -> Column:
    """Estimated tokens: the mean of a quarter of the characters and 1.3 for each word, half to even; 0 for no text."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
    guess = F.bround((F.length(text) / F.lit(4.0) + words * F.lit(1.3)) / F.lit(2.0), 0)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.greatest(F.lit(1.0), guess)).cast("long")


def raw_identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def extract_identifiers(text: Column, limit: int = MOST_IDENTIFIERS) -> Column:
    """Distinct identifiers in the order of the text without keywords, cut at `limit`."""
    kept = F.filter(raw_identifiers(text), lambda x: ~F.lower(x).isin(*STOP))
    return F.slice(F.array_distinct(kept), 1, limit)


def split_identifier(ident: Column) -> Column:
    """The identifier, then its snake and camel parts in lower case, each once (by lower case)."""
    parts = F.array_distinct(F.transform(F.regexp_extract_all(ident, F.lit(CAMEL), F.lit(0)), lambda x: F.lower(x)))
    return F.when(ident == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(ident), F.filter(parts, lambda x: x != F.lower(ident))))


@F.arrow_udf(T.ArrayType(T.StringType()))
def search_terms(identifiers: pa.Array) -> pa.Array:
    """All identifiers split, each term once by lower case in the spelling that comes first, cut at MOST_TERMS.

    In Python, as finding the spelling again for each key would cost a look over all terms; search_keys() needs none. Of a
    batch SLICE rows at a time are Python's objects; the rest stays in Arrow, at a fraction of the memory.
    """

    def terms(idents) -> list[str] | None:
        found: dict[str, str] = {}
        for ident in idents if idents is not None else ():
            if ident.isalpha() and ident.islower():
                found.setdefault(ident, ident)
            else:
                for term in (ident, *(p.lower() for p in _CAMEL.findall(ident))):
                    found.setdefault(term.lower(), term)
            if len(found) >= MOST_TERMS:
                break
        return list(found.values())[:MOST_TERMS]

    kind = pa.list_(pa.string())
    return pa.concat_arrays([pa.array([], kind), *(pa.array([terms(x) for x in identifiers.slice(i, SLICE).to_pylist()], kind) for i in range(0, len(identifiers), SLICE))])


def search_keys(identifiers: Column, limit: int = MOST_TERMS) -> Column:
    """The search terms in lower case, without looking up the spelling.

    Equal identifiers are split once, and those of small letters alone, which are most, not at all.
    """

    def parts(x):
        whole = (x != "") & ~x.rlike("[A-Z0-9_]")
        return F.when(whole, F.array(x)).otherwise(F.transform(split_identifier(x), lambda y: F.lower(y)))

    return F.slice(F.array_distinct(F.flatten(F.transform(F.array_distinct(identifiers), parts))), 1, limit)


def query_keys(text: Column, limit: int = MOST_TERMS) -> Column:
    """The terms that a free text asks for, in lower case."""
    return search_keys(raw_identifiers(text), limit)


def tsquery_terms(text: Column) -> Column:
    """The OR-ed terms of a full-text query."""
    pieces = F.flatten(F.transform(query_keys(text), lambda t: F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), F.lit(0))))
    return F.array_distinct(pieces)


def is_symbol_like(text: Column) -> Column:
    return F.trim(text).rlike(rf"^{IDENTIFIER}(\.{IDENTIFIER})*$")


def candidate_tokens(text: Column) -> Column:
    """Of a query the tokens that could name a symbol: the query itself if it looks like one, dotted or snake tokens, and
    capitalised ones of over three letters; each once by lower case."""
    q = F.trim(text)
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0)), lambda t: F.regexp_replace(t, r"\.+$", "")), lambda t: (t != q) & (t.contains(".") | t.contains("_") | ((F.length(t) > 3) & t.rlike("^[A-Z]"))))
    tokens = F.concat(F.when(is_symbol_like(text), F.array(q)).otherwise(F.array().cast("array<string>")), found)
    low = F.transform(tokens, lambda x: F.lower(x))
    return F.transform(F.array_distinct(low), lambda k: F.element_at(tokens, F.array_position(low, k).cast("int")))


def preview(text: Column, most: int = 80) -> Column:
    """White space collapsed, cut after `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


# Terminal escapes, two or more blank lines, what makes a line solid, and from how many on equal lines are a run.
ANSI = "\x1b\\[[0-9;?]*[A-Za-z]|\x1b\\][^\x07]*\x07"
BLANK = r"\n[ \t]*\n[ \t]*\n(?:[ \t]*\n)*"
SOLID = r"[^ \t\r]"
RUN = 3
REPEATED = "[previous line repeated {} more times]"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def squeeze_blank(text: Column) -> Column:
    """Two or more blank lines become one."""
    return F.regexp_replace(text, BLANK, "\n\n")


def dedupe_lines(text: Column, run: int = RUN) -> Column:
    """Runs of `run` or more equal lines that aren't blank: the line once and a note of how many followed.

    The places where runs begin are marked against the line before, so that the cost follows the text's length.
    """

    before, after = REPEATED.split("{}")

    def shown(p):
        line, n = p["line"], p["next"] - p["at"]
        note = F.concat(F.lit(before), (n - 1).cast("string"), F.lit(after))
        return F.when((n >= run) & line.rlike(SOLID), F.array(line, note)).otherwise(F.array_repeat(line, n))

    def runs(lines):
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i) != F.get(lines, i - 1)))
        ends = F.concat(F.slice(starts, 2, F.size(lines)), F.array(F.size(lines)))
        pairs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), b.alias("next"), F.get(lines, a).alias("line")))
        return F.array_join(F.flatten(F.transform(pairs, shown)), "\n")

    return F.transform(F.array(F.split(text, "\n", -1)), runs)[0]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def embedding_input(repository: Column, path: Column, name: Column, kind: Column, signature: Column, docstring: Column, code: Column, most: int = 4000) -> Column:
    """What an embedding model reads of a symbol; an absent or empty signature or docstring makes no line."""
    label = lambda says, c: F.concat(F.lit(f"{says}: "), c)
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        "\n", label("Repository", repository), label("File", path), label("Symbol", name), label("Type", kind),
        label("Signature", some(signature)), label("Documentation", some(docstring)), F.concat(F.lit("Code:\n"), F.substring(code, 1, most)),
    )


def suffix_match(a: Column, b: Column) -> Column:
    """Equal but for case, or one ends in a dot and the other."""
    x, y = F.lower(a), F.lower(b)
    return (x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x))


def percent_saved(part: Column, whole: Column) -> Column:
    """100 * (1 - part / whole) to one place, 0 without a whole."""
    return F.when(whole > 0, F.round(100.0 * (1.0 - part / whole), 1)).otherwise(F.lit(0.0)).cast("double")
