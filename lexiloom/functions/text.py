"""Text, hash and identifier functions: column in, column out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiloom import constants as K

_SPACE = r"(?U)[\s\x1c-\x1f]+"
# The characters of ``_SPACE``, one by one.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once a row, however often ``body`` names it. No Python function in ``body``."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def normalize_newlines(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "\r\n?", "\n")


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(_BLANKS))


def collapse(text: Column | str) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(_col(text), _SPACE, " "))


def is_blank(text: Column | str) -> Column:
    return F.coalesce(F.length(strip(text)), F.lit(0)) == 0


def text_sha256(text: Column | str, prefix: bool = False) -> Column:
    digest = F.sha2(_col(text), 256)
    return F.concat(F.lit("sha256:"), digest) if prefix else digest


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def json_fingerprint(*fields: Column) -> Column:
    """SHA-256 of one compact JSON object whose keys are in sorted order."""
    ordered = sorted(fields, key=lambda c: c._jc.toString() if hasattr(c, "_jc") else str(c))
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def slug(text: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-")
    short = F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 32)
    return F.when(short == "", F.lit("source")).otherwise(short)


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def block_id(source_type: Column, source_file: Column, page: Column, order: Column) -> Column:
    locator = F.concat_ws(
        "|", source_type, source_file, F.coalesce(page.cast("string"), F.lit("")), order.cast("string")
    )
    head = F.when(source_type == "pdf", F.format_string("pdf-p%04d", page.cast("long"))).otherwise(
        F.concat(F.lit("image-"), slug(file_stem(source_file)))
    )
    return F.concat(head, F.format_string("-b%04d-", order.cast("long")), short_hash(locator, 10))


def manual_block_id(source_type: Column, page: Column, source_file: Column, bbox: Column, text: Column) -> Column:
    """``manual-`` plus a hash of place and text, so that a task retry gives the same id."""
    head = F.when(
        source_type == "pdf", F.format_string("p%04d", F.coalesce(page, F.lit(0)).cast("long"))
    ).otherwise(F.lit("image"))
    key = F.concat_ws("|", source_type, source_file, F.coalesce(page.cast("string"), F.lit("")), F.to_json(bbox), text)
    return F.concat(F.lit("manual-"), head, F.lit("-"), short_hash(key, 16))


def evidence(text: Column | str, limit: int = K.EVIDENCE_CHARS) -> Column:
    cut = lambda clean: F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit - 1), F.lit("…")))
    return once(collapse(text), cut)


def issue_id(block: Column, code: Column, clean_evidence: Column) -> Column:
    return F.concat(F.lit("qa-"), short_hash(F.concat_ws("|", block, code, clean_evidence), 16))


def locator(source_type: Column, page: Column, source_file: Column) -> Column:
    """Short place name: ``p3`` or the image path below the image folder."""
    head = K.IMAGE_ROOT + "/"
    return F.when(source_type == "pdf", F.concat(F.lit("p"), page.cast("string"))).otherwise(
        F.when(
            F.startswith(source_file, F.lit(head)), F.substr(source_file, F.lit(len(head) + 1))
        ).otherwise(source_file)
    )


def locator_line(page: Column, source_file: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(F.lit("[PAGE "), page.cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("[SOURCE "), source_file, F.lit("]"))
    )


def natural_key(path: Column | str) -> Column:
    """Sortable array of parts: runs of digits compare as numbers of any length and come before text."""
    value = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
    parts = F.regexp_extract_all(F.lower(_col(path)), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(
        parts,
        lambda part: F.when(
            part.rlike("^[0-9]"),
            F.struct(F.lit(0).alias("kind"), F.concat(F.lpad(F.length(value(part)).cast("string"), 10, "0"), value(part)).alias("digits"), F.lit("").alias("text")),
        ).otherwise(F.struct(F.lit(1).alias("kind"), F.lit("").alias("digits"), part.alias("text"))),
    )


def clean_path(path: Column | str) -> Column:
    """True for a relative path without parent steps."""
    c = _col(path)
    return ~(c.rlike(r"^[/\\]|^[A-Za-z]:[/\\]|(^|[/\\])\.\.([/\\]|$)"))


# --- Unicode compatibility form -------------------------------------------------------------


def _batch_udf(kind: str):
    """Arrow-batched string function; a closure, so that workers need not import this package."""

    def apply(values: pd.Series) -> pd.Series:
        if kind == "nfkc":
            return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))
        return values.map(lambda v: None if v is None else v.casefold())

    return F.pandas_udf(apply, StringType())


_nfkc = _batch_udf("nfkc")
_casefold = _batch_udf("casefold")


def _non_ascii(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


def nfkc(text: Column | str) -> Column:
    """NFKC form; ASCII rows reach the Python worker only as nulls."""
    c = _col(text)
    return F.coalesce(_nfkc(_non_ascii(c)), c)


def casefold(text: Column | str) -> Column:
    c = _col(text)
    return F.coalesce(_casefold(_non_ascii(c)), F.lower(c))


def normalize_project_id(name: Column | str, compatibility: bool = True) -> Column:
    """Portable project id, or null when it would be empty, too long or reserved."""
    form = nfkc(name) if compatibility else _col(name)
    clean = F.regexp_replace(F.regexp_replace(F.lower(form), "[^a-z0-9]+", "_"), "^_|_$", "")
    bad = (clean == "") | (F.length(clean) > 80) | F.upper(clean).isin(*K.WINDOWS_RESERVED)
    return F.when(~bad, clean)


def fold(text: Column | str) -> Column:
    """Lower case, with one form for the letters that have two."""
    return F.replace(F.replace(F.lower(_col(text)), F.lit("ſ"), F.lit("s")), F.lit("ς"), F.lit("σ"))


# --- Terms ----------------------------------------------------------------------------------


def singularize(word: Column) -> Column:
    """Plural ending removed by the four suffix rules; input in any case, output lower."""
    return once(F.lower(word), _singular)


def _singular(low: Column) -> Column:
    size = F.length(low)
    return (
        F.when((size > 4) & F.endswith(low, F.lit("ies")), F.concat(F.substring(low, F.lit(1), size - 3), F.lit("y")))
        .when((size > 4) & low.rlike("(ches|shes|xes|zes)$"), F.substring(low, F.lit(1), size - 2))
        .when(
            (size > 3) & F.endswith(low, F.lit("s")) & ~low.rlike("(ss|us|is)$"),
            F.substring(low, F.lit(1), size - 1),
        )
        .otherwise(low)
    )


def term_words(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(text, F.lit("’"), F.lit("'")), F.lit(K.TERM_WORD), F.lit(0))


def term_key(text: Column | str, compatibility: bool = True) -> Column:
    """Lower-case words with the last one in the singular: the identity of a term."""

    def joined(words: Column) -> Column:
        size = F.size(words)
        return F.when(size == 0, F.lit("")).otherwise(
            F.concat_ws(" ", F.transform(F.slice(words, F.lit(1), size - 1), F.lower), singularize(F.element_at(words, -1)))
        )

    return once(term_words(nfkc(text) if compatibility else _col(text)), joined)


def normalized_term(text: Column | str) -> Column:
    return casefold(collapse(nfkc(text)))


def term_id(key: Column) -> Column:
    return F.concat(F.lit("term-"), short_hash(key, 12))


def manual_term_id(term: Column, compatibility: bool = True) -> Column:
    key = term_key(term, compatibility)
    whole = normalized_term(term) if compatibility else F.lower(collapse(term))
    return F.concat(F.lit("manual-"), short_hash(F.coalesce(once(key, lambda k: F.when(k != "", k)), whole), 12))


def is_title_token(token: Column) -> Column:
    """Two or more letters all upper case, or an upper first character and a lower later one."""
    letters = F.regexp_replace(token, r"[^\p{L}]", "")
    shout = letters.rlike(r"^\p{Lu}{2,}$")
    return shout | token.rlike(r"^\p{Lu}.*\p{Ll}")


def is_title_phrase(words: Column) -> Column:
    link = lambda w: F.lower(w).isin(*K.CONNECTORS)
    return F.exists(words, lambda w: ~link(w)) & F.forall(words, lambda w: is_title_token(w) | link(w))


def regex_quote(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def term_pattern(term: Column) -> Column:
    """Case-insensitive pattern with a word boundary at each alphanumeric edge of the term."""
    clean = strip(term)
    left = F.when(clean.rlike(r"^[\p{L}\p{N}]"), F.lit(r"(?<![\p{L}\p{N}_])")).otherwise(F.lit(""))
    right = F.when(clean.rlike(r"[\p{L}\p{N}]\z"), F.lit(r"(?![\p{L}\p{N}_])")).otherwise(F.lit(""))
    return F.concat(F.lit("(?iu)"), left, regex_quote(clean), right)


def contains_term(text: Column, term: Column) -> Column:
    return (F.length(strip(term)) > 0) & F.regexp_like(text, term_pattern(term))


def contains_target(text: Column, expected: Column) -> Column:
    return F.contains(F.lower(text), F.lower(strip(expected)))
