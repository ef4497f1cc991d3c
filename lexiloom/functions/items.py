"""Functions over arrays of text items: protected tokens, multisets, fragments, placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions.text import _col, collapse, fold, once, strip, term_pattern


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def protected_tokens(text: Column | str) -> Column:
    c = _col(text)
    return F.struct(
        find_all(c, K.CURLY).alias("curly"),
        find_all(c, K.SQUARE).alias("square"),
        find_all(c, K.HTML_TAG).alias("html"),
        find_all(c, K.NUMBER).alias("number"),
    )


def number_words(text: Column | str) -> Column:
    """Digits of the English number words zero..twenty, one item per word found."""
    table = F.create_map(*[F.lit(x) for pair in K.NUMBER_WORDS.items() for x in pair])
    words = find_all(F.lower(_col(text)), K.WORD_RUN)
    return F.transform(F.filter(words, lambda w: w.isin(*K.NUMBER_WORDS)), lambda w: table[w])


def each_once(items: Column) -> Column:
    """Sorted ``items`` (equal ones side by side) without repeats."""
    return once(items, lambda s: F.filter(s, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(s, i - 1))))


def count_of(items: Column, value: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == value))


def multiset_equal(left: Column, right: Column) -> Column:
    return (left == right) | (F.array_sort(left) == F.array_sort(right))


def multiset_minus(left: Column, right: Column) -> Column:
    """Array of (value, n) where n = count in left − count in right is positive."""
    counted = F.transform(
        F.array_sort(F.array_distinct(left)),
        lambda v: F.struct(v.alias("value"), (count_of(left, v) - count_of(right, v)).alias("n")),
    )
    return F.filter(counted, lambda item: item["n"] > 0)


def format_multiset(items: Column) -> Column:
    parts = F.transform(
        F.array_sort(F.array_distinct(items)),
        lambda v: F.when(count_of(items, v) > 1, F.concat(v, F.lit("×"), count_of(items, v).cast("string"))).otherwise(v),
    )
    return F.when(F.size(items) == 0, F.lit(K.EMPTY_MULTISET)).otherwise(F.array_join(parts, ", "))


def numbers_changed(source: Column, target: Column, words: Column) -> Column:
    """A source number is missing, or an extra target number is neither 1 nor a number word."""
    unnamed = lambda items: once(words, lambda w: F.exists(items, lambda i: i["n"] > count_of(w, i["value"])))
    extra = once(F.filter(multiset_minus(target, source), lambda i: i["value"] != "1"), lambda items: F.when(F.size(items) == 0, False).otherwise(unnamed(items)))
    return F.when(source == target, False).otherwise((F.size(multiset_minus(source, target)) > 0) | extra)


def term_variants(term: Column, variants: Column) -> Column:
    """The term and its variants, trimmed, each once in first-seen order, blanks dropped."""
    listed = F.concat(F.array(term), F.coalesce(variants, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(listed, strip), lambda v: v != ""))


def join_fragments(texts: Column) -> Column:
    """Texts of wrapped lines joined to one; each undone hyphenation is reported."""
    blank = F.array().cast("array<string>")

    def step(state: Column, raw: Column) -> Column:
        nxt = strip(raw)
        text, notes = state["text"], state["warnings"]
        hyphen = F.endswith(text, F.lit("-")) & nxt.rlike(r"^\p{Ll}")
        left = F.regexp_extract(text, r"(\S+)\z", 1)
        right = F.regexp_extract(nxt, r"^(\S+)", 1)
        cut = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
        note = F.concat(
            F.lit(K.HYPHEN_PREFIX + ": "), left, F.lit(" + "), right, F.lit(" → "), cut(left), right
        )
        joined = (
            F.when(text == "", nxt)
            .when(hyphen, F.concat(cut(text), nxt))
            .when(text.rlike(r"[/(\[{‘“]\z"), F.concat(text, nxt))
            .otherwise(F.concat(text, F.lit(" "), nxt))
        )
        return F.when(nxt == "", state).otherwise(
            F.struct(
                joined.alias("text"),
                F.when((text != "") & hyphen, F.concat(notes, F.array(note))).otherwise(notes).alias("warnings"),
            )
        )

    start = F.struct(F.lit("").alias("text"), blank.alias("warnings"))
    return F.aggregate(
        texts, start, step, lambda s: F.struct(collapse(s["text"]).alias("text"), s["warnings"].alias("warnings"))
    )


# --- Keep terms -----------------------------------------------------------------------------


def keep_pattern(variants: Column) -> Column:
    """One alternation over the variants, longest first; null when there is none."""
    longest = F.array_sort(
        F.array_distinct(F.filter(F.transform(variants, strip), lambda v: v != "")),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    parts = F.transform(longest, lambda v: F.regexp_replace(term_pattern(v), r"^\(\?iu\)", ""))
    return once(parts, lambda p: F.when(F.size(p) > 0, F.concat(F.lit("(?iu)(?:"), F.array_join(p, "|"), F.lit(")"))))


def keep_spans(text: Column, pattern: Column) -> Column:
    """The keep-term occurrences of a text, left to right."""
    none = F.array().cast("array<string>")
    return once(pattern, lambda p: F.when(p.isNotNull(), F.regexp_extract_all(text, p, F.lit(0))).otherwise(none))


def protect_keep_terms(text: Column, pattern: Column) -> Column:
    """Each keep-term occurrence replaced by a numbered placeholder."""
    marked = lambda p: F.transform(
        F.split(text, p, -1),
        lambda piece, i: F.when(i == 0, piece).otherwise(
            F.concat(F.format_string(K.KEEP_PLACEHOLDER, i), piece)
        ),
    )
    return once(pattern, lambda p: F.when(p.isNotNull(), F.array_join(marked(p), "")).otherwise(text))


def restore_keep_terms(text: Column, spans: Column) -> Column:
    """Each placeholder replaced by its span: all in one cut of the text, unless what is put in could make new ones."""
    numbered = F.transform(spans, lambda s, i: F.struct(F.format_string(K.KEEP_PLACEHOLDER, i + 1).alias("mark"), s.alias("original")))
    in_turn = F.aggregate(numbered, text, lambda acc, item: F.replace(acc, item["mark"], item["original"]))
    nested = text.rlike(r"\{[KEP_0-9]*\{KEEP_[0-9]") | F.exists(spans, lambda s: s.rlike(r"\{(?:K|\z)"))

    def original(digits: Column) -> Column:
        number = digits.try_cast("int")
        named = (F.length(digits) == 4) | ~F.startswith(digits, F.lit("0"))
        found = F.when(named & (number >= 1), F.get(spans, number - 1))
        return F.coalesce(found, F.concat(F.lit("{KEEP_"), digits, F.lit("}")))

    pieces, marks = F.split(text, r"\{KEEP_[0-9]{4,}\}", -1), find_all(text, r"\{KEEP_([0-9]{4,})\}", 1)
    whole = F.array_join(F.zip_with(pieces, F.transform(marks, original), lambda p, o: F.concat(p, F.coalesce(o, F.lit("")))), "")
    return F.when(F.size(spans) == 0, text).when(nested, in_turn).otherwise(whole)


LATIN_WORD = r"[\p{L}\p{N}_]*[A-Za-z][\p{L}\p{N}_]*"


def single_word(variant: Column) -> Column:
    """Whether the variant is one word that begins and ends with a letter or digit: it takes whole words only."""
    return variant.rlike(r"^[\p{L}\p{N}]([\p{L}\p{N}_]*[\p{L}\p{N}])?\z")


def open_variant(variant: Column) -> Column:
    """Whether words may meet, and make new ones, where the variant is cut out: it has signs at both ends."""
    return ~(variant.rlike(r"^[\p{L}\p{N}]") | variant.rlike(r"[\p{L}\p{N}]\z"))


def latin_fully_kept(text: Column, variants: Column) -> Column:
    """True when keep variants, removed longest first, matched and leave no Latin letter.

    A variant that is one word takes whole words, in any order, so these are compared as sets. Only a text
    whose Latin words may all go, and that has a variant with signs in it, is cut variant by variant.
    """
    given = F.array_distinct(F.filter(F.transform(variants, strip), lambda v: v != ""))
    return F.coalesce(once(given, lambda g: F.when(F.size(g) == 0, False).otherwise(_fully_kept(text, g))), F.lit(False))


def _fully_kept(text: Column, given: Column) -> Column:
    joins = lambda mixed: F.exists(mixed, open_variant)
    inside = lambda mixed: F.flatten(F.transform(mixed, lambda v: find_all(fold(v), K.WORD_RUN)))
    words = find_all(fold(text), LATIN_WORD)
    # a text is not cut into words when its first one already stays
    first = F.regexp_extract(fold(text), LATIN_WORD, 0)
    may_go = lambda known: once(first, lambda w: (w == "") | F.array_contains(known, w))
    stays = lambda known: F.when(~may_go(known), True).otherwise(F.size(F.array_except(words, known)) > 0)
    longest = F.array_sort(
        given,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    start = F.struct(text.alias("rest"), F.lit(False).alias("hit"))
    done = F.aggregate(
        longest,
        start,
        lambda s, v: F.struct(
            F.regexp_replace(s["rest"], term_pattern(v), F.lit("")).alias("rest"),
            (s["hit"] | F.regexp_like(s["rest"], term_pattern(v))).alias("hit"),
        ),
    )
    cut = once(done, lambda d: d["hit"] & ~d["rest"].rlike(K.LATIN))
    every = find_all(fold(text), K.WORD_RUN)

    def judged(mixed: Column, alone: Column) -> Column:
        return (
            F.when(F.size(mixed) == 0, ~stays(alone) & F.arrays_overlap(every, alone))
            .when(~joins(mixed) & once(F.concat(alone, inside(mixed)), stays), False)
            .otherwise(cut)
        )

    return once(F.filter(given, lambda v: ~single_word(v)), lambda mixed: once(F.transform(F.filter(given, single_word), fold), lambda alone: judged(mixed, alone)))
