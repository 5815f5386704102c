"""Text rules of printed exam papers and mark schemes, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, word lists and glyphs the results depend on.
TOTAL_MARK = r"(?iU)\[Total:\s*\d+\s*\]"
TOTAL_MARK_VALUE = r"(?iU)\[Total:\s*(\d+)\s*\]"
BRACKET_NUMBER = r"(?U)\[\s*(\d+)\s*\]"
BRACKET_MARK_WORD = r"(?iU)\[(\d+)\s*mark"
BRACKET_MARKS_CUE = r"(?iU)\[\s*\d+\s*marks?\s*\]"
BRACKET_1_TO_40 = r"(?U)\[\s*0*(?:[1-9]|[1-3]\d|40)\s*\]"
LINE_END_MARK = r"(?mdU)\((\d+)\)\s*$"
OPTION_WITH_DIGIT = r"(?mdU)^\s*[A-Da-d]\s{1,4}\d"
POWER_NEGATIVE = r"(?U)x\s*10\s*[–\-−]\s*(\d+)"
POWER_DIGITS = r"(?U)x\s*10\s*(\d+)"
POWER_LETTER = r"(?U)x\s*10\s*([A-Za-z])(?=\z|\s|OR\b|[.,;:])"
GLYPHS_FROM = "\uf0b4\uf0ae\uf0ee\uf0b7×"
GLYPHS_TO = "x→→•x"
SHEET_LABEL = r"(?iU)IGCSE\s+Physics"
OTHER_BREAK = r"\r\n?|[\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
FOOTER_LINE = r"(?imdU)^\s*IGCSE\s+Physics|^.*permission to reproduce"
OPTION_BLOCK = (r"(?imdU)^[^\S\n]*A[^\S\n]*$(?=[\s\S]*?\n[^\S\n]*B[^\S\n]*(?:\n|\z))"
                r"(?=[\s\S]*?\n[^\S\n]*C[^\S\n]*(?:\n|\z))")
LONE_LETTER = r"(?imdU)^[^\S\n]*([A-D])[^\S\n]*$"
ANCHOR_NUMBER = r"(?U)^\s*(\d{1,2})(?:\s*\z|\s*\([a-zA-Z]\))"
ANCHOR_INLINE = r"(?U)^\s*(\d{1,2})\s+\S"
ANCHOR_ANY = r"(?U)^\s*\d{1,2}(?:\s*\z|\s*\([a-zA-Z]\)|\s)"
COLUMN_NUMBER = r"(?U)^\s*\d{1,2}(?:\s+\S|\()"
PRINTED_ANSWER = r"(?iU)Question\s+\d+(?:_\d+)?\s*\(\s*Answer\s*:\s*([A-Da-d])\s*\)"
BULLETS = "•·▪‣"
BULLET_ONLY = "•·▪‣\\-*○"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
MARKS_CAP = 99
LONG_ANSWER_CHARS = 400
SUMMARY_CHARS = 200


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def lines_of(col: Column) -> Column:
    return F.split(col, LINE_BREAK)


def _extracted(col: Column, pattern: str, group: int = 1) -> Column:
    """First match or NULL (an absent match reads as an empty string in Spark)."""
    found = F.regexp_extract(col, pattern, group)
    return F.when(found != "", found)


# ---- marks -----------------------------------------------------------------------------


def bracket_marks(text: Column) -> Column:
    """Sum of ``[1]`` … ``[40]`` outside ``[Total: n]``, at most 99; NULL when there is none."""
    bare = F.regexp_replace(text, TOTAL_MARK, "")
    numbers = F.transform(F.regexp_extract_all(bare, F.lit(BRACKET_NUMBER), 1),
                          lambda s: s.try_cast("bigint"))
    kept = F.filter(numbers, lambda n: n.between(1, 40))
    total = F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return F.when(total > 0, F.least(total, F.lit(MARKS_CAP).cast("bigint")))


def inferred_marks(text: Column) -> Column:
    """Marks of a question text: brackets, then ``[n mark``, then a line-ending ``(n)``, then 1."""
    one = F.lit(1).cast("bigint")
    word = _extracted(text, BRACKET_MARK_WORD)
    word_n = word.try_cast("bigint")
    tail = _extracted(text, LINE_END_MARK)
    tail_n = tail.try_cast("bigint")
    return F.coalesce(
        bracket_marks(text),
        F.when(word.isNotNull(), F.when(word_n <= 40, F.greatest(word_n, one)).otherwise(one)),
        F.when(tail.isNotNull(), F.when(tail_n.between(1, 20), tail_n).otherwise(one)),
        one,
    )


def total_footer(text: Column) -> Column:
    return _extracted(text, TOTAL_MARK_VALUE).try_cast("bigint")


def without_mark_cues(text: Column) -> Column:
    """Stem text after its mark cues have been read."""
    out = F.regexp_replace(text, TOTAL_MARK, "")
    out = F.regexp_replace(out, BRACKET_MARKS_CUE, "")
    out = F.regexp_replace(out, BRACKET_1_TO_40, "")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.when(strip(text) == "", text).otherwise(strip(out))


def science_text(text: Column) -> Column:
    """Plain glyphs, and ``x 10n`` written with a caret."""
    out = F.translate(text, GLYPHS_FROM, GLYPHS_TO)
    out = F.regexp_replace(out, POWER_NEGATIVE, "x 10^-$1")
    out = F.regexp_replace(out, POWER_DIGITS, "x 10^$1")
    return F.regexp_replace(out, POWER_LETTER, "x 10^$1")


# ---- question type and answers ----------------------------------------------------------


def unix_lines(text: Column) -> Column:
    """Every line break as ``\\n``; texts without other breaks pass untouched."""
    return F.when(text.rlike(OTHER_BREAK), F.regexp_replace(text, OTHER_BREAK, "\n")).otherwise(text)


def question_type(text: Column) -> Column:
    low = F.lower(text)
    is_mc = (low.contains("multiple choice") | text.rlike(OPTION_WITH_DIGIT)
             | unix_lines(text).rlike(OPTION_BLOCK))
    return (
        F.when(is_mc, "multiple_choice")
        .when(low.contains("calculate") | low.contains("show your working"), "calculation")
        .when(F.length(text) > LONG_ANSWER_CHARS, "long_answer")
        .otherwise("short_answer")
    )


def answer_fields(text: Column) -> tuple[Column, Column]:
    """``(answer, rest)`` of an answer-key text; a lone or short mixed first line gives a letter."""
    body = strip(text)
    lines = lines_of(body)
    first = strip(F.get(lines, F.lit(0)))
    rest = strip(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n"))
    lone = _extracted(first, r"^([A-Da-d])$")
    numbered = _extracted(first, r"(?U)^\d{1,2}\s+([A-Da-d])\s*$")
    short = F.when((F.length(first) <= 4) & first.rlike(r"(?U)^[\d\sA-Da-d.]+$"),
                   _extracted(first, r"\b([A-Da-d])\b"))
    letter = F.upper(F.coalesce(lone, numbered, short))
    answer = F.coalesce(letter, F.nullif(first, F.lit("")))
    has_text = body != ""
    return F.when(has_text, answer), F.when(has_text & (rest != ""), rest)


def printed_letters(text: Column) -> Column:
    """All letters of ``Question n (Answer: X)`` in text order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PRINTED_ANSWER), 1), lambda s: F.upper(s))


def with_options(df: DataFrame, text: str, stem: str, options: str) -> DataFrame:
    """Split the option block of ``text``: ``stem`` and ``options`` as ``array<struct<letter,text>>``.

    The block opens at the first lone ``A`` line with lone ``B`` and ``C`` lines below it and ends
    at a footer line. Bodies without text are dropped; below two options nothing is split.
    """
    empty = F.expr("cast(array() as array<struct<letter:string,text:string>>)")
    parts = F.split(unix_lines(F.col(text)), OPTION_BLOCK, 2)
    block = F.get(F.split(F.get(F.col("_parts"), F.lit(1)), FOOTER_LINE, 2), F.lit(0))
    letters = F.concat(F.array(F.lit("A")), F.regexp_extract_all("_block", F.lit(LONE_LETTER), 1))
    bodies = F.split("_block", LONE_LETTER)
    zipped = F.arrays_zip(letters.alias("letter"), bodies.alias("body"))
    tidy = F.transform(zipped, lambda o: F.struct(
        F.upper(o["letter"]).alias("letter"),
        science_text(strip(F.regexp_replace(o["body"], r"(?U)\s+", " "))).alias("text")))
    found = F.filter(tidy, lambda o: o["text"] != "")
    df = df.withColumn("_parts", parts)
    df = df.withColumn("_block", F.when(F.size("_parts") > 1, block))
    df = df.withColumn("_found", F.when(F.col("_block").isNotNull(), found))
    split = F.coalesce(F.size("_found") >= 2, F.lit(False))
    return df.withColumns({
        stem: F.when(split, science_text(strip(F.get(F.col("_parts"), F.lit(0))))).otherwise(F.col(text)),
        options: F.when(split, F.col("_found")).otherwise(empty),
    }).drop("_parts", "_block", "_found")


def options_display(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(": "), o["text"])), "  ")


# ---- labels and names -------------------------------------------------------------------


def question_number(text: Column, y0: Column, inline_cap: Column) -> Column:
    """Printed main question number 1..99 at the start of a margin text, or NULL."""
    inline = F.when(y0 <= inline_cap, _extracted(text, ANCHOR_INLINE))
    return F.nullif(F.coalesce(_extracted(text, ANCHOR_NUMBER), inline).cast("int"), F.lit(0))


def looks_like_anchor(text: Column) -> Column:
    return text.rlike(ANCHOR_ANY)


def looks_like_column_number(text: Column) -> Column:
    return text.rlike(COLUMN_NUMBER)


def root_digits(number: Column) -> Column:
    return F.regexp_extract(strip(number), r"(?U)^(\d{1,2})", 1)


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w\-]", "_")


def safe_path_stem(name: Column) -> Column:
    return F.translate(name, " /", "__")


def content_summary(text: Column) -> Column:
    line = strip(F.get(F.split(strip(text), "\n"), F.lit(0)))
    return F.when(F.length(line) > SUMMARY_CHARS,
                  F.concat(F.substring(line, 1, SUMMARY_CHARS), F.lit("…"))).otherwise(line)


def bullet_lines(text: Column) -> Column:
    """Display form of a model answer: bullets joined with the text they announce."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, rf"([{BULLETS}])\s*\n(?!\s*[{BULLETS}])", "$1 ")
    lone = (rf"(?m)^[^\S\n]*[{BULLET_ONLY}][^\S\n]*\n(?:[^\S\n]*\n)*[^\S\n]*"
            rf"(?![{BULLET_ONLY}][^\S\n]*(?:\n|\z))(\S[^\n]*?)[^\S\n]*(?=\n|\z)")
    return F.regexp_replace(out, lone, "• $1")


def type_label(kind: Column) -> Column:
    return F.replace(kind, F.lit("_"), F.lit(" "))
