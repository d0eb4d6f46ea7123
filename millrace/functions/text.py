"""Text as Column -> Column functions: normalising, counting, language, tables, redaction, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it; both Java's and RE2's syntax.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_'-]*[\p{L}\p{N}_][\p{L}\p{N}_'-]*"
LETTERS = r"[\p{L}\p{N}_]+"
TOKEN = "[a-z0-9]+"

# Stop words that tell Spanish from English.
SPANISH = ("el", "la", "los", "las", "de", "para", "que", "por", "una", "con", "del", "política", "fecha")
ENGLISH = ("the", "and", "of", "for", "with", "date", "policy", "table", "coverage")

# Personal data, replaced in this order.
PII = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b", "[REDACTED_PHONE]"),
    (r"(?i)\b(?:member|patient)[ -]?(?:id|number)[: ]+[A-Za-z0-9-]+\b", "[REDACTED_MEMBER_ID]"),
)


def normalize(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def normalized(rows: DataFrame, column: str = "text") -> DataFrame:
    """The rows with `column` (string or array<string>) as `normalize` gives it, in one pass: each text is taken apart once,
    however the result is used or filtered, while an expression is worked out again for each filter on it. Python's white
    space is the same."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names, at = rows.columns, rows.columns.index(column)

    def clean(texts):
        if pa.types.is_list(texts.type):
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(texts), 0))
            return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), clean(texts.flatten()), mask=texts.is_null())
        # Only texts with two spaces together or white space of another kind (none is printable) are taken apart.
        odd = pc.fill_null(pc.or_(pc.invert(pc.utf8_is_printable(texts)), pc.match_substring(texts, "  ")), False)
        made = pa.array([" ".join(t.split()) for t in texts.filter(odd).to_pylist()], texts.type)
        return pc.replace_with_mask(pc.utf8_trim(texts, " "), odd, made)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([clean(c) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return rows.mapInArrow(run, rows.schema)


def strip(text: Column) -> Column:
    """No white space at the ends; only a text that has some there is searched for it."""
    ends = F.left(text, F.lit(1)).rlike(WS) | F.right(text, F.lit(1)).rlike(WS)
    return F.when(ends, F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")).otherwise(text)


def has_text(text: Column) -> Column:
    """Whether there is more than white space."""
    return text.rlike(WS.replace("[", "[^", 1))


def join_lines(text: Column) -> Column:
    return F.translate(text, "\n\r", "  ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def characters(text: Column) -> Column:
    return F.length(strip(text)).cast("long")


def words_of(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the text's runs of letters are one of some lower-case words, without a list of the others."""
    edge, first = LETTERS.removesuffix("+"), "".join(sorted({w[0] for w in words}))
    return F.regexp_count(F.lower(text), F.lit(f"(?=[{first}])(?<!{edge})(?:{'|'.join(words)})(?!{edge})"))


def language(text: Column) -> Column:
    spanish = words_of(text, SPANISH)
    return (
        F.when(~has_text(text), "none")
        .when(text.rlike(r"[\x{ac00}-\x{d7af}]"), "korean")
        .when(text.rlike(r"[\x{4e00}-\x{9fff}]"), "chinese")
        .when((spanish >= 2) & (spanish > words_of(text, ENGLISH)), "spanish")
        .when(text.rlike("[A-Za-z]"), "english")
        .otherwise("other")
    )


def table_estimate(text: Column) -> Column:
    """1 if two lines have two pipes or three lines three columns parted by wide gaps, else 0; a single line is not looked at."""
    ends = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
    lines = F.split(text, ends)
    piped = F.size(F.filter(lines, lambda x: x.rlike(r"\|[^|]*\|")))
    aligned = F.size(F.filter(lines, lambda x: F.size(F.split(strip(x), WS + "{2,}")) >= 3))
    return F.when(text.rlike(ends) & has_text(text) & ((piped >= 2) | (aligned >= 3)), 1).otherwise(0).cast("long")


def redact(text: Column) -> Column:
    for pattern, mark in PII:
        text = F.regexp_replace(text, pattern, mark.replace("[", r"\[").replace("]", r"\]"))
    return text


def squeeze(message: Column, most: int = 1200) -> Column:
    return F.left(normalize(message), F.lit(most))


def label(name: Column) -> Column:
    """num_list_items -> List Items."""
    return F.initcap(F.replace(F.regexp_replace(name, "^num_", ""), F.lit("_"), F.lit(" ")))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def error_text(kind: Column, message: Column) -> Column:
    return F.concat_ws(": ", kind, message)


def slug(policy: Column) -> Column:
    """The part of a result's file name that tells its policy."""
    return F.left(F.sha2(policy, 256), F.lit(12))


def under(path: Column, root: str) -> Column:
    """Whether a path without `..` steps lies under a folder."""
    return path.startswith(root.rstrip("/") + "/") & ~F.array_contains(F.split(path, "/"), "..")


def utc_stamp() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sane_limit(value: Column, most: int = 1_000_000) -> Column:
    """A model's length limit, or null if it is no number or absurd."""
    number = F.expr("null").cast("long") if value is None else F.try_to_number(value.cast("string"), F.lit("9999999999999999999")).cast("decimal(20,0)")
    return F.when(number <= most, number.cast("long"))
