"""Row-local text functions as Columns; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the token estimate, and what counts as a wide character in it.
WIDE_WEIGHT, OTHER_WEIGHT = 1.2, 0.6
WIDE = "[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\u3000-\\u303f\\uff00-\\uffef]"
# Shapes of personal data, in the order in which they are masked.
PII = {
    "id_card": r"(?<!\d)(\d{6})\d{11}([\dXx])(?!\d)",
    "bank_card": r"(?<!\d)(\d{15,19})(?!\d)",
    "phone": r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)",
    "email": r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
}


def tokens(text: Column) -> Column:
    """Search terms: Latin words in lower case, and overlapping pairs of Han characters (single ones alone).

    Null text has no terms (empty array).
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9äöüßé]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit("[一-鿿]+"), F.lit(0))
    pair = F.lit("[一-鿿]{2}")

    def pairs(r: Column) -> Column:
        both = F.concat(F.regexp_extract_all(r, pair, F.lit(0)), F.regexp_extract_all(F.substr(r, F.lit(2)), pair, F.lit(0)))
        return F.when(F.length(r) == 1, F.array(r)).otherwise(both)

    return F.coalesce(F.concat(words, F.flatten(F.transform(runs, pairs))), F.array().cast("array<string>"))


def deterministic_id(prefix: str, *parts: Column) -> Column:
    """32 characters: the prefix and 30 hexadecimal digits of the SHA-1 of the parts joined by ``|``."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 30))


def estimated_tokens(text: Column) -> Column:
    """Upper estimate of a text's tokens from its wide and other characters; 0 for null."""
    n = F.coalesce(F.length(text), F.lit(0))
    other = F.coalesce(F.length(F.regexp_replace(text, WIDE, "")), F.lit(0))
    # weights in tenths keep the sum exact
    return F.ceil((F.lit(int(WIDE_WEIGHT * 10)) * (n - other) + F.lit(int(OTHER_WEIGHT * 10)) * other) / F.lit(10)).cast("bigint")


def input_budget(context: int, output: int, safety: float) -> int:
    """Tokens left for the input: at least 1. Raises ValueError for a safety margin outside [0, 1)."""
    if not 0 <= safety < 1:
        raise ValueError("safety must be in [0, 1)")
    return max(1, int((context - output) * (1 - safety)))


def cut(text: Column, most: int, mark: str = "…") -> Column:
    """The first ``most`` characters, with a mark if something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def cut_at_sentence(text: Column, most: int, mark: str) -> Column:
    """The text within ``most`` characters, the mark included: longer texts end with their last whole sentence,
    or anywhere if none ends before. Null stays null."""
    head = F.substring(text, 1, most - len(mark))
    whole = F.regexp_extract(head, r"(?s)^.*[。！？!?；;\n]", 0)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(whole != "", whole).otherwise(head), F.lit(mark)))


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_form(text: Column) -> Column:
    """Without full-width punctuation and white space."""
    return F.regexp_replace(text, r"[\s，。！？；：、（）《》【】“”‘’]+", "")


def pii_masked(text: Column) -> Column:
    """Identity numbers, cards, mobile numbers and e-mail addresses masked, ends kept; null stays null."""
    numbers = F.regexp_replace(text, PII["id_card"], "$1***********$2")
    for n in range(19, 14, -1):  # cards keep their length
        numbers = F.regexp_replace(numbers, rf"(?<![\d*])\d{{{n - 4}}}(\d{{4}})(?!\d)", "*" * (n - 4) + "$1")
    out = F.when(text.rlike("[0-9]{11}"), F.regexp_replace(numbers, PII["phone"], "$1****$2")).otherwise(text)  # most texts have no such number
    return F.when(text.contains("@"), F.regexp_replace(out, PII["email"], "$1***$2")).otherwise(out)


def pii_kinds(text: Column) -> Column:
    """Sorted names of the kinds of personal data in a text; empty for null."""
    hits = F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in PII.items()))
    return F.sort_array(F.filter(hits, lambda x: x.isNotNull()))


def heading(line: Column) -> Column:
    """struct(level int, title string) of a heading line, null for any other line.

    Marked headings (1 to 6 signs) first; else chapters and ordinals are level 1 and dotted numbers as deep as
    their dots, at most 4, unless the line is over 80 characters or ends like a sentence.
    """
    s = F.trim(line)
    signs = F.regexp_extract(s, r"^(#{1,6})\s+(.+?)\s*#*$", 1)
    title = F.trim(F.regexp_extract(s, r"^(#{1,6})\s+(.+?)\s*#*$", 2))
    sentence = s.rlike("[。！？；，]$")
    chapter = s.rlike(r"^第\s*[一二三四五六七八九十百零〇\d]+\s*[章篇部]") | s.rlike(r"^[一二三四五六七八九十]+\s*、")
    number = F.regexp_extract(s, r"^(\d+(?:\.\d+)+)[\s、.]", 1)
    dots = F.length(number) - F.length(F.regexp_replace(number, r"\.", ""))

    def of(level: Column, text: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), text.alias("title"))

    return (
        F.when(s.isNull() | (F.length(s) == 0) | (F.length(s) > 80), None)
        .when((signs != "") & (title != ""), of(F.length(signs), title))
        .when(sentence, None)
        .when(chapter, of(F.lit(1), s))
        .when(number != "", of(F.least(dots + 1, F.lit(4)), s))
    )


def cell_text(cell: Column, kind: Column) -> Column:
    """Text of a worksheet cell given as string with its kind (bool, number, date, datetime, string).

    Whole numbers lose their decimals, midnight loses its time, inner white space is collapsed, null is empty.
    """
    number = cell.try_cast("double")
    whole = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"))
    stamp = cell.try_cast("timestamp_ntz")
    time = F.when(F.date_format(stamp, "HH:mm:ss") == "00:00:00", F.date_format(stamp, "yyyy-MM-dd")).otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
    text = F.when(kind == "bool", F.when(F.lower(cell).isin("true", "1"), "TRUE").otherwise("FALSE"))
    text = text.when((kind == "number") & number.isNotNull(), whole).when(kind.isin("date", "datetime") & stamp.isNotNull(), time)
    return F.coalesce(text.otherwise(squeeze(cell)), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 if either is zero, null or of another length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    ok = (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))
