"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much go with them. Column functions throughout."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: What parts the entries of a menu or a trail of links.
SEPARATORS = "|>»›•·"
#: Phrases that stand in page furniture in any of the four languages.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "enable javascript", "lorem ipsum", "sign up for our newsletter", "click here", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "tous droits réservés", "politique de confidentialité", "todos los derechos reservados", "política de privacidad",
)
#: Marks that may end a sentence, quotation, list entry or heading with a body.
ENDS = ".!?…:;,\"'”’»)]。！？"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space."""
    flat = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))
    return let(F.trim(F.regexp_replace(text, f"[{SPACE}]+", " ")), flat)


def dropped(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def duplicates(lines: Column) -> Column:
    """How many of the lines with a word are equal to an earlier one."""
    return let(F.filter(lines, lambda x: dropped(x, SPACE) != ""), lambda some: F.size(some) - F.size(F.array_distinct(some)))


def repeated_words(words: Column) -> Column:
    """How many of the words lie in a window of three that the words hold twice or more.

    Windows are sorted by 40 bits of their hash, their place in the other 24; those with an equal neighbour there, few as a rule, are sorted
    by their words, so that equal ones stand together. Each place of one that has an equal neighbour covers three words, less those
    that the next such place covers too. A text of 2^24 words or more is sorted by words alone.
    """
    high, low = F.lit(-1 << 24), F.lit((1 << 24) - 1)

    def shared(s: Column, key: Callable[[Column], Column]) -> Column:
        same = lambda x, k: F.coalesce(key(F.get(s, k)) == key(x), F.lit(False))
        return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

    def hashed(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")))
        found = let(F.sort_array(keys), lambda s: shared(s, lambda x: x.bitwiseAND(high)))
        some = F.transform(found, lambda x: x.bitwiseAND(low).cast("int"))
        return F.when(F.size(w) < 1 << 24, some).otherwise(F.sequence(F.lit(0), F.size(w) - 3))

    def again(w: Column) -> Column:
        windows = F.transform(hashed(w), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")))
        return F.sort_array(F.transform(let(F.sort_array(windows), lambda s: shared(s, lambda x: x["s"])), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(again(words), covered))


def lines_of(text: Column) -> Column:
    """The lines with their white space in single blanks, none at the ends."""
    return F.transform(F.split(F.regexp_replace(text, f"[{SPACE.replace(chr(10), '')}]+", " "), "\n"), lambda x: F.trim(x))


def line_fault(line: Column, words: Column) -> Column:
    """Why a line (of lines_of) goes, null where it stays: `punctuation` for one of few words without an end mark, or of which marks are a
    large part; `navigation` for links in a row; `boilerplate` for page furniture. A line without words isn't judged."""
    def share(chars: str) -> Column:
        any_of = "[" + "".join(f"\\{c}" if c.isascii() else c for c in chars) + "]"
        return F.when(line.rlike(any_of), F.length(line) - F.length(dropped(line, chars))).otherwise(0)

    phrase = let(F.lower(line), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))
    ends = F.contains(F.lit(ENDS), F.right(line, F.lit(1)))
    return (
        F.when(line == "", None)
        .when((share(SYMBOLS + "!{}[]\\^~_=") * 8 > F.length(line)) | ((words < 6) & ~ends), "punctuation")
        .when(let(share(SEPARATORS), lambda parts: (parts >= 2) & (parts * 4 >= words)), "navigation")
        .when((words <= 40) & phrase, "boilerplate")
    )


def line_words(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.size(F.split(line, " ")))


def words_left(lines: Column) -> Column:
    """Words of the lines that no rule fails."""
    left = lambda x: let(line_words(x), lambda n: F.when(line_fault(x, n).isNull(), n).otherwise(0))
    return F.aggregate(F.transform(lines, left), F.lit(0).cast("long"), lambda total, n: total + n)


def measures(docs: DataFrame, text: str = "text", lost: int = 50) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left (words in lines that no rule fails) and kept.

    A document fails at once with fewer than 50 words, or with more than half of them in repeated windows; else it goes where its lines
    lose more than `lost` of 100 words. A null text has no words and fails. Rows are judged one by one from whole texts, nothing is
    shuffled, and repeated rows get equal values; an empty table gives an empty result. Clashing column names give way. The arrays of
    one text are in memory at a time, some ten times its size.
    """
    docs = without(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept", "_words", "_lines", "_m")
    t = F.coalesce(F.col(text), F.lit(""))

    def of(s: Column) -> Column:
        words = let(words_of(s), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again"), F.aggregate(w, F.lit(0).cast("long"), lambda total, x: total + F.length(x)).alias("chars")))
        symbols = (F.length(s) - F.length(dropped(s, SYMBOLS))).cast("long")
        return F.struct(words.alias("w"), duplicates(F.split(s, "\n")).cast("long").alias("dup"), words_left(lines_of(s)).alias("left"), symbols.alias("symbols"))

    m = docs.withColumn("_m", let(t, of))
    n, again = F.col("_m.w.n"), F.col("_m.w.again")
    failed = (n < 50) | (again * 100 > n * 50)
    left = F.col("_m.left")
    out = m.select(*docs.columns, n.alias("n_words"), F.col("_m.w.chars").alias("word_chars"), F.col("_m.symbols").alias("n_symbols"), F.col("_m.dup").alias("n_dup_lines"), again.alias("n_repeat_words"), failed.alias("base_failed"), left.alias("n_left"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_left") * 100 >= F.col("n_words") * (100 - lost)))


def cleaned(docs: DataFrame, text: str = "text", lost: int = 50) -> DataFrame:
    """The documents that are kept, their texts without the lines that fail a rule; lines without words stay."""
    kept = measures(docs.select("*"), text, lost).filter("kept").select(*docs.columns)
    stays = lambda x: let(F.trim(F.regexp_replace(x, f"[{SPACE}]+", " ")), lambda y: line_fault(y, line_words(y)).isNull())
    return kept.withColumn(text, F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))


_MENU, _MARKS = f"[{re.escape(SEPARATORS)}]", "[" + "".join(f"\\{c}" for c in SYMBOLS + "!{}[]\\^~_=") + "]"
_PHRASES = " OR ".join(f"contains(lower(b), '{p}')" for p in BOILERPLATE)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
i AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS (SELECT r, i, x, lead(x, 1) OVER (PARTITION BY r ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS z FROM i),
s AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) > 1 AS again FROM t WHERE z IS NOT NULL),
a AS (SELECT r, count(DISTINCT j)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM s WHERE again) GROUP BY r),
l AS (SELECT r, x, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')) AS b FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d)),
m AS (SELECT r, x, b, len(string_split(b, ' ')) AS words, len(regexp_extract_all(b, '{_MARKS}')) AS marks, len(regexp_extract_all(b, '{_MENU}')) AS parts, {_PHRASES} AS phrase FROM l WHERE b <> ''),
f AS (SELECT r, count(*) - count(DISTINCT x) AS dup, coalesce(sum(words) FILTER (WHERE NOT (marks * 8 > length(b) OR words < 6 AND NOT contains('{ENDS.replace("'", "''")}', right(b, 1)) OR parts >= 2 AND parts * 4 >= words OR words <= 40 AND phrase)), 0) AS n_left
  FROM m GROUP BY r),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(n_left, 0)::BIGINT AS n_left FROM w LEFT JOIN a USING (r) LEFT JOIN f USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT base_failed AND 2 * n_left >= n_words AS kept FROM q
"""
