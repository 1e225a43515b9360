"""Fill-in-the-middle: a text is cut at two of its units and its parts put in another order.

Everything is an expression over the row's own text. The delimiter MARK is made free first: the
escape character ESC and MARK itself become two characters each (both keep units as they are, for
neither is a space). regexp_replace appends MARK to each unit, the marks are counted, and
substring_index takes the parts by rank: the units before the first cut, those after the second,
and the last ones of what stands before the second. The parts lose their marks and their escapes.

Cuts, form and order come from the first four 8-digit groups of the SHA-256 of seed and key, so
reruns agree and no row depends on another. There is no shuffle; each expression takes time linear
in the text, so memory is a few copies of the longest text.

Defined cases: null text is empty; an empty text, one that contains a sentinel, and those beyond the
rate stay plain; a null key counts as the empty string; rows that repeat are cut alike; an empty table
gives an empty result; the caller's other columns are kept, and a clashing one of the same name is
replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, ESC = "\x1f", "\x1b"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: a word with the spaces before it, or the spaces at the text's end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED = 42
RATE = 50  # per cent of texts that are cut
SUFFIX_FIRST = 80  # per cent of those that put the suffix before the prefix


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC), F.lit(ESC + "0")), F.lit(MARK), F.lit(ESC + "1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + "1"), F.lit(MARK)), F.lit(ESC + "0"), F.lit(ESC))


def part(marked: Column) -> Column:
    """Text of marked units."""
    return unescape(F.replace(marked, F.lit(MARK), F.lit("")))


def ranked(text: Column, count: Column) -> Column:
    """substring_index by a rank that differs by row."""
    return F.call_function("substring_index", text, F.lit(MARK), count.cast("int"))


def draw(digest: Column, k: int) -> Column:
    """The k-th 8-digit group of a hexadecimal digest, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Adds fim_n (units), fim_form (plain, psm or spm), fim_prefix, fim_middle, fim_suffix (null if plain) and fim_output."""
    own = ["fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output"]
    kept = [c for c in df.columns if c.lower() not in own]
    whole, marked, digest, low, high = (F.col(f"__fim_{c}") for c in ("text", "marked", "digest", "low", "high"))
    n, form = F.col("fim_n"), F.col("fim_form")
    df = df.select(
        *[df[c] for c in kept], F.coalesce(df[text].cast("string"), F.lit("")).alias("__fim_text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(df[key].cast("string"), F.lit(""))).cast("binary"), 256).alias("__fim_digest"),
    )
    df = df.withColumn("__fim_marked", F.regexp_replace(escape(whole), UNIT, "$0" + MARK))
    df = df.withColumn("fim_n", (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(MARK), F.lit("")))).cast("long"))
    cut = [F.pmod(draw(digest, k), n + 1) for k in (0, 1)]
    sentinel = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    df = df.withColumns({
        "__fim_low": F.least(*cut), "__fim_high": F.greatest(*cut),
        "fim_form": F.when((whole == "") | sentinel | (draw(digest, 2) % 100 >= rate), "plain").when(draw(digest, 3) % 100 < suffix_first, "spm").otherwise("psm"),
    })
    cut_only = lambda value: F.when(form != "plain", value)
    df = df.withColumns({
        "fim_prefix": cut_only(part(ranked(marked, low))),
        "fim_middle": cut_only(part(ranked(ranked(marked, high), low - high))),
        "fim_suffix": cut_only(part(ranked(marked, high - n - 1))),
    })
    p, m, s = F.col("fim_prefix"), F.col("fim_middle"), F.col("fim_suffix")
    output = (
        F.when(form == "plain", whole)
        .when(form == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
        .otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    )
    return df.withColumn("fim_output", output).select(*kept, *own)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made of."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .otherwise(F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
    )
