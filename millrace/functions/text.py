"""Text and hash expressions, all inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Characters that count as white space; letters that case folding turns into others.
SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
FOLDED = {"ß": "ss", "ς": "σ"}
#: A word between white space.
SPACED = f"[^{SPACE}]+"


def stable_hash(*parts) -> Column:
    """First 8 bytes of SHA-1 over the parts joined by U+001F, as an unsigned decimal(20,0)."""
    joined = F.concat_ws("\x1f", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha1(joined.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def unit_draw(*parts, times: int = 1) -> Column:
    """A number in [0, times) that depends on the parts alone, in steps of times/10000, each the double nearest to its step."""
    return (stable_hash(*parts) % 10000).cast("double") * times / 10000


def hash_split(key: Column, validation: float = 0.03, test: float = 0.05) -> Column:
    """The split that a row's content falls to; equal contents fall to the same one."""
    u = unit_draw("split", key)
    return F.when(u < test, "test").when(u < test + validation, "val").otherwise("train")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def state_key(text: Column) -> Column:
    """A hash of the text without outer white space, case folded (lower case, and what folds to other letters)."""
    return F.sha1(folded(stripped(text)).cast("binary"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def shingles(tokens: Column, width: int = 5) -> Column:
    """Distinct runs of width words; a shorter text is one run. Project the tokens first: they are used often."""
    return F.when(F.size(tokens) < width, F.array(F.array_join(tokens, " "))).otherwise(
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.size(tokens) - (width - 1)), lambda i: F.array_join(F.slice(tokens, i, width), " "))
        )
    )


def paragraphs(text: Column) -> Column:
    """Lines that are not blank, runs of blanks and tabs squeezed, outer white space gone."""
    return F.filter(F.transform(F.split(text, "\n"), lambda p: stripped(F.regexp_replace(p, "[ \t]+", " "))), lambda p: F.length(p) > 0)


def clean_prose(text: Column) -> Column:
    """Mostly letters, few paragraphs under 4 words, at most one link, no pipe, 12 words or more a paragraph on average."""
    parts = paragraphs(text)
    joined, n = F.array_join(parts, " "), F.size(parts)
    letters = F.length(joined) - F.length(F.regexp_replace(joined, r"\p{L}", ""))
    short = F.size(F.filter(parts, lambda p: F.regexp_count(p, F.lit(SPACED)) < 4))
    return (
        (n > 0)
        & (letters.cast("double") > F.length(joined) * 0.72)
        & (short.cast("double") < n * 0.4)
        & (F.regexp_count(joined, F.lit("http")) < 2)
        & ~F.contains(joined, F.lit("|"))
        & (F.regexp_count(joined, F.lit(SPACED)).cast("double") >= n * 12.0)
    )

#: Typographic characters and the plain ones they stand for.
TYPOGRAPHY = {"-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "'": "\u2018\u2019\u201a\u2032", '"': "\u201c\u201d\u201e\u2033", " ": "\u00a0\u2007\u2009\u202f\u200b"}
ELLIPSIS = "\u2026"


def folded(text: Column) -> Column:
    """Lower case, and what case folding turns into other letters."""
    out = F.lower(text)
    for letter, other in FOLDED.items():
        out = F.replace(out, F.lit(letter), F.lit(other))
    return out


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none outside."""
    return stripped(F.regexp_replace(text, f"[{SPACE}]+", " "))


def normalised(text: Column) -> Column:
    """For quotes: plain typography, JSON punctuation as spaces, white space squeezed, case folded."""
    marks = "".join(TYPOGRAPHY.values())
    plain = "".join(k * len(v) for k, v in TYPOGRAPHY.items())
    out = F.replace(F.translate(text, marks, plain), F.lit(ELLIPSIS), F.lit("..."))
    return folded(squeezed(F.regexp_replace(out, r'[{}\[\]":,]', " ")))


def cleaned_name(text: Column, most: int = 120) -> Column:
    """White space squeezed, outer dots gone, at most that many characters."""
    return F.substring(F.btrim(squeezed(text), F.lit(".")), 1, most)


def plain_words(text: Column) -> Column:
    """Lower-case words joined by single spaces; what stands between words is gone."""
    return stripped(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")))


def without_fences(text: Column) -> Column:
    """A text without the code fence around it."""
    return F.regexp_replace(stripped(text), r"^```(?:json)?\s*|\s*```$", "")


def min_hashes(tokens: Column, n: int = 64, width: int = 5) -> Column:
    """n least hashes of the shingles, each by its own seed. Project the tokens first; for more than a few texts use least_hashes."""
    return least_hashes(F.transform(shingles(tokens, width), lambda s: F.xxhash64(s)), n)


def least_hashes(hashes: Column, n: int = 64) -> Column:
    """The least of an array's hashes by each of n seeds. Project the hashes first: they are used n times."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, p))))
