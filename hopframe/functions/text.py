"""Text expressions: stripping, answer extraction, token and n-gram columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the surrounding-whitespace rule removes; by itself ``trim``
# would only remove spaces.
_LINE_BLANKS = "".join(map(chr, (
    0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))

# Words and single symbols, the default token of the length limits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

# How an answer is announced in targets and in responses.
TARGET_ANSWER = r"answer is\s*([^\.]+)\."
# A line is tried from its start only, so a text without an answer costs its length and not its square.
RESPONSE_ANSWER = r"(?dm)^.*answer is (.*)\."
ANNOUNCEMENT = "answer is"  # part of all of them
COLON_ANSWER = r"(?dm)answer is:?[^\S\n]*(.+?)\.?[^\S\n]*$"
SELF_ASK_MARKERS = ("intermediate answer", "follow up")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(_col(c), F.lit(_LINE_BLANKS + "\n"))


def strip_lines(c: Column | str) -> Column:
    """Strip every line, keeping the line structure; only the ends of lines are looked at."""
    lines = F.transform(F.split(_col(c), "\n"), lambda line: F.btrim(line, F.lit(_LINE_BLANKS)))
    return F.array_join(lines, "\n")


def join_lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def token_count(c: Column | str) -> Column:
    """Default token counter; pass another one wherever a counter is accepted."""
    return F.regexp_count(_col(c), F.lit(TOKEN_PATTERN)).cast("int")


def extract_answer(c: Column | str, mode: str = "response", fallback: str = "none") -> Column:
    """Answer announced in a text.

    ``target``    up to the first dot, else the whole text
    ``strict``    like target but lower-cased, null where nothing is announced
    ``response``  up to the last dot of the first announcing line, else ''
    ``colon``     'answer is: X' with or without a final dot, else ''
    ``fallback='text'`` returns the stripped text instead of ''.
    """
    text = _col(c)
    announced = lambda pattern: F.get(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(0))
    if mode == "target":
        return F.coalesce(strip(announced(TARGET_ANSWER)), text)
    if mode == "strict":
        return F.lower(strip(announced(TARGET_ANSWER)))
    patterns = {"response": RESPONSE_ANSWER, "colon": COLON_ANSWER}
    if mode not in patterns:
        raise ValueError(f"unknown extraction mode {mode!r}")
    if fallback == "text":
        return F.coalesce(announced(patterns[mode]), strip(text))
    # a text that announces nothing is told by a search for bytes
    return F.when(~F.contains(text, F.lit(ANNOUNCEMENT)), F.lit("")).otherwise(F.regexp_extract(text, patterns[mode], 1))


def is_self_ask(c: Column | str) -> Column:
    low = F.lower(_col(c))
    first, second = SELF_ASK_MARKERS
    return low.contains(first) | low.contains(second)


def is_correct(generated: Column | str, truth: Column | str) -> Column:
    """Recall-style match: the true answer, without blanks at its ends, occurs in the generated one."""
    return F.contains(F.lower(_col(generated)), F.lower(strip(truth)))


def yes_no(c: Column | str) -> Column:
    """true/false in any case become Yes/No, everything else stays."""
    value = _col(c)
    return (
        F.when(F.lower(value) == "true", F.lit("Yes"))
        .when(F.lower(value) == "false", F.lit("No"))
        .otherwise(value)
    )


def seeded_key(seed: int, *parts: Column | str) -> Column:
    """Reproducible stand-in for a random draw: the same on every engine and
    for every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))


def rouge_words(c: Column | str) -> Column:
    """Lower-case ASCII words, separated by single spaces, used by the n-gram scores."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed.

    Inside a lambda an outer expression would be computed again per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def adjacent(items: Column, separator: str = " ") -> Column:
    """Adjacent pairs of an array; shorter inputs give an empty array."""

    def pairs(a: Column) -> Column:
        n = F.greatest(F.size(a) - 1, F.lit(0))
        return F.zip_with(
            F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n),
            lambda x, y: F.concat(x, F.lit(separator), y),
        )

    return let(items, pairs)


def numbered(items: Column) -> Column:
    """Repeated elements told apart by a running number ('the 0', 'the 1', ...).

    A multiset then is a plain set, and shared elements are counted with repeats.
    Equal elements are neighbours once sorted, so each run is numbered from its
    start to the next one's: linear in the array after the sort.
    """

    def runs(a: Column) -> Column:
        begins = lambda g, i: F.when((i == 0) | ~g.eqNullSafe(F.get(a, i - 1)), i)
        starts = F.filter(F.transform(a, begins), lambda i: i.isNotNull())
        return let(starts, lambda at: F.flatten(F.transform(at, lambda i, j: F.transform(
            F.sequence(F.lit(0), F.coalesce(F.get(at, j + 1), F.size(a)) - i - 1),
            lambda k: F.concat_ws("\x01", F.get(a, i), k.cast("string")),
        ))))

    return let(F.array_sort(items), runs)


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def f_measure(precision: Column, recall: Column) -> Column:
    return safe_div(2 * precision * recall, precision + recall)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation that is null, not an error, for a constant column."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
