"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.arrays import word_array

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW = 8

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with for is in it on as at by this from "
    "der die das und ist nicht mit ein eine von den zu auf im "
    "le la les de des et un une que qui est dans pour en du "
    "el los las que y es por con una para del se no su"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``low <= measure <= high``; a missing bound does not apply."""

    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value, checks = F.col(self.measure), F.lit(True)
        if self.low is not None:
            checks = checks & (value >= self.low)
        if self.high is not None:
            checks = checks & (value <= self.high)
        return checks


RULES = (
    Rule("mean_word_chars", 2.0, 25.0),
    Rule("symbols_per_word", high=0.1),
    Rule("upper_share", high=0.5),
    Rule("stop_words", low=1),
    Rule("dup_line_share", high=0.5),
)


def byte_count(text: Column, characters: str) -> Column:
    """How many of the given one-byte characters a text has."""
    size, total = F.octet_length(text), F.lit(0)
    for c in characters:
        total = total + (size - F.octet_length(F.replace(text, F.lit(c))))
    return total.cast("long")


def repeated_word_count(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the window hashes of one text.

    Windows sorted by hash have their repeats side by side; the places of those are sorted again
    and the lengths that each adds to the covered part are summed.
    """
    placed = F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    )
    nothing = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("at")))
    before = F.concat(nothing, placed)
    after = F.slice(placed, F.lit(2), F.size(placed))
    beside = F.arrays_zip(placed.alias("x"), before.alias("y"), after.alias("z"))
    repeated = F.filter(
        beside,
        lambda r: r["x"]["h"].isNotNull()
        & (F.coalesce(r["x"]["h"] == r["y"]["h"], F.lit(False))
           | F.coalesce(r["x"]["h"] == r["z"]["h"], F.lit(False))),
    )
    starts = F.sort_array(F.transform(repeated, lambda r: r["x"]["at"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        starts,
        start,
        lambda a, at: F.struct(
            (at + WINDOW).alias("end"),
            (a["n"] + at + WINDOW - F.greatest(a["end"], at)).alias("n"),
        ),
        lambda a: a["n"],
    ).cast("long")


def quality_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of every text; columns of ``docs`` with the same names are replaced.

    Counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, stop_words (different ones)
    and the ratios mean_word_chars, symbols_per_word, upper_share, dup_line_share. A null or empty
    text has zeros. Windows are compared by 64-bit hashes of their words.
    """
    q = "_q_"  # helper columns; columns of docs that begin alike stay
    while any(c.lower().startswith(q) for c in docs.columns):
        q = "_" + q
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumn(q + "text", whole).withColumn(q + "words", word_array(F.col(q + "text")))
    body, words = F.col(q + "text"), F.col(q + "words")
    spaces = byte_count(body, SPACES)
    solid_lines = F.filter(
        F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0
    )
    base = base.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(body).cast("long") - spaces,
            "n_symbols": byte_count(body, SYMBOLS),
            q + "upper": F.regexp_count(body, F.lit("[A-Z]")),
            q + "lines": solid_lines,
            q + "stops": F.size(
                F.array_intersect(words, F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))]))
            ),
            q + "h": F.transform(words, lambda w: F.xxhash64(w)),
        }
    )
    for name, source, step in ((q + "h2", q + "h", 1), (q + "h4", q + "h2", 2), (q + "h8", q + "h4", 4)):
        shifted = F.slice(F.col(source), F.lit(step + 1), F.size(source))
        base = base.withColumn(
            name, F.zip_with(source, shifted, lambda a, b: F.xxhash64(a, b))
        )
    base = base.withColumn(
        q + "windows",
        F.slice(q + "h8", F.lit(1), F.greatest(F.size(q + "h8") - (WINDOW - 1), F.lit(0))),
    )
    windows, lines = F.col(q + "windows"), F.col(q + "lines")
    repeats = F.size(windows) > F.size(F.array_distinct(windows))
    measured = base.withColumns(
        {
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.when(repeats, repeated_word_count(windows)).otherwise(
                F.lit(0).cast("long")
            ),
            "stop_words": F.col(q + "stops").cast("long"),
            "mean_word_chars": F.coalesce(F.try_divide("word_chars", "n_words"), F.lit(0.0)),
            "symbols_per_word": F.coalesce(F.try_divide("n_symbols", "n_words"), F.lit(0.0)),
            "upper_share": F.coalesce(
                F.try_divide(F.col(q + "upper"), F.col("word_chars")), F.lit(0.0)
            ),
            "dup_line_share": F.coalesce(
                F.try_divide(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
                F.lit(0.0),
            ),
        }
    )
    return measured.drop(*[c for c in measured.columns if c.startswith(q)])


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the measures, base_failed (under 20 words, or over 30 % of the words in repeated 8-word
    windows) and kept (not base_failed, and every rule holds)."""
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.holds()
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (
        quality_measures(docs, text)
        .withColumn("base_failed", (n < 20) | (100 * repeated > 30 * n))
        .withColumn("kept", ~F.col("base_failed") & verdict)
    )


def kept_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that fail no rule, with their own columns.

    The verdict goes through a generator: a filter would be pushed below the projections and spell out
    every measure, down to the words, once for each place that uses it. A row without a verdict (none
    can be null here) would go.
    """
    mark = F.explode(F.when(F.col("_kept"), F.array(F.lit(True)))).alias("_mark")
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    measured = quality_rules(docs.select(row, F.col(text).alias("text")), "text", rules)
    return measured.select("_row", F.col("kept").alias("_kept")).select("_row", mark).select(*own)
