"""Text expressions: white space, truncation, tokens, search, templates. Positions are 0-based and count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no topic, the default topic, prompt templates.
STOP_WORDS = ("the", "a", "an", "of", "and", "to", "in", "for", "is", "are", "was", "were", "on", "at", "by", "with", "from", "as", "or", "that", "this", "it", "be")
NO_TOPIC = "subject"
PLAIN_PROMPT = "Context:\n{passage}\n\nQuestion: {query}\nAnswer:"

SPACE = r"[ \t\n\r\f]+"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def truncate_words(c: Column, n: int) -> Column:
    """Collapsed; over n characters cut to n, back to the last space, less closing marks, with a full stop."""
    s = collapse(c)
    cut = F.regexp_replace(F.regexp_replace(F.substring(s, 1, n), r" [^ ]*\z", ""), r"[ ,;:.]+\z", "")
    return F.when(F.length(s) <= n, s).otherwise(F.concat(cut, F.lit(".")))


def topic_words(c: Column) -> Column:
    """Lower-case words of four letters or more that may name a topic, in order."""
    stop = [w for w in STOP_WORDS if len(w) >= 4]
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)), lambda w: ~w.isin(stop))


def topic_keyword(c: Column) -> Column:
    """The word said most often, the first said on ties: sorted and counted within the row, without a shuffle."""
    words = F.array_sort(F.transform(topic_words(c), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    none = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("top"), F.lit(0).alias("at"), F.lit(NO_TOPIC).alias("best"))

    def step(s: Column, x: Column) -> Column:
        same = s["w"] == x["w"]
        n, i = F.when(same, s["n"] + 1).otherwise(F.lit(1)), F.when(same, s["i"]).otherwise(x["i"])
        better = (n > s["top"]) | (n == s["top"]) & (i < s["at"])
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(x["w"].alias("w"), n.alias("n"), i.alias("i"), pick(n, s["top"]).alias("top"), pick(i, s["at"]).alias("at"), pick(x["w"], s["best"]).alias("best"))

    return F.aggregate(words, none, step, lambda s: s["best"])


def find(haystack: Column, needle: Column, start: Column | int = 0) -> Column:
    """0-based position of needle at or after start; -1 if there is none."""
    at = start if isinstance(start, Column) else F.lit(start)
    rest = F.substring(haystack, at + 1, F.greatest(F.length(haystack) - at, F.lit(0)))
    hit = F.instr(rest, needle)
    return F.when(hit > 0, hit - 1 + at).otherwise(F.lit(-1))


def between(c: Column, start: Column, end: Column) -> Column:
    """Characters start to end, end not included."""
    return F.substring(c, start + 1, F.greatest(end - start, F.lit(0)))


def render(template: str, **values: Column) -> Column:
    """The template with {name} replaced by each value, in the order given."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def containment(needle: Column, haystack: Column) -> Column:
    """The share of needle's words that occur somewhere in haystack; 1 if it has none."""
    words = F.filter(F.split(needle, SPACE), lambda w: w != "")
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(F.size(F.filter(words, lambda w: F.contains(haystack, w))) / F.size(words))


def seed_of(c: Column) -> Column:
    """The first 32 bits of the text's md5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def shuffled_by(c: Column, seed: int) -> Column:
    """A key that puts rows in an arbitrary order that every run repeats."""
    return F.md5(F.concat(c, F.lit(f"|{seed}")))
