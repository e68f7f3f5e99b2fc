"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def free_name(df, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Lower-case letters that case folding spells otherwise, as Unicode gives them.
FOLDS = {"ß": "ss", "ŉ": "ʼn", "ǰ": "ǰ", "ΐ": "ΐ", "ΰ": "ΰ", "և": "եւ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SAME = {"ς": "σ", "ſ": "s", "ẛ": "ṡ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε", "µ": "μ"}


def fold(text: Column) -> Column:
    """Lower case, with letters that stand for others, or for several, spelled out."""
    folded = F.translate(F.lower(text), "".join(SAME), "".join(SAME.values()))
    for letter, spelled in FOLDS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(spelled))
    return folded


def norm(text: Column) -> Column:
    """Words of letters, digits and underscores, case-folded, joined by one blank."""
    folded = fold(text)
    return F.array_join(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def weak_norm(text: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words(text: Column) -> Column:
    """Words of the normal form; none for an empty text."""
    return let(norm(text), lambda n: F.when(F.length(n) > 0, F.split(n, " ")).otherwise(F.array().cast("array<string>")))


def windows(items: Column, size: int, stride: int = 1) -> Column:
    """Runs of ``size`` items joined by blanks, every ``stride``; none if there are fewer items."""

    def runs(own: Column) -> Column:
        last = F.size(own) - F.lit(size - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, size), " "))

    return let(items, runs)


def window_hashes(items: Column, size: int) -> Column:
    """64-bit hashes of runs of ``size`` items; none if there are fewer items."""

    def runs(own: Column) -> Column:
        last = F.size(own) - F.lit(size - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(own, i, size)))

    return let(items, runs)


def shingles(text: Column, size: int = 8) -> Column:
    """Distinct word n-grams of the normal form."""
    return F.array_distinct(windows(words(text), size))


def hash_prefix(key: Column, digits: int = 8) -> Column:
    """The first hex digits of the key's SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("long")


def hash_split(key: Column, modulus: int = 20) -> Column:
    """``validation`` for one in ``modulus`` keys, else ``train``: the same key always goes the same way."""
    return F.when(hash_prefix(key) % modulus == 0, "validation").otherwise("train")


def hash_order(key: Column, salt: str = "") -> Column:
    """A reproducible shuffle: sort by it."""
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


CONTROL = r"<\|[a-z_]+\|>"


def has_control(text: Column) -> Column:
    return text.rlike(CONTROL)


def final_text(response: Column) -> Column:
    """What follows the last ``</think>``, without control tokens at the end."""
    return F.trim(F.substring_index(F.regexp_replace(response, rf"(\s*{CONTROL})+\s*$", ""), "</think>", -1))


def finished(response: Column) -> Column:
    return F.contains(response, F.lit("</think>"))


def _last(found: Column) -> Column:
    return let(found, lambda f: F.when(F.size(f) > 0, F.element_at(f, -1)))


def last_number(text: Column, mark: str = "####") -> Column:
    """The decimal after the last mark, thousands separators dropped; null if none."""
    found = F.regexp_extract_all(text, F.lit(mark + r"\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return F.replace(_last(found), F.lit(","), F.lit("")).try_cast("decimal(38,10)")


def answer_integer(text: Column) -> Column:
    return F.regexp_extract(text, r"ANSWER:\s*(-?[0-9]+)\s*$", 1).try_cast("long")


def answer_letter(text: Column) -> Column:
    return _last(F.regexp_extract_all(text, F.lit(r"ANSWER:\s*([A-Z])\b"), F.lit(1)))


def last_fence(text: Column) -> Column:
    """The body of the last fenced block."""
    return _last(F.regexp_extract_all(text, F.lit(r"(?s)```[a-z]*\n(.*?)```"), F.lit(1)))


def unwrap_json(text: Column) -> Column:
    """A JSON text without the fence around it, if it has one."""
    inner = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(F.length(inner) > 0, inner).otherwise(F.trim(text))


def canonical_json(text: Column) -> Column:
    """Keys sorted, no blanks; null for invalid JSON."""
    return F.to_json(F.try_parse_json(text))


def json_numbers(text: Column) -> Column:
    """A JSON array of numbers as doubles; null for any other text."""
    return F.from_json(text, "array<double>")


def json_where(text: Column, keep: Callable[[Column], Column]) -> Column:
    """The numbers of a JSON array that ``keep`` holds for, in their order, as JSON."""
    return F.to_json(F.filter(json_numbers(text), keep))


def json_summary(text: Column) -> Column:
    """``{"count": n, "sum": s}`` of a JSON array of numbers, as JSON."""
    return let(json_numbers(text), lambda x: F.when(x.isNotNull(), F.to_json(F.struct(F.size(x).alias("count"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("sum")))))


def word_count(text: Column) -> Column:
    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), lambda t: F.when(F.length(t) > 0, F.size(F.split(t, " "))).otherwise(0))


def scrub_paths(text: Column) -> Column:
    """Absolute paths become ``LOCAL/<last part>``."""
    return F.regexp_replace(text, r"(?:/[A-Za-z0-9_.-]+)+/([A-Za-z0-9_.-]+)", "LOCAL/$1")


def boxed(text: Column) -> Column:
    """The contents of every ``\\boxed{...}`` with balanced braces, in order."""

    def body(rest: Column) -> Column:
        """What stands before the brace that closes an open one."""
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
        step = lambda a, c: F.when(a["depth"] == 0, a).otherwise(F.struct((a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), (a["n"] + 1).alias("n")))
        end = F.aggregate(F.split(rest, ""), start, step)
        return let(end, lambda e: F.when(e["depth"] == 0, F.substr(rest, F.lit(1), e["n"] - 1)))

    parts = F.split(text, r"\\boxed\{")
    return F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), body), lambda b: b.isNotNull())


def boxed_integer(text: Column) -> Column:
    """The integer of the only box; null if there are more or it holds anything else."""
    return let(boxed(text), lambda b: F.when(F.size(b) == 1, F.regexp_extract(F.get(b, F.lit(0)), r"^\s*(-?[0-9]+)\s*$", 1).try_cast("long")))


def remap(value: Column, names: dict[str, str]) -> Column:
    """Names by a small table; others stay."""
    out = value
    for old, new in names.items():
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out


def first_match(text: Column, patterns: dict[str, str], otherwise: str) -> Column:
    """The name of the first pattern that the text matches."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()], F.lit(otherwise))


def key_values(**values: Column) -> Column:
    """``name=value`` pairs joined by semicolons."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{name}="), F.coalesce(v.cast("string"), F.lit(""))) for name, v in values.items()])


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in the text, as a whole word in any case."""
    return F.size(F.filter(words(text), lambda w: w == F.lit(word.lower())))


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` marks filled in."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def duration(seconds: Column) -> Column:
    """Hours and minutes, one minute at least."""
    minutes = F.greatest(F.lit(1), F.floor(seconds / 60)).cast("long")
    return F.format_string("%d h %02d min", F.floor(minutes / 60).cast("long"), minutes % 60)
