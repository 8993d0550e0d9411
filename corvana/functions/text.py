"""Column functions over text: frontmatter, sections, links, cleaning. All but `nfkc` are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = r"!\[[^\]]*\]\([^)]+\)"
MISSING = ["", "-", "None", "null", "缺", "缺考"]


def strip_frontmatter(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)^---\n.*?\n---\n*", "")


def frontmatter(s: Column) -> Column:
    """Map of the flat keys of the frontmatter; of equal keys the last holds, whatever the session says of such maps."""
    lines = F.filter(F.split(F.regexp_extract(s, r"(?s)^---\n(.*?)\n---", 1), "\n"), lambda x: x.rlike(r"^\w+:"))
    key = lambda x: F.regexp_extract(x, r"^(\w+):", 1)
    backwards = F.reverse(F.transform(lines, key))
    last = F.filter(lines, lambda x, i: F.array_position(backwards, key(x)) == F.size(lines) - i)
    entry = lambda x: F.struct(key(x), F.regexp_replace(F.trim(F.regexp_extract(x, r"^\w+:\s*(.*)", 1)), '^"+|"+$', ""))
    return F.map_from_entries(F.transform(last, entry))


def frontmatter_list(s: Column, key: str) -> Column:
    block = F.regexp_extract(s, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t].*\r?\n?)*)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t\r]*$"), 1), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))


def nfkc(s: Column) -> Column:
    """The text in compatibility form. No built-in expression knows that form, so texts go through Arrow, a batch at a time."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(s)


def compact(s: Column) -> Column:
    """The text in compatibility form without white space."""
    return F.regexp_replace(nfkc(s), r"(?U)[\s\x1c-\x1f]+", "")


def formula_form(s: Column) -> Column:
    """A formula as it is compared: compatibility form without display marks, upright fonts, spacing commands, braces and white
    space, in lower case."""
    x = F.replace(F.replace(F.replace(nfkc(s), F.lit(r"\["), F.lit("")), F.lit(r"\]"), F.lit("")), F.lit("$$"), F.lit(""))
    x = F.regexp_replace(x, r"\\(?:mathsf|mathrm)\{([^{}]*)\}", "$1")
    x = F.replace(F.replace(x, F.lit(r"\quad"), F.lit("")), F.lit(r"\,"), F.lit(""))
    return F.lower(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f{}]+", ""))


def strip_images(s: Column) -> Column:
    return F.regexp_replace(s, IMAGE, "")


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def section(s: Column, heading: str) -> Column:
    """The body of a second-level section, up to the next one; lines may end in CRLF."""
    return stripped(F.regexp_extract(s, rf"(?dms)^##\s+\Q{heading}\E\s*\r?\n(.*?)(?=^##\s+|\z)", 1))


def replace_section(s: Column, heading: str, body: Column) -> Column:
    safe = F.regexp_replace(body, r"([\\$])", r"\\$1")
    return F.regexp_replace(s, F.lit(rf"(?ms)(^##[ \t]+\Q{heading}\E[ \t]*\r?\n).*?(?=^##[ \t]|\z)"), F.concat(F.lit("$1\n"), safe, F.lit("\n\n")))


def with_frontmatter_list(s: Column, key: str, values: Column) -> Column:
    """The text with a list of its frontmatter replaced by values, items indented as the first one was, or by two blanks; at the
    frontmatter's end where it has no such key. Null where no frontmatter is opened and closed."""
    front = F.concat(F.regexp_extract(s, r"(?s)\A---\n(.*?)\n---\n", 1), F.lit("\n"))
    block = rf"(?md)^\Q{key}\E:[^\S\r\n]*(?:\[[^\r\n]*\])?\r?\n(?:^[ \t]*-[^\r\n]*(?:\r?\n|$))*"
    found, at = F.regexp_extract(front, block, 0), F.regexp_instr(front, F.lit(block))
    item = r"(?md)^([ \t]*)-[ \t]+"
    indent = F.when(found.rlike(item), F.regexp_extract(found, item, 1)).otherwise("  ")
    made = F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(values, lambda x: F.concat(indent, F.lit("- "), x, F.lit("\n"))), ""))
    replaced = F.concat(F.substring(front, F.lit(1), at - 1), made, F.substring(front, at + F.length(found), F.length(front)))
    added = F.concat(F.regexp_replace(front, r"\s+\z", ""), F.lit("\n"), made)
    new = F.regexp_replace(F.when(found != "", replaced).otherwise(added), r"\n+\z", "")
    rest = F.regexp_replace(s, r"(?s)\A---\n.*?\n---\n", "")
    return F.when(s.rlike(r"(?s)\A---\n.*?\n---\n"), F.concat(F.lit("---\n"), new, F.lit("\n---\n"), rest))


def options(s: Column) -> Column:
    """(label, text) of each line that offers an option from A to H."""
    line = r"(?m)^\s*([A-H])\s*[.．、:：)]\s*(.+?)\s*$"
    labels, texts = (F.regexp_extract_all(s, F.lit(line), k) for k in (1, 2))
    return F.transform(F.arrays_zip(labels.alias("label"), texts.alias("text")), lambda x: F.struct(x["label"].alias("label"), stripped(x["text"]).alias("text")))


def formulas(s: Column) -> Column:
    """Formulas between dollars, then those in brackets, then those in parentheses, each once."""
    found = F.concat(*(F.regexp_extract_all(s, F.lit(p), 1) for p in (r"\$([^$\n]+)\$", r"\\\[([^\]]+)\\\]", r"\\\(([^\)]+)\\\)")))
    return F.array_distinct(F.filter(F.transform(found, stripped), lambda x: x != ""))


def links(s: Column) -> Column:
    """Stems of wikilink targets, before any anchor or alias."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"\[\[([^\]|#\n]+)(?:#[^\]|\n]+)?(?:\|[^\]]+)?\]\]"), 1), lambda x: F.regexp_replace(F.regexp_extract(F.replace(F.trim(x), F.lit("\\"), F.lit("/")), r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", ""))


def number(s: Column) -> Column:
    """A double, null for blanks, markers of absence and anything else that is not a number."""
    t = F.trim(s)
    return F.when(~t.isin(MISSING), t.try_cast("double"))


def whole(s: Column) -> Column:
    return F.when(F.abs(number(s)) < float(2**63), number(s).try_cast("long"))


def answer(s: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.replace(F.upper(s), F.lit("，"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(parts), ",")


def is_correct(score: Column, most: Column, response: Column, key: Column) -> Column:
    both = (F.coalesce(F.trim(response), F.lit("")) != "") & (F.coalesce(F.trim(key), F.lit("")) != "")
    return F.when(score.isNull(), None).when(both, (answer(response) == answer(key)).cast("int")).otherwise((score >= most).cast("int"))


def rate(total: Column, most: Column) -> Column:
    return total / F.nullif(most, F.lit(0).cast("double"))


def gender(s: Column) -> Column:
    t = F.upper(F.trim(s))
    return F.when(t.isin("M", "MALE", "男", "男生"), "M").when(t.isin("F", "FEMALE", "女", "女生"), "F").otherwise("U")


def seat(s: Column) -> Column:
    t = F.regexp_replace(F.trim(s), r"^(\d+)\.0$", "$1")
    return F.when(t.rlike(r"^\d+$"), F.regexp_replace(t, r"^0+(?=\d)", "")).otherwise(t)


def item_label(s: Column) -> Column:
    """(item_no, answer) of a column label that may name its answer."""
    answer = F.trim(F.replace(F.regexp_extract(s, "（答案(.+?)）", 1), F.lit("，"), F.lit(",")))
    return F.struct(F.trim(F.regexp_replace(s, "（答案.+?）", "")).alias("item_no"), answer.alias("answer"))


def item_key(s: Column) -> Column:
    """Q and the item's number in letters, digits and underscores; a part in parentheses is a part of its own."""
    t = F.regexp_replace(F.translate(F.trim(s), "（）", "()"), r"\(([^)]+)\)", "_$1")
    t = F.regexp_replace(F.regexp_replace(F.translate(t, ".-", "__"), r"[^0-9A-Za-z_]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("Q"), F.when(t.rlike(r"^\d$"), F.lpad(t, 2, "0")).otherwise(t))


def redact(s: Column, patterns: dict[str, str]) -> tuple[Column, Column]:
    """The text without what the patterns find, and the sorted names of those that did."""
    out, names = s, []
    for name, pattern in sorted(patterns.items()):
        out = F.regexp_replace(out, pattern, "[REDACTED]")
        names.append(F.when(s.rlike(pattern), F.lit(name)))
    return out, F.array_compact(F.array(*names))


def title(s: Column, longest: int = 120, fallback: str = "video") -> Column:
    """A name that every file system takes: no reserved signs, runs of dashes or reserved device names, at most so long."""
    t = F.regexp_replace(F.regexp_replace(F.trim(s), r'[<>:"/\\|?*\x00-\x1f]+', "-"), "-{2,}", "-")
    t = F.coalesce(F.nullif(F.regexp_replace(t, r"^[ .-]+|[ .-]+$", ""), F.lit("")), F.lit(fallback))
    t = F.when(F.upper(t).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)"), F.concat(F.lit("_"), t)).otherwise(t)
    cut = F.regexp_replace(F.substring(t, 1, longest), r"[ .-]+$", "")
    return F.when(F.length(t) <= longest, t).when(cut == "", fallback).otherwise(cut)


def latex(s: Column) -> Column:
    t = F.regexp_replace(F.trim(s), r"^(\$\$?|\\\[|\\\()|(\$\$?|\\\]|\\\))$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\\(left|right)(?![A-Za-z])", ""), r"\s+", "")


def balanced(s: Column) -> Column:
    count = lambda p: F.regexp_count(s, F.lit(p))
    return (count(r"(?<!\\)\{") == count(r"(?<!\\)\}")) & (count(r"\(") == count(r"\)")) & (count(r"\[") == count(r"\]")) & (count(r"\\left(?![A-Za-z])") == count(r"\\right(?![A-Za-z])"))


def unescaped_dollars(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"(?<!\\)\$"))


def repetition(s: Column) -> Column:
    """Share of the most frequent token."""
    tokens = F.array_sort(F.regexp_extract_all(F.lower(s), F.lit(r"(\w+)"), 1))
    # The longest run of equals in the sorted list.
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    most = F.aggregate(tokens, start, step, lambda a: a["most"])
    return F.when(F.size(tokens) > 0, most / F.size(tokens)).otherwise(0.0)


def natural_key(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def clock(seconds: Column) -> Column:
    t = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d", F.floor(t / 60).cast("int"), t % 60)


def duration(s: Column) -> Column:
    """Seconds of `h:m:s`, `m:s` or a number; null if it is none."""
    return F.aggregate(F.split(F.trim(s), ":"), F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))


def image_tokens(width: Column, height: Column) -> Column:
    return F.lit(85) + F.lit(170) * F.ceil(width / 512) * F.ceil(height / 512)


def text_tokens(s: Column) -> Column:
    return F.ceil(F.octet_length(s) / 3)
