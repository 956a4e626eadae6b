"""Cleaning of markdown rule texts in ten ordered steps, with counts of what each changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed: what the steps look for.
BULLETS = "•○◦▪▸►‣⁃↘"
WEAPON_RULES = [
    r"Accurate \d+", r"Balanced", r'Blast \d+["″]', r"Brutal", r"Ceaseless", r'(?:\d+["″]\s+)?Dev(?:a|e)stating \d+', r"Heavy(?: \([^\)]+\))?", r"Hot", r"Lethal \d+\+",
    r"Limited \d+", r"Piercing \d+", r"Piercing Crits \d+", r"Punishing", r'Range \d+["″]', r"Relentless", r"Rending", r"Saturate", r"Seek(?: Light)?", r"Severe", r"Shock", r"Silent", r"Stun", r'Torrent \d+["″]',
]
WEAPON_RULE = f"(?i)^(?:{'|'.join(WEAPON_RULES)})$"


def _is_table(line: Column) -> Column:
    s = T.trim_all(line)
    return s.rlike(r"^\|.*\|") & (F.length(s) > 1)


def bullet(line: Column) -> Column:
    s = T.trim_all(line)
    lead = F.length(F.regexp_extract(line, r"^\s*", 0))
    is_bullet = ~s.rlike(r"^(-{3,}|\*\*\*)$") & ~F.startswith(s, F.lit("|")) & line.rlike(rf"^\s*([{BULLETS}]\s*|[*-]\s+\S)")
    body = F.regexp_extract(line, rf"^\s*(?:[{BULLETS}]\s*|[*-]\s+)(.*)$", 1)
    depth = F.when(lead <= 1, 0).otherwise(F.floor((lead + 2) / 4)).cast("int")
    return F.when(is_bullet, F.concat(F.repeat(F.lit("    "), depth), F.lit("- "), body)).otherwise(line)


def table_row(line: Column) -> Column:
    s = T.trim_all(line)
    pipes = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), (pipes - 1).cast("int")))
    rule = F.when(F.endswith(s, F.lit("|")), rule).otherwise(F.regexp_replace(rule, r"\|+$", ""))
    inner = F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"\|$", "")
    cells = F.transform(F.split(inner, r"\|"), T.trim_all)
    row = F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.when(c == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), c, F.lit(" ")))), "|"), F.lit("|"))
    return F.when(_is_table(line), F.when(s.rlike(r"^\|[\s\-:|]+\|?\s*$"), rule).otherwise(row)).otherwise(line)


def bold_weapon_rules(line: Column) -> Column:
    """The rules in the last cell of a row of six cells and more, in bold."""
    s = T.trim_all(line)
    parts = F.split(s, r"\|")
    n = F.size(parts)
    last = T.trim_all(F.get(parts, n - 2))
    words = F.transform(F.split(last, ","), T.trim_all)
    is_rule = lambda w: T.squeeze(w).rlike(WEAPON_RULE) & ~(F.startswith(w, F.lit("**")) & F.endswith(w, F.lit("**")))
    new = F.array_join(F.transform(words, lambda w: F.when(is_rule(w), F.concat(F.lit("**"), w, F.lit("**"))).otherwise(w)), ", ")
    row = F.array_join(F.concat(F.slice(parts, F.lit(1), n - 2), F.array(F.concat(F.lit(" "), new, F.lit(" "))), F.slice(parts, n, F.lit(1))), "|")
    fits = _is_table(line) & ~s.rlike(r"^\|[\s\-:|]+\|?$") & (n >= 7) & ~last.isin("", "-") & F.exists(words, is_rule)
    return F.when(fits, row).otherwise(line)


def _each(step):
    return lambda text: F.array_join(F.transform(F.split(text, "\n"), step), "\n")


def _replace(*pairs: tuple[str, str]):
    return lambda text: reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), pairs, text)


#: name, what the step does to a whole text, what it counts (a pattern, or None: changed lines)
STEPS = [
    ("apostrophes", lambda t: F.replace(t, F.lit("’"), F.lit("'")), "’"),
    ("bullets", _each(bullet), None),
    ("table_lines", _each(table_row), None),
    ("weapon_types", _replace((r"\| Ranged \|", "| ranged |"), (r"\| Melee \|", "| melee |")), r"\| (Ranged|Melee) \|"),
    ("weapon_rules", _each(bold_weapon_rules), None),
    ("empty_cells", _replace((r"\| - \|", "| |"), (r"\| — \|", "| |")), r"\| [-—] \|"),
    ("ocr", _replace((r"\bOCP\b", "0CP")), r"\bOCP\b"),
    ("unbolded", _replace((r"\*\*within\*\*", "within"), (r"\*\*within control range\*\*", "within **control range**")), r"\*\*within( control range)?\*\*"),
    ("distances", _replace((r'(?<!\*)\bwithin (\d+["″])(?!\*)', r"within **$1**")), r'(?<!\*)\bwithin (\d+["″])(?!\*)'),
    ("trailing", _each(lambda x: F.regexp_replace(x, r"\s+$", "")), None),
]


def cleaned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, and a count for each step)."""
    df = docs.select(id_col, F.col(text_col).alias("_0"))
    for k, (name, step, pattern) in enumerate(STEPS):
        old, new = F.col(f"_{k}"), F.col(f"_{k + 1}")
        df = df.withColumn(f"_{k + 1}", step(old))
        changed = F.regexp_count(old, F.lit(pattern)) if pattern else F.size(F.filter(F.zip_with(F.split(old, "\n"), F.split(new, "\n"), lambda a, b: a != b), lambda x: x))
        df = df.withColumn(name, changed.cast("long"))
    return df.select(id_col, F.col(f"_{len(STEPS)}").alias("text"), *(name for name, _, _ in STEPS))


def counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return cleaned(docs, id_col, text_col).drop("text")
