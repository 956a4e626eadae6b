"""Header trees of rule documents as an adjacency table.

A tree's depth is the header levels, five at most, so parents are found by one window per level
and no recursion; subtrees are walked level by level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed: archetypes, in the order in which they are looked for.
ARCHETYPES = ["SEEK & DESTROY", "SECURITY", "INFILTRATION", "RECON"]
#: Fixed: what a category's titles have, in order; titles of operatives have a dash and none of NO_OPERATIVE.
CATEGORIES = [("Operative Selection", "OPERATIVE SELECTION"), ("Faction Rules", "FACTION RULE"), ("Strategy Ploys", "STRATEGY PLOY"), ("Firefight Ploys", "FIREFIGHT PLOY"), ("Faction Equipment", "FACTION EQUIPMENT")]
NO_OPERATIVE = ["FACTION RULE", "PLOY", "EQUIPMENT", "SELECTION", "ARCHETYPE"]
SUFFIXES = [" - Faction Rule", " - Strategy Ploy", " - Firefight Ploy", " - Faction Equipment"]
TAC_OP = " - TAC OP - "


def headers(docs: DataFrame, id_col: str, text_col: str, deepest: int = 6) -> DataFrame:
    """(id, node, level, title): header lines of levels 2 to `deepest`, numbered by line, stars dropped."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("node", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{2,6})(?= )", 1))
    df = lines.withColumn("level", level).where((F.col("level") >= 2) & (F.col("level") <= deepest))
    return df.select(id_col, "node", "level", T.trim_all(F.replace(F.regexp_replace("line", r"^#+\s*", ""), F.lit("*"), F.lit(""))).alias("title"))


def tree(nodes: DataFrame, id_col: str) -> DataFrame:
    """Adds `parent`: the nearest earlier node one level up that is still open; without one the node is a top."""
    w = Window.partitionBy(id_col).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("node")), True).over(w) for k in range(2, 6)}
    parent = F.lit(None).cast("int")
    for k in range(3, 7):
        # a node above level k - 1 that came after it has closed it
        closed = reduce(lambda a, b: a | b, [F.coalesce(last[j] > last[k - 1], F.lit(False)) for j in range(2, k - 1)], F.lit(False))
        parent = F.when(F.col("level") == k, F.when(~closed, last[k - 1])).otherwise(parent)
    return nodes.withColumn("parent", parent)


def category(title: Column) -> Column:
    """The category of a title, null for none, and empty for a FAQ, which takes what is below it out too."""
    upper = F.upper(title)
    has = lambda mark: F.contains(upper, F.lit(mark))
    operative = F.contains(title, F.lit(" - ")) & ~reduce(lambda a, b: a | b, map(has, NO_OPERATIVE))
    out = F.when(operative, "Operatives")
    for name, mark in reversed(CATEGORIES):
        fits = has(mark) | F.endswith(upper, F.lit("- ARCHETYPES")) if name == "Faction Rules" else has(mark)
        out = F.when(fits, name).otherwise(out)
    return F.when(F.startswith(upper, F.lit("FAQ")) | F.startswith(upper, F.lit("[FAQ]")), "").otherwise(out)


def cleaned(title: Column) -> Column:
    """A title without stars and without its category behind a dash."""
    bare = F.regexp_replace(title, r"\*+", "")
    out = bare
    for suffix in SUFFIXES:
        out = F.when(F.endswith(bare, F.lit(suffix)), F.substring(bare, F.lit(1), F.length(bare) - len(suffix))).otherwise(out)
    return T.trim_all(out)


def flattened(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, titles): all titles of a tree, each before those below it."""
    order = F.sort_array(F.collect_list(F.struct("node", "title")))
    return nodes.groupBy(id_col).agg(F.transform(order, lambda x: x["title"]).alias("titles"))


def inherited(nodes: DataFrame, id_col: str, depth: int = 5) -> DataFrame:
    """Adds `category`: that of its topmost ancestor that has one, else a node's own; null below a FAQ."""
    df = nodes.withColumn("own", category(F.col("title")))
    up = df.select(id_col, F.col("node").alias("n"), F.col("parent").alias("p"), F.col("own").alias("o"))
    out = df.withColumn("category", F.col("own")).withColumn("at", F.col("parent"))
    for _ in range(depth - 1):
        step = up.select(F.col(id_col).alias("_id"), "n", F.col("p").alias("_p"), F.col("o").alias("_o"))
        out = out.join(step, (F.col(id_col) == F.col("_id")) & (F.col("at") == F.col("n")), "left")
        out = out.withColumn("category", F.coalesce("_o", "category")).withColumn("at", F.col("_p")).drop("_id", "n", "_p", "_o")
    return out.withColumn("category", F.nullif("category", F.lit(""))).drop("at", "own")


def archetype(title: Column) -> Column:
    """What follows the first mark of a tactical operation in a title, in upper case, if it is one of the ARCHETYPES."""
    last = T.trim_all(F.regexp_extract(F.upper(title), rf"(?s)^.*?{TAC_OP}(.*)$", 1))
    return F.when(last.isin(ARCHETYPES), last)


def tac_op_name(title: Column) -> Column:
    """What stands before that mark, cleaned; null without an archetype."""
    return F.when(archetype(title).isNotNull(), cleaned(T.trim_all(F.substring(title, F.lit(1), F.call_function("locate", F.lit(TAC_OP), F.upper(title)) - 1))))


def without_parent(title: Column, parent: Column) -> Column:
    """A title without its parent's, in front or between dashes."""
    lead = F.concat(parent, F.lit(" - "))
    inner = F.concat(F.lit(" - "), lead)
    rest = F.substring(title, F.call_function("locate", inner, title) + F.length(inner), F.lit(1_000_000))
    return F.when(parent.isNull(), title).when(F.startswith(title, lead), F.substring(title, F.length(lead) + 1, F.lit(1_000_000))).when(F.contains(title, inner), rest).otherwise(title)


# -- names of teams in titles -----------------------------------------------------------------


def spaced(text: Column) -> Column:
    """Hyphens and underscores as blanks."""
    return F.translate(text, "-_", "  ")


def singular(text: Column) -> Column:
    """The text with its last word's plural ending taken off; white space between words becomes one blank."""
    words = T.squeeze(text)
    last = F.element_at(F.split(words, " "), -1)
    low, cut = F.lower(last), lambda n: F.substring(words, F.lit(1), F.length(words) - n)
    y = F.when(F.right(last, F.lit(3)) == F.upper(F.right(last, F.lit(3))), "Y").otherwise("y")
    es = F.when(low.rlike("(ch|sh|ss|x|z)es$"), cut(2)).otherwise(cut(1))
    n = F.length(last)
    return F.when(low.endswith("ies") & (n > 3), F.concat(cut(3), y)).when(low.endswith("es") & (n > 2), es).when(low.endswith("s") & (n > 1), cut(1)).otherwise(words)


def readable_key(name: Column) -> Column:
    """A file's name as a title: each run of letters begins with a capital, and has no other."""
    runs = F.regexp_extract_all(spaced(name), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000_000)))), "")


def without_team(title: Column, team: Column) -> Column:
    """What follows the last ' - ' of a title if what stands before it is the team's name, in any case, singular or plural, with any separators."""
    lead, rest = F.regexp_extract(title, r"(?s)^(.*) - (.*)$", 1), F.regexp_extract(title, r"(?s)^(.*) - (.*)$", 2)
    form = lambda x: F.upper(F.trim(spaced(x)))
    same = (form(lead) == form(team)) | (singular(form(lead)) == singular(form(team)))
    return F.when(F.contains(title, F.lit(" - ")) & same, rest).otherwise(title)


def with_team_summary(titles: DataFrame, summaries: DataFrame, title: str, team: str, key: str, summary: str) -> DataFrame:
    """Titles with the summary of their team whose key is the cleaned title without the team's name; of equal keys the greatest summary counts."""
    asked = titles.withColumn("_key", without_team(cleaned(F.col(title)), F.upper(readable_key(F.col(team))))).withColumn("_team", F.upper(singular(spaced(F.col(team)))))
    known = summaries.groupBy(F.upper(singular(spaced(F.col(team)))).alias("_team"), F.col(key).alias("_key")).agg(F.max(summary).alias(summary))
    return asked.join(known, ["_team", "_key"], "left").drop("_team", "_key")
