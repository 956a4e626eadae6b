"""Keywords, query normalisation, synonyms, and names of entities in queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import saved
from .likeness import alike, most_alike

PUNCTUATION = ".,!?;:()[]{}\"'-"
#: Fixed: words that say little, and words that many names share.
STOP_WORDS = (
    "the a an this these those from with for before after into onto upon over under through across along behind beyond near beside of to in on at "
    "and or but that thus then than as if when where his her its their your my our it he she they we "
    "would could should will can may might must shall is are was were be been being have has had do does did "
    "all any some few many much more most less least not no yes also just only very too so such"
).split()
ROLE_WORDS = "gunner warrior trooper leader sniper medic veteran fighter sergeant operative marine guard scout specialist mine".split()
MIN_WORD, DISTINCTIVE, TEAM_RATIO, HEADER_RATIO = 4, 6, 80, 85


def keywords_of_header(header: Column) -> Column:
    """Capitalised terms of a header: alone or with a number, in parts around ' - ', or word by word."""
    header = header.cast("string")
    words = F.filter(F.split(header, r"\s+"), lambda w: w != "")
    single = F.regexp_extract(header, r"^([A-Z][a-z]+)(?:\s+[x\d+]+)?$", 1)
    capital = lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}") & (F.length(w) >= MIN_WORD)
    parts = F.filter(F.split(header, r"\s+"), capital)
    return F.when(single != "", F.when(F.length(single) >= MIN_WORD, F.array(single)).otherwise(F.array().cast("array<string>"))).when(F.contains(header, F.lit(" - ")), parts).otherwise(F.filter(words, lambda w: capital(w) & w.rlike(r"^\p{L}+$")))


def keywords(chunks: DataFrame, header: str, text: str) -> DataFrame:
    """Distinct keywords of the chunks' headers and of '## ' lines in their texts."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.startswith(x, F.lit("## "))), lambda x: T.trim_all(F.substring(x, 4, 1_000_000)))
    heads = chunks.select(F.explode(F.concat(F.array(F.col(header)), lines)).alias("h")).where("h <> ''")
    return heads.select(F.explode(keywords_of_header(F.col("h"))).alias("keyword")).distinct()


def bare(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))


def normalised(queries: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds `normalised`: words that are keywords in another case take the keyword's, with their punctuation.

    Keywords that differ by case only count as the least of them. Without any keyword the text comes back untouched.
    """
    case = known.groupBy(F.lower("keyword").alias("low")).agg(F.min("keyword").alias("keyword"))
    words = queries.select(id_col, F.posexplode(F.split(T.squeeze(F.col(text_col)), " ")).alias("at", "word"))
    both = words.join(case, F.lower(bare(F.col("word"))) == F.col("low"), "left")
    fixed = F.when(F.col("keyword").isNotNull(), F.replace("word", bare(F.col("word")), F.col("keyword"))).otherwise(F.col("word"))
    parts = both.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("at", fixed.alias("word")))).alias("w"))
    any_known = F.broadcast(case.agg((F.count("*") > 0).alias("_any")))
    whole = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    return parts.join(queries.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), F.col(id_col) == F.col("_id")).crossJoin(any_known).select(id_col, F.when(F.col("_any"), whole).otherwise(F.col("_t")).alias("normalised"))


def expanded(queries: DataFrame, synonyms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds `expanded`: the text and the sorted official terms of the synonyms that it has as whole words.

    Synonyms of one word are found by an equi-join with the text's words; longer ones, which are few, by pattern.
    """
    low = F.lower(F.col(text_col))
    single = synonyms.where(F.col("synonym").rlike(r"^\w+$"))
    several = synonyms.where(~F.col("synonym").rlike(r"^\w+$"))
    words = queries.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), 0))).alias("synonym"))
    hit = words.join(single, "synonym").select(id_col, "term")
    quoted = F.concat(F.lit(r"(?U)\b"), F.regexp_replace("synonym", r"([\\.\[\]{}()*+?^$|-])", r"\\$1"), F.lit(r"\b"))
    long = queries.join(several, F.call_function("rlike", low, quoted)).select(id_col, "term")
    terms = hit.union(long).distinct().groupBy(id_col).agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("_terms"))
    return queries.join(terms, id_col, "left").select(id_col, F.concat(F.col(text_col), F.coalesce(F.concat(F.lit(" "), F.col("_terms")), F.lit(""))).alias("expanded"))


# -- entities -----------------------------------------------------------------------------


def entity_table(entities: DataFrame, name: str, team: str) -> DataFrame:
    """(entity, words, has_role, teams): names in lower case, their words without stop words."""
    low = F.lower(F.col(name))
    rows = entities.groupBy(low.alias("entity")).agg(F.sort_array(F.collect_set(team)).alias("teams"))
    words = F.filter(F.split(F.trim("entity"), r"\s+"), lambda w: ~w.isin(STOP_WORDS) & (w != ""))
    return rows.select("entity", "teams", words.alias("words"), F.exists(words, lambda w: w.isin(ROLE_WORDS)).alias("has_role"))


def _distinctive(w: Column) -> Column:
    return (F.length(w) >= DISTINCTIVE) & ~w.isin(ROLE_WORDS)


def names_match(query: Column) -> Column:
    """Whether an entity (columns of entity_table) is meant by a lower-case query; words may be parts of words."""
    words, n = F.col("words"), F.size("words")
    hits = F.filter(words, lambda w: (F.length(w) >= MIN_WORD) & F.contains(query, w))
    strong = F.exists(hits, _distinctive)
    phrase = (n > 0) & F.contains(query, F.array_join(words, " "))
    need = F.when((n >= 3) & ~strong, 2).otherwise(1)
    usual = (F.size(hits) >= need) & ~((n >= 3) & F.col("has_role") & ~strong)
    return (F.length("entity") >= MIN_WORD) & F.when((n <= 2) & F.col("has_role"), phrase).otherwise(usual)


def abilities_match(query: Column) -> Column:
    hits = F.filter("words", lambda w: (F.length(w) >= MIN_WORD) & F.contains(query, w))
    return (F.size("words") > 0) & (F.size(hits) >= F.when(F.size("words") == 1, 1).otherwise(2))


#: Characters by which a text is looked up that may stand inside another.
GRAM = 4


def _grams(text: Column) -> Column:
    """All stretches of up to GRAM characters of a text, once."""
    chars = F.split(text, "")
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.array(*(F.array_join(F.slice(chars, i, k), "") for k in range(1, GRAM + 1))))))


def matched_teams(queries: DataFrame, table: DataFrame, id_col: str, text_col: str, rule=names_match) -> DataFrame:
    """(id, teams) sorted. A query meets an entity by the first GRAM characters of one of its words, or of all its words in a row, that the
    query has somewhere: each rule asks for one of these at least. Only such pairs go on to the rule."""
    low = queries.select(F.col(id_col).alias("_i"), F.lower(F.col(text_col)).alias("_q"))
    phrase = F.array_join("words", " ")
    keys = F.array_union(F.transform(F.filter("words", lambda w: F.length(w) >= MIN_WORD), lambda w: F.left(w, F.lit(GRAM))), F.array(F.left(phrase, F.lit(GRAM))))
    entities = table.select("entity", F.explode(F.filter(keys, lambda k: k != "")).alias("_g"))
    pairs = low.select("_i", F.explode(_grams(F.col("_q"))).alias("_g")).join(entities, "_g").select("_i", "entity").distinct()
    found = pairs.join(low, "_i").join(table, "entity").where(rule(F.col("_q")))
    return found.select(F.col("_i").alias(id_col), F.explode("teams").alias("team")).distinct().groupBy(id_col).agg(F.sort_array(F.collect_list("team")).alias("teams"))


def fuzzy_teams(queries: DataFrame, names: DataFrame, id_col: str, text_col: str, name: str, least: float = TEAM_RATIO) -> DataFrame:
    """(id, word, team): for each word of MIN_WORD and more the best name of enough ratio, cases told apart."""
    words = queries.select(id_col, F.explode(F.array_distinct(F.split(F.lower(T.squeeze(F.col(text_col))), " "))).alias("word")).where(F.length("word") >= MIN_WORD)
    near = alike(words, names.select(F.col(name).alias("team")), "word", "team", least)
    best = near.groupBy("word").agg(F.max_by("team", F.struct("r", "team")).alias("team"))
    return words.join(best, "word").select(id_col, "word", "team")


def header_lookup(titles: DataFrame, headers: DataFrame, id_col: str, title: str, chunk_id: str, header: str, ordinal: str, least: float = HEADER_RATIO) -> DataFrame:
    """(id, chunk, score): the first chunk of the header that is most like the title, if like enough."""
    first = saved(headers.groupBy(F.lower(F.trim(header)).alias("h")).agg(F.min_by(chunk_id, ordinal).alias("chunk"), F.min(ordinal).alias("o")))
    asked = titles.select(id_col, F.lower(F.trim(title)).alias("q"))
    near = asked.where("q <> ''").join(most_alike(asked, first, "q", "h", least), "q").join(first, "h")
    return near.groupBy(id_col).agg(F.max_by("chunk", F.struct("r", -F.col("o"))).alias("chunk"), F.round(F.max("r") / 100, 6).alias("score"))


def alias_teams(queries: DataFrame, aliases: DataFrame, id_col: str, text_col: str, alias: str, team: str, least: float = TEAM_RATIO) -> DataFrame:
    """(id, team): teams whose alias a query has, or of whose alias a word of MIN_WORD and more is like a query's word."""
    low = queries.select(id_col, F.lower(F.col(text_col)).alias("_q"))
    known = aliases.select(F.col(alias).alias("_a"), F.col(team).alias("team"))
    stretches = low.select(id_col, "_q", F.explode(_grams(F.col("_q"))).alias("_g"))
    exact = stretches.join(known.withColumn("_g", F.left("_a", F.lit(GRAM))), "_g").where(F.contains("_q", "_a")).select(id_col, "team")
    words = lambda x: F.filter(F.array_distinct(F.split(F.trim(x), r"\s+")), lambda w: (F.length(w) >= MIN_WORD) & ~w.isin(STOP_WORDS))
    asked = low.select(id_col, F.explode(words("_q")).alias("word"))
    parts = known.select("team", F.explode(F.filter(F.split("_a", r"\s+"), lambda w: F.length(w) >= MIN_WORD)).alias("part"))
    like = alike(asked, parts, "word", "part", least).select("word", "part")
    return exact.union(asked.join(like, "word").join(parts, "part").select(id_col, "team")).distinct()


def all_teams(found: list[DataFrame], id_col: str) -> DataFrame:
    """(id, teams) sorted: the union of what the strategies found, each (id, team)."""
    both = reduce(DataFrame.union, [x.select(id_col, "team") for x in found])
    return both.distinct().groupBy(id_col).agg(F.sort_array(F.collect_list("team")).alias("teams"))


def structure_of(structure: DataFrame, teams: DataFrame, team: str) -> DataFrame:
    """The rows of the teams that were found; without any there is none, and not all."""
    return structure.join(teams.select(F.explode("teams").alias(team)).distinct(), team, "left_semi")
