"""Written reports read back: saved answers with their embedded JSON, test reports, sweeps and keyword files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the marks around a saved answer's data, and what these have to hold.
META_START, META_END = "<!-- METADATA:START -->", "<!-- METADATA:END -->"
META_PARTS = ["test_metadata", "costs", "latency", "tokens", "deterministic_metrics"]
META_VALUES = ["tokens.prompt", "tokens.completion", "tokens.total", "latency.llm_generation_seconds", "test_metadata.actual_model_id"]
#: Fixed: an afterword is shorter than this and has no bold text; a quote's id is the end of its hash.
AFTERWORD, ID_LENGTH = 100, 8
#: Fixed: the section of results in a test report, the header of a test, and the mark of one that lacks something.
RESULTS, TEST, MISSING = r"(?U)## Per-Test Results\s*\n", r"\n### ([a-z0-9-]+)\n", "**Missing** ❌"
#: Fixed: measures of a sweep over one parameter, and over a grid of several.
SWEEP = ["mean_context_precision", "mean_context_recall", "std_dev_context_precision", "std_dev_context_recall", "total_time_seconds", "avg_retrieval_time_seconds", "total_cost_usd"]
GRID = ["mean_context_precision", "mean_context_recall", "total_time_seconds", "total_cost_usd"]
#: Between saved answers of one file.
ANSWER_END = "\n<!-- ANSWER:END -->\n"

#: Sections as they are found by their first match: `(?d)` takes only \n as the end of a line, `(?s)` lets a section have many, `(?U)` takes all white space.
QUERY = r"(?dsU)# Query\s*\n(.+?)\n---"
META = rf"(?dsU){META_START}\s*```json\s*(.+?)\s*```\s*{META_END}"
ANSWER, ANSWER_ELSE = r"(?dsU)# Response\s*\n(.+?)(?:\n\n>|\n\n##|---)", r"(?dsU)# Response\s*\n(.+?)(?:\n##|<!--|$)"
EXPLANATION = r"(?dsU)## Explanation\s*\n(.+?)(?:\n---|\\n##|<!--|$)"
#: A title and the lines behind it, each taken once (possessive), so a long quote needs no deep stack.
QUOTE = r"(?dU)> \*\*(.+?)\*\*\s*\n((?:> .+\n?)++)"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, _trim), lambda x: x != "")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def answer_text(query: Column, short: Column, quotes: Column, explanation: Column, afterword: Column, data: Column) -> Column:
    """A saved answer: quotes is a list of (quote_title, quote_text), data the JSON that is embedded, or null."""
    told = F.transform(quotes, lambda q: F.concat(F.lit("> **"), q["quote_title"], F.lit("**\n"), _quoted(q["quote_text"]), F.lit("\n\n")))
    block = F.when(data.isNotNull(), F.concat(F.lit(f"\n{META_START}\n```json\n"), data, F.lit(f"\n```\n{META_END}\n"))).otherwise("")
    head = [F.lit("# Query\n"), query, F.lit("\n\n---\n\n# Response\n"), short, F.lit("\n\n"), F.array_join(told, "")]
    return F.concat(*head, F.lit("## Explanation\n"), explanation, F.lit("\n\n"), afterword, F.lit("\n\n---\n"), block)


def write_answers(texts: DataFrame, path: str) -> None:
    """Saved answers, a column of text, many to a file."""
    texts.write.option("lineSep", ANSWER_END).text(path)


def answer_files(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(path, text) of saved answers, one a file, or as write_answers writes them."""
    reader = spark.read if whole else spark.read.option("lineSep", ANSWER_END)
    return reader.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _quotes(text: Column) -> Column:
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(QUOTE), 1).alias("title"), F.regexp_extract_all(text, F.lit(QUOTE), 2).alias("lines"))

    def told(x: Column) -> Column:
        lines = F.filter(F.split(x["lines"], "\n"), lambda y: _trim(y) != "")
        body = F.array_join(F.transform(lines, lambda y: F.regexp_replace(y, r"\A> ", "")), "\n")
        return F.struct(_trim(x["title"]).alias("quote_title"), _trim(body).alias("quote_text"), F.right(F.md5(body), F.lit(ID_LENGTH)).alias("chunk_id"))

    return F.transform(both, told)


def read_answers(rows: DataFrame, text: str, providers: dict[str, str]) -> DataFrame:
    """Adds `fault`, `query`, `answer` and `call` to saved answers.

    fault: "metadata" (no block of data), "metadata:json" (its JSON is no object), "metadata:x" (a required part or
    value x is not there), "query" (no such section), else null; with a fault the rest is null. answer is the stored
    response where the data have one, as it is; else JSON that is made of the sections: the short answer, the quotes,
    the explanation and, if its last paragraph is short and plain, the afterword. call: tokens, whole milliseconds,
    model, its provider ("unknown" if the dictionary lacks it) and whether the answer has quotes. Null text is a
    fault as empty text is. Rows stay as they are, repeats too; each is read by itself.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = rows.withColumn("_block", F.regexp_extract(t, META, 1))
    df = df.withColumn("_data", F.try_parse_json("_block"))
    at = lambda name, kind: F.try_variant_get(F.col("_data"), f"$.{name}", kind)
    lacking = [F.when(at(x, "variant").isNull(), F.lit(f"metadata:{x}")) for x in META_PARTS + META_VALUES]
    is_object = F.startswith(F.coalesce(F.schema_of_variant(F.col("_data")), F.lit("")), F.lit("OBJECT"))
    fault = F.when(F.col("_block") == "", "metadata").when(~is_object, "metadata:json").otherwise(F.coalesce(*lacking, F.when(~t.rlike(QUERY), F.lit("query"))))
    paragraphs = _filled(F.split(_trim(F.regexp_extract(t, EXPLANATION, 1)), r"\n\n+"))
    df = df.withColumns({"_fault": fault, "_parts": paragraphs, "_quotes": _quotes(t)})
    last, n = F.coalesce(F.get("_parts", F.size("_parts") - 1), F.lit("")), F.size("_parts")
    plain = (F.length(last) < AFTERWORD) & ~F.contains(last, F.lit("**"))
    explanation = F.when(n > 1, F.array_join(F.slice("_parts", 1, F.greatest(n - 1, F.lit(1))), "\n\n")).when(plain, "").otherwise(last)
    first = F.when(t.rlike(ANSWER), F.regexp_extract(t, ANSWER, 1)).otherwise(F.regexp_extract(t, ANSWER_ELSE, 1))
    short = _trim(F.split_part(_trim(first), F.lit("\n>"), F.lit(1)))
    made = F.to_json(F.struct(F.lit(False).alias("smalltalk"), short.alias("short_answer"), F.lit("").alias("persona_short_answer"), F.col("_quotes").alias("quotes"), explanation.alias("explanation"), F.when(plain, last).otherwise("").alias("persona_afterword")))
    stored = at("response_json", "string")
    kept = F.coalesce(stored, F.lit("")) != ""
    tree = F.try_parse_json(stored)
    held = F.try_variant_get(tree, "$.quotes", "variant")
    given = F.when(~F.startswith(F.coalesce(F.schema_of_variant(tree), F.lit("")), F.lit("OBJECT")), True).otherwise(F.coalesce(~F.to_json(held).isin("[]", "null", '""', "{}", "false", "0"), F.lit(False)))
    model = at("test_metadata.actual_model_id", "string")
    known = F.create_map(*(F.lit(x) for pair in providers.items() for x in pair))[model] if providers else F.lit(None).cast("string")
    call = F.struct(
        at("tokens.prompt", "long").alias("prompt_tokens"), at("tokens.completion", "long").alias("completion_tokens"), at("tokens.total", "long").alias("total_tokens"),
        (at("latency.llm_generation_seconds", "double") * 1000).cast("long").alias("latency_ms"), model.alias("model"), F.coalesce(known, F.lit("unknown")).alias("provider"),
        F.when(kept, given).otherwise(F.size("_quotes") > 0).alias("has_quotes"),
    )
    sound = lambda x: F.when(F.col("_fault").isNull(), x)
    return df.select(*rows.columns, F.col("_fault").alias("fault"), sound(_trim(F.regexp_extract(t, QUERY, 1))).alias("query"), sound(F.when(kept, stored).otherwise(made)).alias("answer"), sound(call).alias("call"))


def test_results(reports: DataFrame, run: str, text: str) -> DataFrame:
    """(run, test_id, missing) of the tests in written reports; a report without such a section has none.

    A test begins at a header that a line of its section stands before: one right behind the section's title is not met.
    """
    section = F.get(F.split(F.col(text), RESULTS, 2), F.lit(1))
    tests = F.arrays_zip(F.regexp_extract_all(section, F.lit(TEST), 1).alias("test_id"), F.slice(F.split(section, TEST), 2, 2**31 - 1).alias("body"))
    return reports.select(run, F.explode(tests).alias("t")).select(run, "t.test_id", F.contains("t.body", F.lit(MISSING)).alias("missing"))


def test_rates(results: DataFrame) -> DataFrame:
    """(test_id, runs, passed, failed, pass_rate) over all reports, the rate in percent."""
    failed = F.count_if("missing")
    return results.groupBy("test_id").agg(F.count("*").alias("runs"), (F.count("*") - failed).alias("passed"), failed.alias("failed"), ((F.count("*") - failed) / F.count("*") * 100).alias("pass_rate"))


def _sweep(params: list[str]) -> list[str]:
    return [*params, *(SWEEP if len(params) == 1 else GRID)]


def write_sweep(rows: DataFrame, params: list[str], path: str) -> None:
    """The results of a sweep over one parameter, or of a grid of several, as CSV with a header."""
    rows.select(*_sweep(params)).write.option("header", "true").csv(path)


def read_sweep(spark: SparkSession, params: list[str], path: str) -> DataFrame:
    """What write_sweep has written; a file with other columns is an error."""
    schema = ", ".join(f"`{x}` double" for x in _sweep(params))
    return spark.read.option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").schema(schema).csv(path)


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """(keyword) of a keyword file; none if there is no file. A line holds a keyword, or a JSON list of them."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "keyword string")
    return lines.select(F.explode(F.from_json("value", "array<string>")).alias("keyword")).distinct()


def add_keywords(spark: SparkSession, path: str, words: DataFrame) -> int:
    """Appends the keywords that the file lacks, sorted, and tells how many; null is no keyword, repeats count once.

    Spark writes a file of its own for each run, so what is stored is never read and overwritten at once.
    """
    new = words.select(words[words.columns[0]].alias("keyword")).dropna().distinct().join(keywords(spark, path), "keyword", "left_anti")
    before = keywords(spark, path).count()
    new.orderBy("keyword").select(F.to_json(F.array("keyword")).alias("value")).write.mode("append").text(path)
    return keywords(spark, path).count() - before


def clear_keywords(spark: SparkSession, path: str) -> None:
    """Empties a keyword file before it is built anew."""
    spark.createDataFrame([], "value string").write.mode("overwrite").text(path)
