"""Files: markdown folders, synonym dictionaries, test cases, contexts, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT = (
    "rag_context struct<context_id: string, query_id: string, total_chunks: int, avg_relevance: double, meets_threshold: boolean, document_chunks: array<struct<chunk_id: string, document_id: string, "
    "text: string, header: string, header_level: int, relevance_score: double, position_in_doc: int, metadata: map<string, string>>>>, hop_evaluations array<struct<can_answer: boolean, reasoning: string, "
    "missing_query: string, cost_usd: double, retrieval_time_s: double, evaluation_time_s: double, filtered_teams_count: int>>, chunk_hop_map map<string, int>, embedding_cost double"
)


#: Between YAML documents of one file.
CASE_END, CASE_MARK = "\n---\n", r"(?m)^---$\n?"


def markdown(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, filename, text) of each *.md file; a missing folder is an error."""
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return df.select(path.alias("path"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(synonym, term) of a JSON object of lists; of a synonym met twice the last term counts. Malformed or missing text is an empty table."""
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], "synonym string, term string")
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    both = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string, array<string>>"))).alias("o", "e"))
    words = both.select("o", F.col("e.key").alias("term"), F.explode("e.value").alias("s"))
    return words.groupBy(F.lower("s").alias("synonym")).agg(F.max_by("term", "o").alias("term"))


def contexts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stored retrieval contexts, a JSON document a file, or a line as write_contexts writes them; a malformed one is an error."""
    return spark.read.schema(CONTEXT).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST").json(path)


def write_contexts(df: DataFrame, path: str) -> None:
    df.write.json(path)


def export(df: DataFrame, path: str, kind: str, newest: str, limit: int = 10_000, drop: bool = False) -> None:
    """The newest rows as CSV with a header, or as JSON lines, if asked without the column that orders them; the limit is the feature."""
    top = df.orderBy(F.desc(newest)).limit(limit)
    top = top.drop(newest) if drop else top
    if kind == "csv":
        top.write.option("header", "true").csv(path)
    elif kind == "json":
        top.write.json(path)
    else:
        raise ValueError("csv or json")


def test_cases(spark: SparkSession, path: str, pattern: str = "*.y*ml") -> DataFrame:
    """(test_id, query, key, text, priority, codename), a row for each ground truth, from YAML files of one case or a list of cases, or of several documents of that kind.

    Each file is parsed by itself in a task; the files are small and hand-written.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in frames:
            rows = []
            for text, name in zip(pdf["value"], pdf["codename"], strict=True):
                found = yaml.safe_load(text)
                if not isinstance(found, (dict, list)):
                    raise ValueError("a test file holds a case or a list of cases")
                for case in found if isinstance(found, list) else [found]:
                    for truth in case.get("ground_truth_contexts") or []:
                        if "key" in truth:
                            rows.append((case["test_id"], case["query"], truth["key"], truth["text"], truth.get("priority") or "critical", name))
                        else:
                            rows += [(case["test_id"], case["query"], k, v, "critical", name) for k, v in truth.items()]
            yield pd.DataFrame(rows, columns=["test_id", "query", "key", "text", "priority", "codename"])

    found = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    each = found.select(F.explode(F.split("value", CASE_MARK)).alias("value")).where(~F.col("value").rlike(r"\A\s*\z"))
    return each.select("value", codename(F.col("value")).alias("codename")).mapInPandas(run, "test_id string, query string, key string, text string, priority string, codename string")


def write_test_cases(cases: DataFrame, path: str) -> None:
    """(test_id, query, truths, codename) as YAML, a document each: JSON strings, which are YAML, behind a line with the codename."""
    text = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    truths = F.array_join(F.transform("truths", lambda x: F.concat(F.lit("  - key: "), text(x["key"]), F.lit("\n    text: "), text(x["text"]), F.lit("\n    priority: "), text(x["priority"]))), "\n")
    body = F.concat(F.lit("# TEST SET CODENAME: "), "codename", F.lit("\ntest_id: "), text(F.col("test_id")), F.lit("\nquery: "), text(F.col("query")), F.lit("\nground_truth_contexts:\n"), truths)
    cases.select(body.alias("value")).write.option("lineSep", CASE_END).text(path)


def codename(text):
    """The codename in a test file's first line, a column."""
    return F.regexp_extract(text, r"\A# TEST SET CODENAME: *(.*)", 1)


def report_sections(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(*keys, section, missing) of '## ' sections of written reports, and whether each is marked as missing."""
    parts = F.slice(F.split(text, r"(?m)^## "), 2, 1_000_000)
    return df.select(*keys, F.explode(parts).alias("s")).select(*keys, F.trim(F.split_part("s", F.lit("\n"), F.lit(1))).alias("section"), F.contains("s", F.lit("**Missing** ❌")).alias("missing"))
