"""Reports that are read back: odd files, long texts, missing parts."""

from __future__ import annotations

import json
import re

import pytest

from siftstone.operators import summaries
from siftstone.sources import reports

DATA = {
    "test_metadata": {"actual_model_id": "m"}, "costs": {}, "latency": {"llm_generation_seconds": 1.5}, "tokens": {"prompt": 1, "completion": 2, "total": 3}, "deterministic_metrics": {},
}


def block(data) -> str:
    return f"{reports.META_START}\n```json\n{data if isinstance(data, str) else json.dumps(data)}\n```\n{reports.META_END}\n"


def read(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r for r in reports.read_answers(df, "text", {"m": "p"}).orderBy("i").collect()]


HEAD = "# Query\nq\n\n---\n\n# Response\n"


def test_answers_of_odd_texts(spark):
    whole = HEAD + "a\n\n> **T**\n> x\n>  y \n> **U**\n\n> **V**\n\n> z\n\n## Explanation\none\n\n\ntwo\n\nbye\n\n---\n" + block(DATA)
    got = read(spark, None, "", HEAD, HEAD + block("[1]"), HEAD + block("{"), block(DATA), HEAD + block(DATA | {"tokens": {"prompt": 1}}), whole, HEAD + "only **bold**\n" + block(DATA))
    assert [r.fault for r in got] == ["metadata"] * 3 + ["metadata:json"] * 2 + ["query", "metadata:tokens.completion", None, None]
    assert all(r.query is None and r.answer is None and r.call is None for r in got[:7])
    answer = json.loads(got[7].answer)
    assert (answer["short_answer"], answer["explanation"], answer["persona_afterword"]) == ("a", "one\n\ntwo", "bye")
    assert [(q["quote_title"], q["quote_text"]) for q in answer["quotes"]] == [("T", "x\n y \n**U**"), ("V", "z")]
    assert got[7].call.asDict() == {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3, "latency_ms": 1500, "model": "m", "provider": "p", "has_quotes": True}
    empty = json.loads(got[8].answer)
    assert (empty["short_answer"], empty["quotes"], empty["explanation"], got[8].call.has_quotes) == ("only **bold**", [], "", False)


@pytest.mark.parametrize(("stored", "quotes"), [('{"quotes": []}', False), ('{"quotes": [1]}', True), ("{}", False), ('{"quotes": null}', False), ("no json", True), ("[]", True)])
def test_a_stored_response_stays_as_it_is(spark, stored, quotes):
    (r,) = read(spark, HEAD + "x\n" + block(DATA | {"response_json": stored}))
    assert (r.fault, r.answer, r.call.has_quotes) == (None, stored, quotes)


def test_a_quote_of_very_many_lines(spark):
    lines = [f"line {k}" for k in range(50_000)]
    (r,) = read(spark, HEAD + "x\n\n> **T**\n" + "".join(f"> {x}\n" for x in lines) + "\n## Explanation\n" + "long " * 100_000 + "\n" + block(DATA))
    assert json.loads(r.answer)["quotes"][0]["quote_text"] == "\n".join(lines)


def test_written_answers_come_back(spark, tmp_path):
    texts = [f"a\n{k}\n\n---\n" for k in range(20)] + [""]
    path = str(tmp_path / "answers")
    reports.write_answers(spark.createDataFrame([(x,) for x in texts], "value string"), path)
    back = reports.answer_files(spark, path, whole=False)
    assert sorted(r.text for r in back.collect()) == sorted(texts)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "output_1.md").write_text("x\ny")
    (one,) = reports.answer_files(spark, str(tmp_path / "one")).collect()
    assert one.text == "x\ny" and one.path.endswith("output_1.md")


def test_tests_of_reports(spark):
    section = "# R\n## Per-Test Results\n\n### a-1\nfirst\n\n### b-2\n**Missing** ❌\n### Not one\n\n### a-1\nok\n"
    rows = [("r", section), ("s", section), ("none", "# R\n### b-2\n"), ("empty", ""), ("null", None), ("bare", "## Per-Test Results\n")]
    got = reports.test_results(spark.createDataFrame(rows, "run string, text string"), "run", "text")
    plain = []
    for run, text in rows:
        found = re.search(r"## Per-Test Results\s*\n(.*)", text or "", re.DOTALL)
        parts = re.split(r"\n### ([a-z0-9-]+)\n", found.group(1))[1:] if found else []
        plain += [(run, parts[k], "**Missing** ❌" in parts[k + 1]) for k in range(0, len(parts), 2)]
    assert sorted(map(tuple, got.collect())) == sorted(plain) != []
    assert sorted(map(tuple, reports.test_rates(got).collect())) == [("a-1", 2, 2, 0, 100.0), ("b-2", 2, 0, 2, 0.0)]
    assert reports.test_rates(got.limit(0)).count() == 0


def test_sweeps(spark, tmp_path):
    rows = spark.range(3).selectExpr("double(id) AS p", "double(id) AS q", *(f"id / 4 AS {x}" for x in reports.SWEEP))
    for k, params in enumerate((["p"], ["p", "q"])):
        reports.write_sweep(rows, params, str(tmp_path / str(k)))
        back = reports.read_sweep(spark, params, str(tmp_path / str(k)))
        assert len(back.columns) == len(params) + (7 if k == 0 else 4)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.select(*back.columns).collect()))
    with pytest.raises(Exception, match="header|schema"):
        reports.read_sweep(spark, ["q", "p"], str(tmp_path / "1")).collect()


def test_keyword_files(spark, tmp_path):
    path = str(tmp_path / "words")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "w string")
    assert reports.keywords(spark, path).count() == 0
    assert reports.add_keywords(spark, path, words("b", "a", None, "b", 'odd "word"\n')) == 3
    assert reports.add_keywords(spark, path, words("c", "a")) == 1
    assert sorted(r.keyword for r in reports.keywords(spark, path).collect()) == ["a", "b", "c", 'odd "word"\n']
    reports.clear_keywords(spark, path)
    assert reports.keywords(spark, path).count() == 0
    (tmp_path / "list.json").write_text('["x", "y"]')
    assert sorted(r.keyword for r in reports.keywords(spark, str(tmp_path / "list.json")).collect()) == ["x", "y"]


def test_totals_of_no_calls(spark):
    none = spark.createDataFrame([], "m string, total_cost double, cache_savings double, batch_savings double")
    assert tuple(summaries.batch_totals(none).collect()[0]) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert summaries.batch_totals(none, "m").count() == 0
    (r,) = summaries.batch_totals(spark.createDataFrame([("a", 1.0, -3.0, 1.0), ("a", None, None, None)], none.schema)).collect()
    assert (r.calls, r.total_cost, r.cache_share, r.batch_share) == (2, 1.0, 0.0, 0.0)
