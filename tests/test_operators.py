"""Small cases of the operators, and what the tables do not hold."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.functions import fuzzy
from siftstone.functions import text as T
from siftstone.operators import analytics, bm25, chunking, cleaning, cost, fusion, grounding, hierarchy, invariants, metrics, terms
from siftstone.sources import files
from siftstone.sources.tables import VersionedTable


def one(df):
    return df.collect()[0][0]


def test_ratio_is_the_indel_ratio():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                t[i + 1][k + 1] = t[i][k] + 1 if x == y else max(t[i][k + 1], t[i + 1][k])
        return 200 * t[-1][-1] / (len(a) + len(b)) if a or b else 100

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcdé ", k=rng.randrange(12))) for _ in range(2))
        assert fuzzy.ratio_of(a, b) == pytest.approx(slow(a, b))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["## A", "text", "", "# top", "### deep", "  ", "##"]), min_size=1, max_size=8))
def test_chunks_hold_all_words(spark, lines):
    text = "\n".join(lines)
    found = chunking.chunks(spark.createDataFrame([(1, text)], "id int, md string"), "id", "md").orderBy("position").collect()
    assert [r.position for r in found] == list(range(len(found)))
    assert " ".join(r.text for r in found).split() == text.split()
    assert all(r.header_level in (0, 2) for r in found)
    titled = "## A" in lines  # without a titled header nothing is cut
    assert sum(r.header_level == 2 for r in found) == (sum(x.split(" ")[0] == "##" for x in lines) if titled else 0)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue dog"), (3, "green cat here")], "id int, text string")
    found = bm25.search(spark.createDataFrame([(7, "red fox")], "q int, t string"), docs, 5, "q", "t", "id", "text").collect()
    import math

    idf = math.log(3 - 1 + 0.5) - math.log(1 + 0.5)
    norm = 1.6 * (1 - 0.8 + 0.8 * 3 / (8 / 3))
    assert [(r.id, r.score) for r in found] == [(1, round(idf * 2 * 2.6 / (2 + norm) + idf * 2.6 / (1 + norm), 6))]


def test_fusion_needs_a_vector_hit(spark):
    v = spark.createDataFrame([(1, 10, 1, 0.9)], "query_id int, id int, rank int, similarity double")
    x = spark.createDataFrame([(1, 11, 1, 3.0), (2, 12, 1, 2.0)], "query_id int, id int, rank int, score double")
    found = {(r.query_id, r.id): r for r in fusion.hybrid(v, x, 5).collect()}
    assert set(found) == {(1, 10), (1, 11)}
    assert found[1, 11].similarity is None
    assert {r.relevance for r in found.values()} == {0.45}  # equal scores stretch to the low end


def test_measures_of_duplicate_ranks(spark):
    found = metrics.ranking_measures(spark.createDataFrame([(1, 1), (1, 1), (1, None)], "query_id int, rank int")).first()
    assert (found.average_precision, found.recall, found.reciprocal_rank) == (1.0, round(2 / 3, 6), 1.0)


def test_synonyms_are_whole_words(spark):
    words = spark.createDataFrame([("heal", "regain wounds"), ("c++", "language"), ("shoot twice", "double")], "synonym string, term string")
    q = spark.createDataFrame([(1, "Can I heal?"), (2, "healing"), (3, "SHOOT twice or heal")], "id int, t string")
    found = dict(terms.expanded(q, words, "id", "t").collect())
    assert found == {1: "Can I heal? regain wounds", 2: "healing", 3: "SHOOT twice or heal double regain wounds"}


def test_entities(spark):
    names = spark.createDataFrame([("Plague Marine", "DG"), ("Heavy Bolter Gunner", "AM"), ("Assassin", "X")], "name string, team string")
    q = spark.createDataFrame([(1, "what does a plague marine do"), (2, "the marine of the plague"), (3, "gunner heavy"), (4, "a bolter")], "id int, t string")
    found = dict(terms.matched_teams(q, terms.entity_table(names, "name", "team"), "id", "t").collect())
    assert found == {1: ["DG"], 4: ["AM"]}


def test_grounding(spark):
    quotes = spark.createDataFrame([(1, "a", "The **quick** fox [...] nothing like it"), (2, "a", "")], "id int, k string, q string")
    texts = spark.createDataFrame([("a", 5, "Here the quick  fox ran."), ("a", 6, "Other")], "k string, t int, body string")
    found = {(r.id, r.part): r for r in grounding.grounded(quotes, texts, "id", "q", "k", "t", "body").collect()}
    assert found[1, 0].score == 1.0 and found[1, 0].source == 5
    assert found[1, 1].valid is False
    assert found[2, 0].valid is True


def test_cleaning(spark):
    md = "  • It’s\n| a |b|\n|:-|--|\n| n | Ranged | 1 | 2 | 3 | Range 8\", Rending, odd |\nmove within 6\" **within**  \n1OCP OCP"
    found = cleaning.cleaned(spark.createDataFrame([(1, md)], "id int, md string"), "id", "md").first()
    assert found.text.split("\n") == ["    - It's".replace("    ", "    ", 1), "| a | b |", "|---|---|", '| n | ranged | 1 | 2 | 3 | **Range 8"**, **Rending**, odd |', 'move within **6"** within'.replace('within **6"**', 'within **6"**'), "1OCP 0CP"]
    assert (found.apostrophes, found.ocr, found.weapon_types, found.trailing) == (1, 1, 1, 1)


def test_header_tree(spark):
    md = "## A\n### B\n#### C\n## D\n#### E\n### F"
    found = {r.title: r.parent for r in hierarchy.tree(hierarchy.headers(spark.createDataFrame([(1, md)], "id int, md string"), "id", "md"), "id").collect()}
    assert found == {"A": None, "B": 0, "C": 1, "D": None, "E": None, "F": 3}


def test_parent_prefix(spark):
    df = spark.createDataFrame([("P - Child", "P"), ("X - P - Child", "P"), ("Child", "P"), ("A", None)], "t string, p string")
    assert [r[0] for r in df.select(hierarchy.without_parent(F.col("t"), F.col("p"))).collect()] == ["Child", "Child", "Child", "A"]


def test_cost_modes(spark):
    calls = spark.createDataFrame([("s", 1000, 0, 2000, 1000), ("o#low", 1000, 0, 2000, 1000), ("?", 1000, 1000, 0, 0)], "m string, p long, c long, r long, w long")
    book = spark.createDataFrame([("s", 1.0, 1.0, 0.1, True), ("o", 1.0, 1.0, 0.25, False)], "model string, prompt double, completion double, ratio double, separate boolean")
    found = {r.m: r for r in cost.breakdown(cost.priced(calls, book, "m"), "p", "c", "r", "w", F.lit(True), F.lit("x::y")).collect()}
    assert found["s"].total_cost == pytest.approx((1 + 0.2 + 1.25) * 0.8)
    assert found["s"].cache_savings == pytest.approx(1.8 - 0.25)
    assert found["o#low"].total_cost == pytest.approx(0.25 * 0.8)
    assert found["?"].total_cost == pytest.approx(0.004 * 0.8)


def test_token_bucket(spark):
    rows = [("a", k, 1_700_000_000.0) for k in range(12)] + [("a", 12, 1_700_000_006.0)]
    df = spark.createDataFrame(rows, "k string, e int, s double").withColumn("t", F.timestamp_seconds("s"))
    found = {r.e: r for r in analytics.token_bucket(df, "k", "t", "e").collect()}
    assert [found[k].allowed for k in range(13)] == [True] * 10 + [False, False, True]
    assert found[10].retry_after == pytest.approx(6.0)


def test_votes_never_fall_below_zero(spark):
    rng = random.Random(3)
    rows = [(t, k, rng.choice([1, -1])) for t in range(5) for k in range(40)]
    want = {}
    for t, _, d in rows:
        want[t] = max(0, want.get(t, 0) + d)
    df = spark.createDataFrame(rows, "t int, k int, d int")
    assert dict(invariants.clamped_votes(df, "t", "k", "d").collect()) == want


def test_weekly_has_empty_weeks(spark):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-23", 4)], "d string, n int")
    found = {str(r.week): r.n for r in analytics.weekly(df.withColumn("d", F.to_date("d")), "d", {"n": F.col("n")}).collect()}
    assert found == {"2024-01-01": 1, "2024-01-08": 2, "2024-01-15": 0, "2024-01-22": 0, "2024-01-29": 4}


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    make = lambda rows: spark.createDataFrame(rows, "id int, v string")
    t.append(make([(1, "a"), (2, "b")]))
    t.upsert(make([(2, "c"), (3, "d")]), "id")
    assert t.delete(make([(1, "")]), "id") == 1
    assert t.delete(make([(9, "")]), "id") == 0
    assert dict(t.read().collect()) == {2: "c", 3: "d"}
    t.reset()
    assert t.read().count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("---\nsource: s\n---\n## H\n")
    (tmp_path / "y.md").write_text("plain")
    (tmp_path / "s.json").write_text('{"official": ["Heal", "mend"], "later": ["mend"]}')
    assert files.markdown(spark, str(tmp_path)).count() == 2
    assert files.markdown(spark, str(tmp_path), recursive=False).count() == 1
    assert dict(files.synonyms(spark, str(tmp_path / "s.json")).collect()) == {"heal": "official", "mend": "later"}
    assert files.synonyms(spark, str(tmp_path / "none.json")).count() == 0


def test_text_functions(spark):
    df = spark.range(1).select(
        T.snippet(F.lit("A b. " * 60)).alias("snippet"), T.verbatim(F.array(*map(F.lit, ["a", "b", "c", "d"])), F.array(*map(F.lit, [4, 1, 2, 9, 1]))).alias("verbatim"),
        T.sentences(F.lit("Line 1\nLine 2. Next sentence.")).alias("sentences"), T.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("python.org")).alias("uuid"),
    ).first()
    import uuid

    assert df.snippet.endswith("b.") and len(df.snippet) <= 150
    assert df.verbatim == "a b [...] d"
    assert df.sentences == ["Line 1", "Line 2.", "Next sentence."]
    assert df.uuid == str(uuid.uuid5(uuid.NAMESPACE_DNS, "python.org"))
    with pytest.raises(ValueError):
        T.token_windows(F.array(F.lit(1)), 5, 5)


def test_quotes_and_headers_meet_whole_texts(spark):
    from types import SimpleNamespace

    from siftstone.queries import retrieval as R

    quote = "the quick zebra meets seven calm otters by the river"
    head = "a header that is alike for its first forty characters"
    docs = [(1, "filler words come first " * 300 + quote), (2, head + " and ends in apples\nbody"), (3, head + " but closes on quite another thing\nbody"), (4, "nothing of it")]
    asked = [(1, quote), (2, head + " but closes on quite another thing\nmore")]
    query = {f.__name__: f for f in (R.quote_grounding, R.fuzzy_header_match)}
    t = SimpleNamespace(documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame(asked, "item_id long, text string"))
    found = {r.item_id: r for r in query["quote_grounding"](t).collect()}
    assert (found[1].source, found[1].score, found[1].valid) == (1, 1.0, True)
    found = {r.item_id: (r.chunk, r.score) for r in query["fuzzy_header_match"](t).collect()}
    assert found[2] == (3, 1.0)


def test_prompts_need_as_many_ids_as_chunks(spark):
    from siftstone.operators import answers

    good, df = (spark.createDataFrame([x], "i array<string>, t array<string>") for x in ((["abcdefghij"], ["x"]), (["a"], [])))
    out = answers.context_text(F.col("i"), F.col("t"))
    assert good.select(out.alias("x")).first().x == "[CHUNK_cdefghij]:\nx"
    with pytest.raises(Exception, match="as many ids"):
        df.select(out.alias("x")).collect()


def test_aliases_match_as_substrings_or_by_likeness(spark):
    q = spark.createDataFrame([(1, "the xv88 fires"), (2, "about komandos"), (3, "none of it")], "q int, t string")
    aliases = spark.createDataFrame([("xv88", "A"), ("kommandos", "B")], "a string, team string")
    found = terms.alias_teams(q, aliases, "q", "t", "a", "team")
    assert {(r.q, r.team) for r in found.collect()} == {(1, "A"), (2, "B")}
    teams = terms.all_teams([found, found], "q")
    assert {(r.q, tuple(r.teams)) for r in teams.collect()} == {(1, ("A",)), (2, ("B",))}
    assert terms.structure_of(aliases, teams.where("q = 1"), "team").count() == 1 and terms.structure_of(aliases, teams.limit(0), "team").count() == 0


def test_queries_without_keywords_come_back_untouched(spark):
    q = spark.createDataFrame([(1, " two  blanks ")], "q int, t string")
    none = spark.createDataFrame([], "keyword string")
    assert terms.normalised(q, none, "q", "t").first().normalised == " two  blanks "


def test_windows_cover_a_text_to_its_end(spark):
    from siftstone.functions import fuzzy

    text = "".join(chr(97 + k % 26) for k in range(100))
    found = spark.createDataFrame([(text,)], "t string").select(fuzzy.windows(F.col("t"), F.lit(30)).alias("w")).first().w
    assert found == [text[at : at + 30 * k] for at in range(0, 100, 5) for k in (1, 2, 3)]


def test_truths_are_found_inside_words_and_short_ones_too(spark):
    from siftstone.operators import metrics

    text = "Alpha beta gamma delta epsilon zeta eta theta iota"
    truths = spark.createDataFrame([(1, "pha beta gamma delta epsilon zeta eta th"), (2, "beta"), (3, "pha beta gamma delta epsilon zeta eta thx"), (4, "iota")], "k int, truth string")
    found = metrics.found_in(truths, spark.createDataFrame([(7, text)], "d int, text string"), "truth", "text")
    assert sorted(r.k for r in found.collect()) == [1, 2, 4]


def test_places_are_counted_in_ranges(spark):
    from siftstone.operators import sizes

    df = spark.createDataFrame([(k % 2, float(k * k % 97) + k / 1000, k % 5 + 1) for k in range(200)], "g int, v double, w int")
    rows = [(r.g, r.v, r.w, r.before) for r in sizes.placed(df, ["g"], "v", F.col("w")).collect()]
    assert len(rows) == 200 and all(before == sum(w for g2, v2, w, _ in rows if g2 == g and v2 < v) for g, v, _, before in rows)


def test_categories_of_nodes_come_from_the_topmost_ancestor(spark):
    md = "## FAQ - A\n### X - Strategy Ploy\n## Team - Faction Rule\n### Sub - Strategy Ploy\n#### deep\n## plain\n### Y - Firefight Ploy"
    nodes = hierarchy.tree(hierarchy.headers(spark.createDataFrame([(1, md)], "d int, t string"), "d", "t"), "d")
    found = [r.category for r in hierarchy.inherited(nodes, "d").orderBy("node").collect()]
    assert found == [None, None, "Faction Rules", "Faction Rules", "Faction Rules", None, "Firefight Ploys"]


def test_a_hop_takes_headers_first_and_searches_for_the_rest(spark):
    from siftstone.plans import retrieval

    chunks = spark.createDataFrame([(1, "Charge Rules", "how to charge"), (2, "Shooting", "red fox shoots"), (3, "Other", "blue dog"), (4, "charge rules", "again")], "id int, header string, text string")
    missing = spark.createDataFrame([(9, "'Charge Rule', red fox, shooting")], "q int, t string")
    found = retrieval.header_hop(missing, chunks, bm25.index(chunks, "id", "text"), "q", "t", "id", "header").orderBy("place").collect()
    assert [(r.id, r.place) for r in found] == [(1, 1), (2, 2)]
    assert found[0].score == pytest.approx(200 * 11 / 23 / 100 - 0.01, abs=1e-6) and found[1].score == pytest.approx(0.99)


def test_faithfulness_needs_all_parts_of_a_quote(spark):
    parts = spark.createDataFrame([(1, 1, 0, 1.0), (1, 1, 1, 0.9), (1, 2, 0, 0.99)], "answer int, quote int, part int, score double")
    assert [(r.quotes, r.quote_faithfulness) for r in grounding.faithfulness(parts, "quote", "answer").collect()] == [(2, 0.5)]


def test_result_cache_forgets(spark):
    from datetime import datetime, timedelta

    from siftstone.operators.messages import cache_trace

    at = datetime(2024, 1, 1)
    rows = [(1, " Ab", "u", 0), (2, "aB ", "u", 300), (3, "ab", "u", 301), (4, "ab", "v", 302), (5, "ab", "u", 601), (6, "ab", "u", 602)]
    df = spark.createDataFrame([(n, q, x, at + timedelta(seconds=s)) for n, q, x, s in rows] + [(7, "ab", "u", None)], "id long, q string, x string, ts timestamp")
    assert {r.id: r.hit for r in cache_trace(df, "q", "x", "ts", "id").collect()} == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False}


def test_messages_and_blocks(spark):
    from siftstone.operators import messages

    long = "a" * 1899
    texts = ["short. one", f"{long}. {long}. b", "x " * 1001, "one<!--CACHE_BREAK--> <!--CACHE_BREAK-->two", "<!--CACHE_BREAK-->", "", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id int, text string")
    found = {r.id: (r.m, r.b) for r in df.select("id", messages.packed(F.col("text")).alias("m"), messages.cache_blocks(F.col("text")).alias("b")).collect()}
    assert found[0][0] == ["short. one"] and found[1][0] == [long + ".", long + ".", "b."] and found[2][0] == [("x " * 1001).strip() + " ."]
    assert [tuple(x) for x in found[3][1]] == [("one", True), ("two", False)] and [tuple(x) for x in found[4][1]] == [(texts[4], False)]
    assert found[5][0] == [""] and [tuple(x) for x in found[0][1]] == [("short. one", False)]
